"""Operator behaviour on unit frames, edge cases and properties."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailops.operators import analysis as AN
from retailops.operators import anomaly as AM
from retailops.operators import bi
from retailops.operators import clean as CL
from retailops.operators import timeseries as TS
from retailops.operators.features import features
from retailops.plans import prepare as P
from retailops.sources.schema import RAW_SCHEMA


def _row(order, cust, name, prod, sales, profit, disc, qty, date, region="East", seg="Consumer"):
    return (order, name, cust, prod, "Cat", "Sub", Decimal(sales), Decimal(profit), Decimal(disc), qty, date,
            region, "US", "NY", seg)


@pytest.fixture(scope="module")
def tiny(spark):
    d = dt.date
    rows = [
        _row("O1", "C1", "Ann Lee", "P1", "100.00", "10.00", "0.10", 2, d(2024, 1, 1)),
        _row("O2", "C2", "Ann Lee", "P2", "300.00", "-5.00", "0.00", 1, d(2024, 1, 7)),
        _row("O3", "C1", "Ann Lee", "P1", "50.00", "5.00", "0.20", 1, d(2024, 1, 8)),
        _row("O4", "C3", "Bob Ray", "P3", "-20.00", "-30.00", "0.80", 1, d(2024, 3, 5)),
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_weekly_resample_fills_empty_weeks(spark):
    d = dt.date
    rows = [_row(f"O{i}", "C", "N", "P", str(v), "0.00", "0.00", 1, day)
            for i, (day, v) in enumerate([(d(2024, 1, 1), 1), (d(2024, 1, 7), 2), (d(2024, 1, 8), 3),
                                          (d(2024, 3, 5), 4)])]
    ts = TS.resample(spark.createDataFrame(rows, RAW_SCHEMA), "W").orderBy("Order_Date").collect()
    assert ts[0].Order_Date == d(2024, 1, 7) and ts[0].Sales == 3
    assert ts[1].Order_Date == d(2024, 1, 14) and ts[1].Sales == 3
    assert ts[2].Order_Date == d(2024, 1, 21) and ts[2].Sales == 0 and ts[2].Orders == 0
    assert ts[-1].Order_Date == d(2024, 3, 10) and ts[-1].Sales == 4
    assert len(ts) == 10


def test_bad_frequency_raises(tiny):
    with pytest.raises(ValueError):
        TS.resample(tiny, "Y")
    with pytest.raises(ValueError):
        AM.detect_anomalies(tiny, "nope")


def test_namesakes_merge_by_name_not_id(tiny):
    f = features(tiny, as_of="max")
    by_name = {r.Customer_Name: r.Orders for r in AN.top_customers_by_name(f).collect()}
    assert by_name["Ann Lee"] == 3
    by_id = {r.Customer_ID: r.Order_Count for r in bi.top_customers(f, 10).collect()}
    assert by_id == {"C1": 2, "C2": 1, "C3": 1}


def test_empty_input(spark):
    empty = spark.createDataFrame([], RAW_SCHEMA)
    f = features(empty, as_of="max")
    assert bi.top_customers(f).count() == 0
    assert AN.revenue_distribution(f).collect()[0].Count == 0  # labels kept with zero rows
    k = AN.generate_kpis(f).collect()[0]
    assert k.Revenue_per_Customer == 0.0 and k.Total_Orders == 0


def test_negative_sales_and_anomaly_rules(tiny):
    a = AM.anomalies_orders(tiny).collect()
    types = {r.Order_ID: r.Anomaly_Type for r in a}
    assert types["O4"] == "Negative Sales"
    assert "O1" not in types


def test_clean_floor_clips_losses(tiny):
    capped = CL.cap_outliers(tiny).collect()
    assert min(r.Profit for r in capped) >= 0
    kept = CL.cap_outliers(tiny, floor=None).collect()
    assert min(r.Profit for r in kept) < 0


def test_clean_drops_nonpositive_and_dedupes(spark, tiny):
    dup = tiny.unionByName(tiny.filter("Order_ID = 'O1'").withColumn("Product_Name", F.lit("P0")))
    assert CL.duplicate_count(dup).collect()[0].Duplicate_Count == 1
    d = CL.dedupe(dup, ["Order_ID"], ["Order_Date", "Product_Name"]).filter("Order_ID = 'O1'").collect()
    assert len(d) == 1 and d[0].Product_Name == "P0"
    out = CL.clean(dup)
    assert out.filter("Sales <= 0").count() == 0 and out.count() == 3


def test_fill_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, s string")
    got = {r.s for r in CL.fill_categorical_mode(df, ["s"]).collect()}
    assert got == {"Unknown"}


def test_coerce_and_parse(spark):
    df = spark.createDataFrame([("2024-01-05", "$1,234.50"), ("bad", "n/a")], "Order_Date string, Sales string")
    r = CL.parse_currency(CL.coerce_dates(df)).collect()
    assert r[0].Order_Date == dt.date(2024, 1, 5) and r[0].Sales == 1234.5
    assert r[1].Order_Date is None and r[1].Sales is None


def test_partition_totals_equal_global(spark, small_dir):
    f = P.rows(spark, small_dir)
    total = f.agg(F.sum("Sales")).collect()[0][0]
    for fn in (AN.report_category_performance, AN.report_regional_performance):
        assert abs(sum(r.Sales for r in fn(f).collect()) - float(total)) < 1e-6
    shares = [r.Sales_Share_Pct for r in bi.regional_analysis(f).collect()]
    assert abs(sum(shares) - 100) < 0.05


def test_rfm_scores_in_range(spark, small_dir):
    p = AN.customer_profiles(P.full(spark, small_dir)).toPandas()
    for c in ("R_Score", "F_Score", "M_Score"):
        assert p[c].between(1, 5).all()
    assert (p["RFM_Score"] == p["R_Score"] + p["F_Score"] + p["M_Score"]).all()


def test_cumulative_last_equals_total(spark, small_dir):
    f = P.rows(spark, small_dir)
    t = AN.daily_revenue_trend(f).toPandas()
    assert abs(t["Cumulative_Revenue"].iloc[-1] - t["Daily_Revenue"].sum()) < 1e-6
    assert t["Moving_Avg_7d"].iloc[:6].isna().all()


def test_accuracy_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(10, 100, 50)
    f = a + rng.normal(0, 5, 50)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, f)], "Actual double, Forecast double")
    m = AM.accuracy(df).collect()[0]
    assert np.isclose(m.mae, np.mean(np.abs(a - f)))
    assert np.isclose(m.rmse, np.sqrt(np.mean((a - f) ** 2)))
    assert np.isclose(m.mape, np.mean(np.abs((a - f) / (a + 1e-10))) * 100)
    assert np.isclose(m.smape, np.mean(2 * np.abs(a - f) / (np.abs(a) + np.abs(f) + 1e-10)) * 100)
    assert np.isclose(m.r2, 1 - np.sum((a - f) ** 2) / np.sum((a - a.mean()) ** 2))


def test_anomalies_subset_of_daily(spark, small_dir):
    s = P.sales(spark, small_dir)
    daily = AM.daily_frame(s).select("Order_Date")
    for m in ("iqr", "zscore"):
        assert AM.detect_anomalies(s, m).select("Order_Date").subtract(daily).count() == 0
