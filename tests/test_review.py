"""Nulls, duplicate keys, NaN, overflow and short series: rows that the provided tables do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailops.operators import clean as CL
from retailops.operators import forecast as FC
from retailops.operators import insights as IN
from retailops.sources import io as IO


def test_clipping_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (1.0,), (2.0,), (3.0,), (1000.0,)], "Sales double")
    assert [r.Sales for r in CL.clip_lower(df, "Sales").collect()][:3] == [None, 0.0, 1.0]
    capped = CL.cap_outliers(df, ["Sales"]).collect()
    assert capped[0].Sales is None and all(r.Sales is not None for r in capped[1:])


def test_null_keys_are_one_duplicate_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "Order_ID string, v int")
    n = CL.duplicate_count(df).collect()[0].Duplicate_Count
    assert n == 2 == df.count() - CL.dedupe(df).count()


def test_text_nan_is_null(spark):
    df = spark.createDataFrame([("NaN",), ("$1,200.50",), ("x",)], "Sales string")
    assert [r.Sales for r in CL.parse_currency(df).collect()] == [None, 1200.5, None]
    assert CL.drop_nonpositive_sales(CL.parse_currency(df)).count() == 1


@pytest.mark.parametrize("price", [None, 7])
def test_types_after_cleaning_follow_the_schema(spark, price):
    rows = [("1", "A", 5.0, 1.0, 0.1, 2, price, dt.date(2024, 1, 1)), ("2", None, 6.0, 1.0, 0.1, 2, 9, None)]
    df = spark.createDataFrame(rows, "Order_ID string, Product_Name string, Sales double, Profit double, Discount double, "
                                     "Quantity int, Price int, Order_Date date")
    out = CL.clean(df)
    assert dict(out.dtypes) == {"Order_ID": "string", "Product_Name": "string", "Sales": "double", "Profit": "double",
                                "Discount": "double", "Quantity": "double", "Price": "double", "Order_Date": "date"}
    assert out.filter(F.col("Price").isNull() | F.col("Order_Date").isNull()).count() == 0


def test_audit_counts_the_steps_of_clean(spark):
    df = spark.createDataFrame([("1", 5.0), ("1", 6.0), ("2", None), ("3", -4.0), ("4", 7.0)], "Order_ID string, Sales double")
    rows = [(r.Step, r.Rows_Before, r.Rows_After) for r in CL.clean_audit(df).collect()]
    assert [r[0] for r in rows] == ["coerce_types", "fill_missing", "dedupe", "cap_outliers", "sales_positive"]
    assert rows[2][1:] == (5, 4) and rows[-1][2] == CL.clean(df).count() == 3


def test_complete_source_goes_before_an_earlier_partial_one(spark, tmp_path):
    partial, full = str(tmp_path / "partial"), str(tmp_path / "full")
    for path, n in ((partial, 12), (full, 15)):
        spark.createDataFrame([tuple("1" * n)], IO.REQUIRED_COLUMNS[:n]).write.option("header", True).csv(path)
    assert IO.load_first_valid(spark, [partial, full]).columns == IO.REQUIRED_COLUMNS
    assert IO.load_first_valid(spark, [partial]).columns == IO.REQUIRED_COLUMNS[:12]


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", "x"), ("a", "x"), (None, "x")] * 3, "c string, d string")
    got = CL.fill_categorical_mode(df, ["c", "d"], threshold=0.3)
    assert got.filter("c = 'a'").count() == 9 and got.filter("d = 'Unknown'").count() == 6


def test_quantity_out_of_range_is_null(spark):
    got = IO.apply_raw_types(spark.createDataFrame([("99999999999",), ("3.0",), ("x",)], "Quantity string"))
    assert [r.Quantity for r in got.collect()] == [None, 3, None]


def _months(n, start=2000):
    return [dt.date(start + k // 12, k % 12 + 1, 28) for k in range(n)]


def test_series_of_every_length_are_forecast(spark):
    rows = [(str(n), d, float(100 + 10 * (k % 12) + k)) for n in (5, 12, 18, 25, 60) for k, d in enumerate(_months(n))]
    ts = spark.createDataFrame(rows, "Region string, Order_Date date, Sales double").withColumn("Sales", F.col("Sales").cast("decimal(18,2)"))
    model, test = FC.train_boosted(ts, ["Region"], max_iter=3)
    out = FC.forecast_recursive(model, ts, 3, "M", ["Region"]).collect()
    assert {(r.Region, r.Method) for r in out} == {(str(n), "boosted" if n == 60 else "naive") for n in (5, 12, 18, 25, 60)}
    assert len(out) == 15 and all(r.Sales_Forecast is not None and r.Sales_Forecast >= 0 for r in out)
    assert {r.Region for r in test.collect()} == {"60"}
    short = ts.filter("Region = '12'")
    none, empty = FC.train_boosted(short, ["Region"], max_iter=3)
    assert none is None and empty.count() == 0
    assert FC.forecast_recursive(none, short, 2, "M", ["Region"]).count() == 2
    assert FC.feature_importance(none, spark).count() == 0


def test_training_features_hold_nothing_of_the_period(spark):
    ts = spark.createDataFrame([(d, float(k)) for k, d in enumerate(_months(45))], "Order_Date date, Sales double")
    ts = ts.withColumn("Sales", F.col("Sales").cast("decimal(18,2)"))
    a = FC.boost_features(ts, exclude_current=True).orderBy("Order_Date").collect()
    changed = ts.withColumn("Sales", F.when(F.col("Order_Date") == a[-1].Order_Date, 9999).otherwise(F.col("Sales")).cast("decimal(18,2)"))
    b = FC.boost_features(changed, exclude_current=True).orderBy("Order_Date").collect()
    assert {c for c in a[-1].asDict() if a[-1][c] != b[-1][c]} == {"Sales"}


def test_no_holdout_keeps_the_types(spark):
    ts = spark.createDataFrame([], "Order_Date date, Sales decimal(18,2)")
    assert dict(FC.holdout_forecasts(ts, "M", "naive").dtypes)["Forecast"] == "double"


def test_summary_sentences():
    assert IN.TOP_CATEGORY.format("Toys", "1,000") == "• Top Category: 'Toys' with $1,000 in sales"
    assert IN.OVERVIEW.format(1, 2, 3, 4, 5) == "Total revenue of $1 with $2 in profit (3% margin) from 4 orders across 5 customers."


def test_entry_works_without_the_optional_part():
    """With a module that only the optional part needs missing, the library's queries are all there."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as E\n"
            "q = E.queries(); assert 'e01_top_customers' in q and 'a07_a11_csv_round_trip' in q\n"
            "assert 'pipeline' not in q and not any(k.startswith('op') for k in q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)))


def test_scratch_tables_go_with_the_driver(tmp_path):
    """Shared tables lie in the checkpoint folder while the driver lives, and are gone after."""
    import os
    import subprocess
    import sys
    import time
    code = ("import sys, os; from pyspark.sql import SparkSession\n"
            "from retailops.session import shared_table\n"
            f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
            "df = shared_table(s.range(10), 'kept'); assert df.count() == 10\n"
            f"assert any(x.startswith('kept-') for _, d, _ in os.walk('{tmp_path}') for x in d)\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    for _ in range(100):  # the JVM ends a little later than the Python driver
        if not [x for _, d, _ in os.walk(tmp_path) for x in d if x.startswith("kept-")]:
            break
        time.sleep(0.2)
    else:
        raise AssertionError("scratch tables are still there")
