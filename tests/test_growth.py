"""What keeps shuffles in proportion to the input: facts are read once, shuffled rows stay narrow."""

from __future__ import annotations

import datetime as dt
import functools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retailops.operators import clean as CL
from retailops.operators import features as FE
from retailops.operators import forecast as FC
from retailops.operators import iforest
from retailops.operators import timeseries as TS
from retailops.plans import catalog, evidence
from retailops.plans import prepare as P
from retailops.sources import io as IO

SCHEMA = ("Order_ID string, Customer_ID string, Product_Name string, Order_Date date, Region string, Sales decimal(18,2), "
          "Profit decimal(18,2), Discount decimal(4,2), Quantity int")


def facts(spark, n=600):
    day = dt.date(2019, 1, 1)
    rows = [(f"o{k // 2}", f"c{k % 7}", f"p{k % 5 if k % 3 else 0}", day + dt.timedelta(days=3 * k), "RS"[k % 2], Decimal(k % 41) + Decimal("0.25"),
             Decimal(k % 13 - 4), Decimal("0.05"), k % 9) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def counted(df):
    """``df`` and a counter of the rows that were read from it."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), read


@pytest.mark.parametrize("work", [
    lambda df: FC.train_boosted(TS.resample(df, "M"), max_iter=2)[1],
    lambda df: FC.holdout_forecasts(TS.resample(df, "M"), "M", "naive"),
    lambda df: FC.holdout_forecasts(TS.resample(df, "M"), "M", "seasonal"),
    lambda df: TS.resample(df, "W", ["Region"]),
    lambda df: iforest.anomalies_isolation_forest(df, n_trees=3),
    lambda df: CL.cap_outliers(df, ["Sales", "Profit"]),
    lambda df: CL.outlier_counts(df, ["Sales", "Profit"]),
    lambda df: CL.clean(df)])
def test_facts_are_read_once(spark, work):
    df, read = counted(facts(spark))
    work(df).collect()
    assert read.value == 600


@pytest.mark.parametrize("name", ["k05_k06_boosted_holdout", "k07_feature_importance", "k08_recursive_forecast", "k09_forecast_table",
                                  "j06_accuracy_rounded", "j06_accuracy_seasonal_holdout"])
def test_forecast_queries_read_the_facts_once(spark, monkeypatch, name):
    df, read = counted(facts(spark))
    monkeypatch.setattr(P, "sales", lambda s, d: df)
    monkeypatch.setattr(FC, "train_boosted", functools.partial(FC.train_boosted, max_iter=2))
    assert {**catalog.QUERIES, **evidence.QUERIES}[name](spark, "").collect()
    assert read.value == 600


def test_empty_periods_of_each_series(spark):
    d = dt.date
    rows = [("a", d(2020, 1, 31), "1.00", "0.10"), ("a", d(2020, 4, 1), None, None), ("a", d(2020, 4, 9), "2.00", "0.30"), ("b", d(2020, 3, 5), "5.00", None)]
    df = spark.createDataFrame([(k, day, "o", s and Decimal(s), x and Decimal(x)) for k, day, s, x in rows],
                               "Region string, Order_Date date, Order_ID string, Sales decimal(18,2), Discount decimal(4,2)").withColumns(
        {"Profit": F.col("Sales"), "Quantity": F.lit(2)})
    got = [tuple(r) for r in TS.resample(df, "M", ["Region"]).orderBy("Region", "Order_Date").collect()]
    assert got == [("a", d(2020, 1, 31), 1.0, 1.0, 1, 2, 0.1), ("a", d(2020, 2, 29), 0.0, 0.0, 0, 0, 0.1), ("a", d(2020, 3, 31), 0.0, 0.0, 0, 0, 0.1),
                   ("a", d(2020, 4, 30), 2.0, 2.0, 1, 4, 0.3), ("b", d(2020, 3, 31), 5.0, 5.0, 1, 2, 0.0)]


def test_joined_rows_carry_no_derived_columns(spark):
    df = FE.features(facts(spark), as_of="max")
    plan = df.select("Sales_Bucket", "Customer_Segment", "Product_Performance")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sales_Bucket" in plan and "Sales_Bucket" not in plan[plan.index("Join LeftOuter"):]
    assert df.columns[:3] == ["Product_Name", "Customer_ID", "Order_ID"] and df.columns[-1] == "Product_Performance"


def test_product_stats_against_plain_grouping(spark):
    df = facts(spark).unionByName(spark.createDataFrame([(None, "c1", "p1", None, "R", None, None, None, None), ("x", "c1", "q", None, "R", None, None, None, None)], SCHEMA))
    from retailops.functions import aggs as A
    want = df.groupBy("Product_Name").agg(A.dsum("Sales"), A.isum("Quantity"), A.mean("Sales"), A.dsum("Profit"), F.countDistinct("Order_ID"))
    got = FE.product_stats(df).drop("Product_Performance")
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def odd_facts(spark):
    """Null keys, an order of two customers, a product's orders in every part, rows that come twice."""
    none = [(None, None, None, None, "R", None, None, None, None), ("o1", "c9", "p1", None, "R", Decimal("7.00"), None, None, 1),
            (None, "c1", None, dt.date(2021, 1, 1), "R", Decimal("5.00"), Decimal("1.00"), Decimal("0.10"), 2)]
    return facts(spark).unionByName(spark.createDataFrame(none * 2, SCHEMA))


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, old)


def test_features_deal_no_whole_rows(spark, no_broadcast):
    df = odd_facts(spark)
    got = FE.features(df, as_of="max")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Region" not in plan[plan.index("Exchange hashpartitioning"):]
    stats = FE.customer_stats(df, "max"), FE.product_stats(df)  # of rows that are not bucketed
    want = FE.row_features(FE.attach_product_stats(FE.attach_customer_stats(df, stats[0]), stats[1])).select(*got.columns)
    assert got.dtypes == want.dtypes and got.count() == df.count()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("by_")]


def test_profile_counts_distinct_values_without_the_joins(spark, no_broadcast):
    df = odd_facts(spark)
    got = IO.profile(FE.features(df, as_of="max"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    row = got.collect()[0]
    assert (row.Rows, row.Unique_Customers, row.Unique_Products) == (606, 8, 5)
    empty = IO.profile(df.limit(0)).collect()[0]
    assert (empty.Rows, empty.Unique_Customers, empty.Unique_Products, empty.Total_Sales) == (0, 0, 0, None)


def test_years_are_written_side_by_side(spark, tmp_path, monkeypatch):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(key, None), []
    real = IO._open_files
    monkeypatch.setattr(IO, "_open_files", lambda s, n: seen.append(n) or real(s, n))
    df = spark.range(300).select("id", (F.col("id") % 40).cast("int").alias("Year"))  # more years than files
    IO.write_processed(df, str(tmp_path / "t"))
    assert seen == [IO.OPEN_FILES] and spark.conf.get(key, None) == before
    assert spark.read.parquet(str(tmp_path / "t")).select("id", "Year").exceptAll(df).count() == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 300
