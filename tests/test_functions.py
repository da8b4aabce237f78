"""Row-level expressions on hand-written unit frames."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from retailops.functions import aggs as A
from retailops.functions.binning import cut, discount_analysis_bin, sales_bucket
from retailops.functions.calendar import calendar_columns, quarter_label
from retailops.functions.formatting import format_currency, format_percent, truncate_label
from retailops.functions.metrics import with_row_metrics


def test_discount_bins_unit(spark):
    vals = ["0", "0.05", "0.1", "0.3", "0.6", "0.7", "0.75"]
    df = spark.createDataFrame([(Decimal(v),) for v in vals], "d decimal(4,2)")
    got = [r.b for r in df.select(discount_analysis_bin("d").alias("b")).collect()]
    assert got == [None, "(0.0, 0.1]", "(0.0, 0.1]", "(0.2, 0.3]", "(0.5, 0.6]", "(0.6, 0.7]", None]


def test_sales_bucket_unit(spark):
    vals = ["0", "50", "50.01", "5000", "5001", "-3"]
    df = spark.createDataFrame([(Decimal(v),) for v in vals], "s decimal(18,2)")
    got = [r.b for r in df.select(sales_bucket("s").alias("b")).collect()]
    assert got == [None, "Very Low", "Low", "Very High", "Premium", None]


def test_cut_generic_labels(spark):
    df = spark.createDataFrame([(0.15,)], "x double")
    assert df.select(cut("x", [0, 0.1, 0.2]).alias("b")).collect()[0].b == "(0.1, 0.2]"


def test_calendar_columns(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 29),), (None,)], "Order_Date date")
    r = df.select(*[v.alias(k) for k, v in calendar_columns().items()]).collect()
    a = r[0]
    assert (a.Year, a.Month, a.Quarter, a.Day, a.Day_of_Week, a.Day_Name) == (2024, 12, 4, 29, 6, "Sunday")
    assert (a.Week_of_Year, a.Is_Weekend, a.Is_Month_End, a.Season, a.Is_Holiday_Season) == (52, 1, 1, "Winter", 1)
    assert a.Month_Name == "December" and a.Year_Month == "2024-12"
    b = r[1]
    assert b.Week_of_Year is None and b.Is_Weekend == 0 and b.Season is None
    assert df.select(quarter_label(F.lit(2024), F.lit(1)).alias("q")).collect()[0].q == "2024-Q1"


def test_row_metrics_zero_division_and_rounding(spark):
    df = spark.createDataFrame([(Decimal("10.01"), Decimal("-2.00"), Decimal("0.10"), 2),
                                (Decimal("0.00"), Decimal("1.00"), Decimal("0.00"), 0)],
                               "Sales decimal(18,2), Profit decimal(18,2), Discount decimal(4,2), Quantity int")
    r = with_row_metrics(df).collect()
    assert r[0].Unit_Price == Decimal("5.01")  # 5.005 half-up
    assert r[0].Profit_Margin_Pct == Decimal("-19.98")
    assert r[0].Is_Profitable == 0 and r[0].Discounted_Price == Decimal("9.01")
    assert r[1].Unit_Price is None and r[1].Profit_Margin_Pct is None


def test_exact_mean_half_up(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.00"),)], "x decimal(18,2)")
    assert df.agg(A.mean("x", 2, 2).alias("m")).collect()[0].m == 0.01  # 0.005 -> 0.01
    neg = spark.createDataFrame([(Decimal("-0.01"),), (Decimal("0.00"),)], "x decimal(18,2)")
    assert neg.agg(A.mean("x", 2, 2).alias("m")).collect()[0].m == -0.01


def test_formatting(spark):
    df = spark.createDataFrame([(1234567.0,), (4567.0,), (123.456,), (-2500.0,)], "v double")
    got = [r.s for r in df.select(format_currency("v").alias("s")).collect()]
    assert got == ["$1.23M", "$4.6K", "$123.46", "$-2.5K"]
    assert df.select(format_percent(F.lit(12.34)).alias("p")).first().p == "12.3%"
    t = spark.createDataFrame([("short",), ("a much longer product name here",)], "n string")
    got = [r.x for r in t.select(truncate_label("n", 25, always=False).alias("x")).collect()]
    assert got == ["short", "a much longer product nam..."]
