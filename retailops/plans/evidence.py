"""Queries that take sources, sinks, rules and models through the correctness gate.

Readers and sinks are held as round trips: what a table holds after it was
written in a sink's format and read by the reader is stated in SQL. The paths lie
in the shared checkpoint folder. Fitted models are held by what is exact about
them: dates, flags, actuals, the order of the bounds, the naive model's numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import format_currency
from ..operators import anomaly as AM
from ..operators import bi
from ..operators import clean as CL
from ..operators import forecast as FC
from ..operators import insights as IN
from ..operators import timeseries as TS
from ..session import scratch_folder, shared_table
from ..sources import io as IO
from ..sources.schema import REQUIRED_COLUMNS
from ..sources.tables import read_table
from . import prepare as P
from .oracle import _F, _R, _SALES, ORACLE, _holdout_naive_sql, _naive_sql, resample_sql
from .sqlparts import ADAPTER, dsum

QUERIES, SQL = {}, {}
_S = f"WITH sales AS ({ADAPTER})\n"


def _query(sql: str):
    def deco(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn
    return deco


def _path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark, name)}/data"


# --- A: sources and sinks -----------------------------------------------------

def _aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as an export with other headers, currency text and American dates."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("Order ID"), F.col("o_custkey").cast("string").alias("Customer ID"),
                    F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2)).alias("Sales"),
                    F.date_format("o_orderdate", "MM/dd/yyyy").alias("Order Date"), F.col("o_orderpriority").alias("Payment Mode"))


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS Order_ID, CAST(o_custkey AS VARCHAR) AS Customer_ID,
       CAST(o_totalprice AS DECIMAL(18,2)) AS Sales, CAST(o_orderdate AS DATE) AS Order_Date, o_orderpriority AS Payment_Mode FROM orders""")
def a01_a02_read_aliased_csv(spark, sf_dir):
    """Headers are renamed, then values typed."""
    path = _path(spark, "aliased")
    IO.write_csv(_aliased(spark, sf_dir), path)
    return IO.read_sales_csv(spark, path)


@_query("""SELECT count(*) AS Rows, CAST(5 AS INTEGER) AS Coverage, FALSE AS Complete, CAST(10 AS INTEGER) AS Missing FROM orders""")
def a03_a04_schema_check(spark, sf_dir):
    """How many of the required columns a source has."""
    df = IO.standardize_columns(_aliased(spark, sf_dir))
    ok, missing = IO.validate_schema(df)
    return df.agg(F.count(F.lit(1)).alias("Rows"), F.lit(IO.schema_coverage(df)).alias("Coverage"), F.lit(ok).alias("Complete"),
                  F.lit(len(missing)).alias("Missing"))


@_query(_S + f"SELECT Region, count(*) AS n, {dsum('Sales')} AS Sales FROM sales GROUP BY Region")
def a05_first_valid_source(spark, sf_dir):
    """A source with all columns goes before one with twelve of them."""
    sales, part, whole = P.sales(spark, sf_dir), _path(spark, "part"), _path(spark, "whole")
    sales.select(*REQUIRED_COLUMNS[:12]).limit(10).write.parquet(part)
    sales.write.parquet(whole)
    df = IO.load_first_valid(spark, [_path(spark, "none"), part, whole], fmt="parquet")
    return df.groupBy("Region").agg(F.count(F.lit(1)).alias("n"), F.sum("Sales").cast("double").alias("Sales"))


@_query(_S + "SELECT * FROM sales")
def a07_a11_csv_round_trip(spark, sf_dir):
    """The CSV sink and the typed reader give the rows back."""
    path = _path(spark, "raw")
    IO.write_raw(P.sales(spark, sf_dir), path)
    return IO.read_sales_csv(spark, path)


@_query(_R(f"SELECT Region, Month, count(*) AS n, {dsum('Sales')} AS Sales FROM rowf WHERE Year = 1996 GROUP BY Region, Month"))
def a08_processed_round_trip(spark, sf_dir):
    """The feature sink is partitioned by year; a filter on it reads one folder."""
    path = _path(spark, "features")
    IO.write_processed(P.rows(spark, sf_dir), path)
    return (spark.read.parquet(path).filter("Year = 1996").groupBy("Region", "Month")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("Sales").cast("double").alias("Sales")))


@_query(ORACLE["k03_forecast_naive"])
def a13_forecast_round_trip(spark, sf_dir):
    """A forecast written as CSV."""
    path = _path(spark, "forecast")
    IO.write_forecast(FC.forecast_naive(TS.resample(P.sales(spark, sf_dir), "M"), 6, "M"), path)
    return spark.read.option("header", True).schema("Order_Date date, Sales_Forecast double, Lower_Bound double, Upper_Bound double").csv(path)


@_query(ORACLE["e11_kpi_summary"])
def a14_metrics_round_trip(spark, sf_dir):
    """One row of metrics as JSON."""
    path, df = _path(spark, "metrics"), bi.kpi_summary(P.rows(spark, sf_dir))
    IO.write_metrics(df, path)
    return spark.read.schema(df.schema).json(path)


@_query(f"SELECT Text FROM ({ORACLE['l07_executive_summary']})")
def a16_text_report_round_trip(spark, sf_dir):
    """The report's lines as a text file."""
    path = _path(spark, "report")
    IO.write_text_report(IN.executive_summary(P.rows(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("Text"))


@_query(_S + "SELECT count(*) AS Rows, 'Profit,Category' AS Missing FROM sales")
def b11_missing_recommended(spark, sf_dir):
    """Recommended columns that are absent are named."""
    df = P.sales(spark, sf_dir).drop("Profit", "Category", "State")
    return df.agg(F.count(F.lit(1)).alias("Rows"), F.lit(",".join(CL.missing_recommended(df))).alias("Missing"))


@_query(_S + """SELECT State, CASE WHEN abs(x) >= 1000000 THEN '$' || printf('%.2f', x / 1000000) || 'M'
       WHEN abs(x) >= 1000 THEN '$' || printf('%.1f', x / 1000) || 'K' ELSE '$' || printf('%.2f', x) END AS Profit
FROM (SELECT State, CAST(sum(Profit) AS DOUBLE) AS x FROM sales GROUP BY State)""")
def c19_format_currency(spark, sf_dir):
    """Sums by state as display strings."""
    return P.sales(spark, sf_dir).groupBy("State").agg(format_currency(F.sum("Profit").cast("double")).alias("Profit"))


# --- D, J, K: forecasts and models ----------------------------------------------

_CUT = "1997-06-30"
_HEAD = (resample_sql("M", []).replace("\nts AS (", "\ntsall AS (", 1)
         + f",\nts AS (SELECT * FROM tsall WHERE Order_Date <= DATE '{_CUT}')")
_NAIVE = _naive_sql("M", [], 60)
_NAIVE = _NAIVE[:_NAIVE.rindex("\nSELECT ")] + ", nv AS (" + _NAIVE[_NAIVE.rindex("\nSELECT "):] + ")\n"


def _monthly(spark, sf_dir):
    return TS.period_table(P.sales(spark, sf_dir), "M", columns=["Sales"])


def _head_forecast(spark, sf_dir):
    ts = _monthly(spark, sf_dir)
    return ts, FC.forecast_naive(ts.filter(F.col("Order_Date") <= F.lit(_CUT).cast("date")), 60, "M")


@_query(_SALES + ", " + _HEAD + _NAIVE + "SELECT nv.*, tsall.Sales AS Actual_Sales FROM nv LEFT JOIN tsall USING (Order_Date)")
def d03_attach_actuals_naive(spark, sf_dir):
    """Forecasts from mid-1997 on beside the months that are known."""
    ts, fc = _head_forecast(spark, sf_dir)
    return FC.attach_actuals(fc, ts)


@_query(_SALES + ", " + _HEAD + _NAIVE + "SELECT nv.* FROM nv ANTI JOIN tsall USING (Order_Date)")
def d04_future_only_naive(spark, sf_dir):
    """Of those forecasts the months without an actual."""
    ts, fc = _head_forecast(spark, sf_dir)
    return FC.future_only(fc, ts)


@_query("SELECT round(mape, 6) AS mape, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(smape, 6) AS smape, round(r2, 6) AS r2 FROM ("
        + _holdout_naive_sql() + ")")
def j06_accuracy_rounded(spark, sf_dir):
    """The naive model's scores, rounded, so that the order of the sums does not show."""
    m = AM.accuracy(FC.holdout_forecasts(_monthly(spark, sf_dir), "M", "naive"))
    return m.select(*[F.round(c, d).alias(c) for c, d in (("mape", 6), ("rmse", 4), ("mae", 4), ("smape", 6), ("r2", 6))])


def _seasonal_facts(fc: DataFrame, keys: list[str]) -> DataFrame:
    actual = F.when(~F.isnan("Actual_Sales"), F.col("Actual_Sales"))
    return fc.select(*keys, "Order_Date", "Is_Future", actual.alias("Actual_Sales"),
                     ((F.col("Lower_Bound") <= F.col("Sales_Forecast")) & (F.col("Sales_Forecast") <= F.col("Upper_Bound"))
                      & (F.col("Lower_Bound") >= 0)).alias("In_Bounds"),
                     (F.col("Trend").isNotNull() & F.col("Yearly_Seasonality").isNotNull()).alias("Has_Components"))


def _seasonal_sql(keys: list[str], future: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    return (f"SELECT {k}Order_Date, 0 AS Is_Future, greatest(Sales, 0.0) AS Actual_Sales, TRUE AS In_Bounds, TRUE AS Has_Components FROM ts\n"
            f"UNION ALL SELECT {k}{future} AS Order_Date, 1, CAST(NULL AS DOUBLE), TRUE, TRUE FROM ")


@_query(_SALES + ", " + resample_sql("M", []) + "\n" + _seasonal_sql(
    [], "last_day(CAST(last_day(max(Order_Date) + 1) + to_months(CAST(h - 1 AS INTEGER)) AS DATE))") + "ts, range(1, 7) t(h) GROUP BY h")
def k01_k02_seasonal_facts(spark, sf_dir):
    """What is exact about the seasonal forecast."""
    return _seasonal_facts(FC.forecast_seasonal(_monthly(spark, sf_dir), 6, "M"), [])


@_query(_SALES + ", " + resample_sql("W", ["Region"]) + "\n" + _seasonal_sql(
    ["Region"], "CAST((CAST(date_trunc('week', max(Order_Date) + 1) AS DATE) + 6) + 7 * CAST(h - 1 AS INTEGER) AS DATE)")
    + "ts, range(1, 9) t(h) GROUP BY Region, h")
def k01_seasonal_facts_per_region(spark, sf_dir):
    """The same for weeks and regions."""
    return _seasonal_facts(FC.forecast_seasonal(TS.period_table(P.sales(spark, sf_dir), "W", ["Region"], columns=["Sales"]), 8, "W", ["Region"]), ["Region"])


_MONTHS = "last_day(CAST(last_day(max(Order_Date) + 1) + to_months(CAST(h - 1 AS INTEGER)) AS DATE))"


@_query(_SALES + ", " + resample_sql("M", []) + f"""
SELECT 'hold-out' AS Item, m AS Name, TRUE AS Holds FROM (VALUES ('mae'), ('rmse'), ('r2'), ('mape')) t(m)
UNION ALL SELECT 'importance', f, TRUE FROM (VALUES {', '.join(f"('{f}')" for f in FC.FEATURES)}) t(f)
UNION ALL SELECT 'forecast', strftime(d, '%Y-%m-%d') || ' boosted', TRUE FROM (SELECT {_MONTHS} AS d FROM ts, range(1, 7) t(h) GROUP BY h)
UNION ALL SELECT 'table', strftime(d, '%Y-%m-%d') || ' ' || m, TRUE
          FROM (SELECT {_MONTHS} AS d FROM ts, range(1, 7) t(h) GROUP BY h), (VALUES ('seasonal'), ('boosted')) v(m)
UNION ALL SELECT 'compare', x || ' ' || m, TRUE FROM (VALUES ('boosted'), ('naive')) v(x), (VALUES ('mape'), ('rmse'), ('mae'), ('smape'), ('r2')) t(m)
UNION ALL SELECT 'importance', 'sum', TRUE""")
def k05_k10_boosted_facts(spark, sf_dir):
    """What is exact about the boosted model (ten rounds): its scores are finite
    and in range, importances add up to one, forecasts and bounds lie in order on the
    dates ahead, and the tables have a row for each of their items."""
    ts = _monthly(spark, sf_dir)
    model, test = FC.train_boosted(ts, max_iter=10)
    scores = AM.accuracy(test)
    ahead = FC.forecast_recursive(model, ts, 6, "M")
    future = FC.forecast_seasonal(ts, 6, "M").filter("Is_Future = 1")
    ordered = (F.col("Lower_Bound") <= F.col("Sales_Forecast")) & (F.col("Sales_Forecast") <= F.col("Upper_Bound")) & (F.col("Lower_Bound") >= 0)
    fine = [F.struct(F.lit(m).alias("Name"), (F.col(m).isNotNull() & ~F.isnan(m) & ((F.col(m) <= 1) if m == "r2" else (F.col(m) >= 0))).alias("Holds"))
            for m in ("mae", "rmse", "r2", "mape")]
    weights = FC.feature_importance(model, spark)
    day = F.date_format("Order_Date", "yyyy-MM-dd")
    compared = FC.compare_models({"boosted": scores, "naive": AM.accuracy(FC.holdout_forecasts(ts, "M", "naive"))})
    parts = [("hold-out", scores.select(F.inline(F.array(*fine)))),
             ("importance", weights.select(F.col("Feature").alias("Name"), F.col("Importance").between(0, 1).alias("Holds"))),
             ("importance", weights.agg(F.lit("sum").alias("Name"), (F.abs(F.sum("Importance") - 1) < 1e-9).alias("Holds"))),
             ("forecast", ahead.select(F.concat_ws(" ", day, "Method").alias("Name"), ordered.alias("Holds"))),
             ("table", future.select(F.concat_ws(" ", day, F.lit("seasonal")).alias("Name"), ordered.alias("Holds"))),
             ("table", ahead.select(F.concat_ws(" ", day, F.lit("boosted")).alias("Name"), ordered.alias("Holds"))),
             ("compare", compared.select(F.concat_ws(" ", "Model", "Metric").alias("Name"), F.col("Value").isNotNull().alias("Holds")))]
    out = None
    for item, df in parts:
        df = df.select(F.lit(item).alias("Item"), "Name", "Holds")
        out = df if out is None else out.unionByName(df)
    return out


@_query(_S + "SELECT count(DISTINCT Order_Date) AS Days, TRUE AS Within_Share, TRUE AS All_Known, TRUE AS Scores_In_Range FROM sales")
def j04_isolation_facts(spark, sf_dir):
    """At most a twentieth of the days are anomalies, each a known day with its own sums,
    and scores lie between -1 and 0."""
    sales = shared_table(P.sales(spark, sf_dir).select("Order_Date", "Order_ID", "Sales"), "daily")
    daily = AM.daily_frame(sales).select("Order_Date", F.col("Sales").alias("_sales"))
    found = AM.detect_anomalies(sales, "isolation_forest").select("Order_Date", "Sales", "Anomaly_Score")
    return daily.join(found, "Order_Date", "full").agg(
        F.count("_sales").alias("Days"), (F.count("Anomaly_Score") <= F.count("_sales") * 0.05 + 1).alias("Within_Share"),
        F.min(F.when(F.col("Anomaly_Score").isNotNull(), F.col("_sales").eqNullSafe(F.col("Sales"))).otherwise(True)).alias("All_Known"),
        F.min(F.when(F.col("Anomaly_Score").isNotNull(), F.col("Anomaly_Score").between(-1, 0)).otherwise(True)).alias("Scores_In_Range"))


# --- A06: the columns of the feature table (fixed values: position, name, type) ----

_COLUMNS = [
    (0, 'Product_Name', 'string'), (1, 'Customer_ID', 'string'), (2, 'Order_ID', 'string'), (3, 'Customer_Name', 'string'),
    (4, 'Category', 'string'), (5, 'Sub_Category', 'string'), (6, 'Sales', 'decimal(18,2)'), (7, 'Profit', 'decimal(18,2)'),
    (8, 'Discount', 'decimal(4,2)'), (9, 'Quantity', 'int'), (10, 'Order_Date', 'date'), (11, 'Region', 'string'),
    (12, 'Country', 'string'), (13, 'State', 'string'), (14, 'Payment_Mode', 'string'), (15, 'Year', 'int'),
    (16, 'Month', 'int'), (17, 'Month_Name', 'string'), (18, 'Quarter', 'int'), (19, 'Day', 'int'),
    (20, 'Day_of_Week', 'int'), (21, 'Day_Name', 'string'), (22, 'Week_of_Year', 'int'), (23, 'Is_Weekend', 'int'),
    (24, 'Is_Month_Start', 'int'), (25, 'Is_Month_End', 'int'), (26, 'Year_Month', 'string'), (27, 'Season', 'string'),
    (28, 'Is_Holiday_Season', 'int'), (29, 'Unit_Price', 'decimal(18,2)'), (30, 'Profit_Margin_Pct', 'decimal(18,2)'), (31, 'Is_Profitable', 'int'),
    (32, 'Discounted_Price', 'decimal(18,2)'), (33, 'Sales_Bucket', 'string'), (34, 'Customer_Total_Spent', 'double'), (35, 'Customer_Total_Orders', 'bigint'),
    (36, 'Customer_Avg_Order_Value', 'double'), (37, 'Customer_Total_Profit', 'double'), (38, 'Customer_Avg_Discount', 'double'), (39, 'Customer_First_Purchase', 'date'),
    (40, 'Customer_Last_Purchase', 'date'), (41, 'Customer_Tenure_Days', 'int'), (42, 'Customer_Recency_Days', 'int'), (43, 'Customer_Segment', 'string'),
    (44, 'Product_Total_Sales', 'double'), (45, 'Product_Total_Quantity', 'bigint'), (46, 'Product_Avg_Price', 'double'), (47, 'Product_Total_Profit', 'double'),
    (48, 'Product_Order_Count', 'bigint'), (49, 'Product_Performance', 'string'),
]
#: Of a query that is registered in the catalog.
SQL["a06_column_profile"] = _F("\nUNION ALL ".join(
    f"SELECT {i} AS Position, '{c}' AS Column, '{t}' AS Type, count(*) - count({c}) AS Nulls FROM features" for i, c, t in _COLUMNS))
