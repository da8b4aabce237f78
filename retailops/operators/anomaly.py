"""Anomaly detection.

Global statistics (mean, std, quartiles) are one-row aggregates broadcast to
the rows; the daily frame is an aggregate with one row per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..sources.schema import ANOMALY_DISCOUNT, ANOMALY_LABELS, ANOMALY_LOSS, ANOMALY_SIGMA
from .stats import attach_row, quantile_row

ORDER_COLUMNS = ["Sales", "Profit", "Discount", "Order_ID", "Customer_Name", "Product_Name", "Category",
                 "Quantity", "Order_Date", "Region", "Payment_Mode"]


def anomalies_orders(sales: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """Order rows above mean + sigma * sample std of Sales, negative, over-discounted or big losses.

    The first matching rule names the row; sorted by Sales descending.
    """
    stats = sales.agg((F.avg(F.col("Sales").cast("double"))
                       + F.lit(float(sigma)) * F.stddev_samp(F.col("Sales").cast("double"))).alias("_thr"))
    s = attach_row(sales.select(*ORDER_COLUMNS), stats)
    high = F.col("Sales") > F.col("_thr")
    neg = F.col("Sales") < 0
    disc = F.col("Discount") > F.lit(ANOMALY_DISCOUNT)
    loss = F.col("Profit") < F.lit(ANOMALY_LOSS)
    label = (F.when(high, F.lit(ANOMALY_LABELS[0])).when(neg, F.lit(ANOMALY_LABELS[1]))
              .when(disc, F.lit(ANOMALY_LABELS[2])).when(loss, F.lit(ANOMALY_LABELS[3])))
    return (s.filter(high | neg | disc | loss).withColumn("Anomaly_Type", label).drop("_thr")
             .orderBy(F.col("Sales").desc()))


def daily_frame(sales: DataFrame) -> DataFrame:
    """Daily Sales sum, distinct orders, mean order value (one row per date)."""
    return (sales.filter(F.col("Order_Date").isNotNull()).groupBy("Order_Date")
                 .agg(F.sum("Sales").cast("double").alias("Sales"), F.countDistinct("Order_ID").alias("Orders"),
                      A.mean("Sales").alias("Avg_Value")))


def anomalies_iqr(sales: DataFrame, k: float = 1.5) -> DataFrame:
    """Days outside [Q1 - k*IQR, Q3 + k*IQR] of daily sales."""
    d = daily_frame(sales)
    # one value per date: the distinct count is bounded by the calendar
    q = quantile_row(d, {"_q": ("Sales", [0.25, 0.75])}, strategy="map").select(
        (F.col("_q")[0] - F.lit(k) * (F.col("_q")[1] - F.col("_q")[0])).alias("_lo"),
        (F.col("_q")[1] + F.lit(k) * (F.col("_q")[1] - F.col("_q")[0])).alias("_hi"))
    x = attach_row(d, q)
    out = x.filter((F.col("Sales") < F.col("_lo")) | (F.col("Sales") > F.col("_hi"))).withColumn(
        "Anomaly_Type", F.when(F.col("Sales") > F.col("_hi"), F.lit("Peak (High Sales)"))
                         .otherwise(F.lit("Dip (Low Sales)")))
    return out.drop("_lo", "_hi").orderBy("Order_Date")


def anomalies_zscore(sales: DataFrame, z: float = 2.0) -> DataFrame:
    """Days with |z| > z using the population std; Peak above the mean, else Dip."""
    d = daily_frame(sales)
    st = d.agg(F.avg("Sales").alias("_mu"), F.stddev_pop("Sales").alias("_sd"))
    x = attach_row(d, st)
    zz = F.abs(F.try_divide(F.col("Sales") - F.col("_mu"), F.col("_sd")))
    out = x.filter(zz > F.lit(z)).withColumn(
        "Anomaly_Type", F.when(F.col("Sales") > F.col("_mu"), F.lit("Peak")).otherwise(F.lit("Dip")))
    return out.drop("_mu", "_sd").orderBy("Order_Date")


def detect_anomalies(sales: DataFrame, method: str = "iqr", **kw) -> DataFrame:
    """Dispatch by method name (J05: unknown names raise)."""
    if method == "iqr":
        return anomalies_iqr(sales, **kw)
    if method == "zscore":
        return anomalies_zscore(sales, **kw)
    if method == "isolation_forest":
        from .iforest import anomalies_isolation_forest
        return anomalies_isolation_forest(sales, **kw)
    raise ValueError(f"Unknown anomaly method: {method}")


def anomaly_breakdown(anomalies: DataFrame) -> DataFrame:
    """Anomaly count per type, most frequent first."""
    return anomalies.groupBy("Anomaly_Type").agg(F.count(F.lit(1)).alias("Count")).orderBy(
        F.col("Count").desc(), "Anomaly_Type")


def first_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` anomalies in date order."""
    return anomalies.select("Order_Date", "Sales", "Orders", "Anomaly_Type").orderBy("Order_Date").limit(n)


def accuracy(df: DataFrame, actual: str = "Actual", forecast: str = "Forecast",
             series_cols: list[str] | None = None) -> DataFrame:
    """MAPE (denominator + 1e-10), RMSE, MAE, sMAPE, R2 in one aggregate (per series)."""
    a, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    err = a - f
    keys = list(series_cols or [])
    g = df.groupBy(*keys) if keys else df
    m = g.agg(
        (F.avg(F.abs(err / (a + F.lit(1e-10)))) * 100).alias("mape"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(2 * F.abs(err) / (F.abs(a) + F.abs(f) + F.lit(1e-10))) * 100).alias("smape"),
        F.sum(err * err).alias("_sse"), (F.var_pop(a) * F.count(a)).alias("_sst"))
    return m.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).drop("_sse", "_sst")


def label_anomalies(col: Column, lo: Column, hi: Column) -> Column:
    return F.when(col > hi, F.lit("Peak (High Sales)")).when(col < lo, F.lit("Dip (Low Sales)"))
