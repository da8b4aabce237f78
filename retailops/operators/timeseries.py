"""Time-series resampling and window features.

Everything is a panel operator: ``series_cols`` partitions the data into
independent series (one series when empty). Windows are partitioned by the
series and ordered by period, so they run over period rows - bounded by the
calendar span per series - never over fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..session import reliable_checkpoint

FREQS = ("D", "W", "M", "Q")


def period_end(date: Column, freq: str) -> Column:
    """Label of the period holding ``date``: the day, the week's Sunday, month end, quarter end."""
    if freq == "D":
        return date
    if freq == "W":
        return F.date_add(F.date_trunc("week", date).cast("date"), 6)
    if freq == "M":
        return F.last_day(date)
    if freq == "Q":
        return F.last_day(F.add_months(F.date_trunc("quarter", date).cast("date"), 2))
    raise ValueError(f"Unsupported frequency: {freq}")


def _calendar(lo: Column, hi: Column, freq: str) -> Column:
    """Array of every period label from ``lo`` to ``hi`` (both labels)."""
    if freq == "D":
        return F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))
    if freq == "W":
        return F.sequence(lo, hi, F.expr("INTERVAL 7 DAY"))
    if freq == "M":
        starts = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("INTERVAL 1 MONTH"))
        return F.transform(starts, lambda d: F.last_day(d))
    if freq == "Q":
        starts = F.sequence(F.trunc(lo, "quarter"), F.trunc(hi, "quarter"), F.expr("INTERVAL 3 MONTH"))
        return F.transform(starts, lambda d: F.last_day(F.add_months(d, 2)))
    raise ValueError(f"Unsupported frequency: {freq}")


def resample(df: DataFrame, freq: str = "D", series_cols: list[str] | None = None,
             date_col: str = "Order_Date", fill: bool = True) -> DataFrame:
    """Sales, Profit, Orders (distinct), Quantity, Avg_Discount per period.

    'D' keeps observed dates only; 'W'/'M'/'Q' emit every period between the
    first and last label of each series (empty periods: sums and counts 0,
    mean null). With ``fill`` every column is then forward-filled within the
    series and remaining nulls become 0 (so an empty period inherits the
    previous Avg_Discount).
    """
    if freq not in FREQS:
        raise ValueError(f"Unsupported frequency: {freq}")
    keys = list(series_cols or [])
    src = df.filter(F.col(date_col).isNotNull())
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    src = src.withColumn("_label", period_end(F.col(date_col), freq))
    agg = src.groupBy(*keys, "_label").agg(
        F.sum("Sales").alias("_sales"), F.sum("Profit").alias("_profit"),
        F.countDistinct("Order_ID").alias("Orders"), F.sum("Quantity").cast("bigint").alias("Quantity"),
        A.mean("Discount").alias("Avg_Discount"))
    if freq != "D":
        # each period also yields the empty ones before the next, so the facts are read once
        after = F.lead("_label").over(Window.partitionBy(*keys).orderBy("_label"))
        agg = agg.withColumn("_next", after)
        span = _calendar(F.col("_label"), F.coalesce("_next", "_label"), freq)
        span = F.when(F.col("_next").isNull(), span).otherwise(F.slice(span, 1, F.size(span) - 1))
        agg = agg.select(*[c for c in agg.columns if c not in ("_label", "_next")], F.posexplode(span).alias("_nth", "_label"))
        own = F.col("_nth") == 0
        agg = agg.withColumns({
            "_sales": F.coalesce(F.when(own, F.col("_sales")), F.lit(0).cast("decimal(28,2)")),
            "_profit": F.coalesce(F.when(own, F.col("_profit")), F.lit(0).cast("decimal(28,2)")),
            "Orders": F.when(own, F.col("Orders")).otherwise(0).cast("long"),
            "Quantity": F.coalesce(F.when(own, F.col("Quantity")), F.lit(0)).cast("bigint"),
            "Avg_Discount": F.when(own, F.col("Avg_Discount"))})
    out = agg.select(*keys, F.col("_label").alias(date_col), F.col("_sales").cast("double").alias("Sales"),
                     F.col("_profit").cast("double").alias("Profit"), "Orders", "Quantity", "Avg_Discount")
    if fill:
        w = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("Avg_Discount", F.coalesce(F.last("Avg_Discount", ignorenulls=True).over(w),
                                                        F.lit(0.0)))
    return out


def period_table(df: DataFrame, freq: str = "D", series_cols: list[str] | None = None,
                 date_col: str = "Order_Date", columns: list[str] | None = None) -> DataFrame:
    """``resample``, its period rows materialised once in the shared checkpoint folder.

    For callers that read the series more than once: models and hold-outs run
    several jobs over it, each of which would join and aggregate the facts anew.
    ``columns`` names the measures that are needed (all by default); the others
    are not aggregated.
    """
    ts = resample(df, freq, series_cols, date_col)
    return reliable_checkpoint(ts.select(*(series_cols or []), date_col, *columns) if columns else ts)


def future_dates(ts: DataFrame, periods: int, freq: str, series_cols: list[str] | None = None,
                 date_col: str = "Order_Date") -> DataFrame:
    """the next ``periods`` period labels after each series' last date (h = 1..periods)."""
    if freq not in FREQS:
        raise ValueError(f"Unsupported frequency: {freq}")
    keys = list(series_cols or [])
    last = ts.groupBy(*keys).agg(F.max(date_col).alias("_last"))
    h = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h")
    x = last.select(*keys, "_last", h)
    start = F.date_add(F.col("_last"), 1)
    if freq == "D":
        lab = F.date_add(F.col("_last"), F.col("h"))
    elif freq == "W":
        lab = F.date_add(period_end(start, "W"), (F.col("h") - 1) * 7)
    elif freq == "M":
        lab = F.last_day(F.add_months(period_end(start, "M"), F.col("h") - 1))
    else:
        lab = F.last_day(F.add_months(period_end(start, "Q"), (F.col("h") - 1) * 3))
    return x.select(*keys, "h", lab.alias(date_col))


def lag_features(ts: DataFrame, col: str = "Sales", lags: tuple[int, ...] = (1, 2, 3, 7),
                 windows: tuple[int, ...] = (7, 14, 30), series_cols: list[str] | None = None,
                 date_col: str = "Order_Date", exclude_current: bool = False, money: bool = True) -> DataFrame:
    """Lags and trailing row-based means (null until the window is full).

    The trailing means include the current row by default, as defined;
    ``exclude_current=True`` shifts them by one row. For money series
    (``money=True``) the mean is the exact decimal mean rounded half-up to
    6 decimals, independent of summation order.
    """
    keys = list(series_cols or [])
    w = Window.partitionBy(*keys).orderBy(date_col)
    cols = {f"{col}_Lag_{k}": F.lag(col, k).over(w) for k in lags}
    end = -1 if exclude_current else 0
    for k in windows:
        fr = w.rowsBetween(-(k - 1) + end, end)
        if money:
            mean = A.half_up_ratio(A.units(F.sum(F.col(col).cast("decimal(28,2)")).over(fr), 2), F.lit(k), 2, 6)
        else:
            mean = F.avg(col).over(fr)
        cols[f"{col}_Rolling_{k}"] = F.when(F.count(col).over(fr) >= k, mean)
    return ts.withColumns(cols)


def drop_warmup(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.na.drop(subset=cols)


def tail(ts: DataFrame, n: int, series_cols: list[str] | None = None, date_col: str = "Order_Date") -> DataFrame:
    """Last ``n`` periods of each series."""
    keys = list(series_cols or [])
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc())
    return ts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def chrono_split(ts: DataFrame, train_frac: float = 0.8, series_cols: list[str] | None = None,
                 date_col: str = "Order_Date") -> DataFrame:
    """``Is_Train`` = first floor(train_frac * n) periods of each series."""
    keys = list(series_cols or [])
    w = Window.partitionBy(*keys).orderBy(date_col)
    wn = Window.partitionBy(*keys)
    return ts.withColumn("Is_Train", (F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(wn) * train_frac))
                         .cast("int"))


def anomaly_overlay(daily: DataFrame, anomalies: DataFrame, date_col: str = "Order_Date") -> DataFrame:
    """Daily series with an anomaly flag (left join on the date)."""
    marks = anomalies.select(date_col, F.col("Anomaly_Type")).distinct()
    return (daily.join(marks, date_col, "left")
                 .withColumn("Is_Anomaly", F.col("Anomaly_Type").isNotNull().cast("int")))
