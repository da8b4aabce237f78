"""Cleaning operators.

Every statistic a cleaning step needs (median, mode, null share, quantile
bounds) is a one-row aggregate that is broadcast back to the rows - no value
is collected to the driver. Per-key "keep first" is a row number of one: Spark
limits each group to one row in every task before the shuffle, so a hot key
cannot pile its rows into one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_table
from ..sources.schema import NUMERIC_LIKE_COLUMNS, OUTLIER_COLUMNS, RECOMMENDED_COLUMNS
from .stats import attach_row, ffill, quantile_row

_NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.DecimalType, T.ShortType)


def _type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def null_counts(df: DataFrame) -> DataFrame:
    """One row: number of nulls per column plus the row count."""
    return df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])


def fill_numeric_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric nulls -> exact median of the column (filled columns become DOUBLE)."""
    if not cols:
        return df
    med = quantile_row(df, {f"_med_{c}": (c, [0.5]) for c in cols})
    out = attach_row(df, med)
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")[0]) for c in cols})
    return out.drop(*[f"_med_{c}" for c in cols])


def fill_categorical_mode(df: DataFrame, cols: list[str], threshold: float = 0.1,
                          unknown: str = "Unknown") -> DataFrame:
    """String nulls -> mode (ties -> smallest) when nulls < threshold of rows, else 'Unknown'."""
    if not cols:
        return df
    stats = df.agg(F.count(F.lit(1)).alias("_rows"),
                   *[F.sum(F.col(c).isNull().cast("long")).alias(f"_nulls_{c}") for c in cols])
    # values are counted by a shuffle on (column, value); each column's best is a partial aggregate
    values = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("string").alias("_value")) for c in cols])
    best = (df.select(F.inline(values)).filter(F.col("_value").isNotNull())
              .groupBy("_col", "_value").agg(F.count(F.lit(1)).alias("_n"))
              .groupBy("_col").agg(F.min_by("_value", F.struct((-F.col("_n")).alias("_n"), F.col("_value"))).alias("_value")))
    modes = best.agg(*[F.max(F.when(F.col("_col") == c, F.col("_value"))).alias(f"_mode_{c}") for c in cols])
    out = attach_row(attach_row(df, stats), modes)
    fills = {}
    for c in cols:
        use_mode = F.col(f"_nulls_{c}") < F.col("_rows") * F.lit(threshold)
        fill = F.when(use_mode, F.coalesce(F.col(f"_mode_{c}"), F.lit(unknown))).otherwise(F.lit(unknown))
        fills[c] = F.coalesce(F.col(c), fill)
    out = out.withColumns(fills)
    return out.drop("_rows", *[f"_nulls_{c}" for c in cols], *[f"_mode_{c}" for c in cols])


def ffill_dates(df: DataFrame, cols: list[str], order_cols: list[str]) -> DataFrame:
    """Datetime nulls <- last non-null above in ``order_cols`` order (distributed)."""
    return ffill(df, cols, order_cols) if cols else df


def dedupe(df: DataFrame, keys: list[str] | None = ("Order_ID",), order_cols: list[str] | None = None) -> DataFrame:
    """Keep the first row per key in ``order_cols`` order (then all columns as tie-break).

    Without key columns present, drop fully duplicated rows.
    """
    keys = [k for k in (keys or []) if k in df.columns]
    if not keys:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys]
    order_cols = [c for c in (order_cols or []) if c in df.columns]
    order = order_cols + [c for c in rest if c not in order_cols]
    if not order:
        return df.dropDuplicates(keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", first).filter(F.col("_nth") == 1).drop("_nth")


def duplicate_count(df: DataFrame, keys: list[str] = ("Order_ID",)) -> DataFrame:
    """Rows beyond the first per key (one row); null keys are one key, as in ``dedupe``."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("Duplicate_Count"))


def outlier_bounds(df: DataFrame, cols: list[str], lo: float = 0.05, hi: float = 0.95,
                   k: float = 1.5, floor: float | None = 0.0) -> DataFrame:
    """One row with ``_lo_<c>`` / ``_hi_<c>`` bounds: [max(Qlo - k*spread, floor), Qhi + k*spread]."""
    q = quantile_row(df, {f"_q_{c}": (c, [lo, hi]) for c in cols})
    sel = []
    for c in cols:
        qlo, qhi = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        spread = qhi - qlo
        lower = qlo - F.lit(k) * spread
        if floor is not None:
            lower = F.greatest(lower, F.lit(float(floor)))
        sel += [lower.alias(f"_lo_{c}"), (qhi + F.lit(k) * spread).alias(f"_hi_{c}")]
    return q.select(*sel)


def cap_outliers(df: DataFrame, cols: list[str] | None = None, lo: float = 0.05, hi: float = 0.95,
                 k: float = 1.5, floor: float | None = 0.0, materialize: bool = True) -> DataFrame:
    """Clip each column to its quantile bounds (capped columns become DOUBLE, nulls stay null).

    ``floor=0`` reproduces the defined behaviour (every loss is clipped to 0);
    ``floor=None`` keeps losses. The rows are written once as a shared table, as the
    quantile passes scan the capped columns and the result all of them;
    ``materialize=False`` leaves that out where ``df`` is a table already.
    """
    cols = [c for c in (cols or OUTLIER_COLUMNS) if c in df.columns]
    if not cols:
        return df
    if materialize:
        df = shared_table(df, "capped", position="_position")
    b = outlier_bounds(df, cols, lo, hi, k, floor)
    out = attach_row(df, b).withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col(f"_lo_{c}")), F.col(f"_hi_{c}")))
        for c in cols})
    if "_position" in out.columns:  # last, as Spark drops a sort below a join
        out = out.sortWithinPartitions("_position").drop("_position")
    return out.drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def outlier_counts(df: DataFrame, cols: list[str] | None = None, lo: float = 0.05, hi: float = 0.95,
                   k: float = 1.5, floor: float | None = 0.0) -> DataFrame:
    """Per column, its bounds and the number of rows outside them (long format)."""
    cols = [c for c in (cols or OUTLIER_COLUMNS) if c in df.columns]
    df = shared_table(df.select(*cols), "outliers")  # scanned by the quantile passes and by the count
    b = outlier_bounds(df, cols, lo, hi, k, floor)
    j = attach_row(df, b)
    counts = j.agg(*[F.first(f"_lo_{c}").alias(f"_lo_{c}") for c in cols],
                   *[F.first(f"_hi_{c}").alias(f"_hi_{c}") for c in cols],
                   *[F.sum(((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))).cast("long"))
                     .alias(f"_n_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("Column"), F.col(f"_lo_{c}").alias("Lower_Bound"),
                              F.col(f"_hi_{c}").alias("Upper_Bound"),
                              F.coalesce(F.col(f"_n_{c}"), F.lit(0)).alias("Outliers")) for c in cols])
    return counts.select(F.inline(rows))


def coerce_dates(df: DataFrame, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy",
                                                             "dd-MM-yyyy", "yyyy/MM/dd")) -> DataFrame:
    """String columns named like date/time/day -> DATE; unparsable -> null.

    ANSI mode is on, so parsing uses ``try_to_timestamp`` (a plain cast would
    raise). Already typed columns are left alone.
    """
    conv = {}
    for f in df.schema.fields:
        n = f.name.lower()
        if isinstance(f.dataType, T.StringType) and ("date" in n or "time" in n or "day" in n):
            parsed = F.coalesce(*[F.try_to_timestamp(F.col(f.name), F.lit(fmt)) for fmt in formats])
            conv[f.name] = parsed.cast("date")
    return df.withColumns(conv) if conv else df


def parse_currency(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Strip $, EUR, GBP signs and thousands commas, then to DOUBLE; bad -> null."""
    cols = [c for c in (cols or NUMERIC_LIKE_COLUMNS) if c in df.columns
            and isinstance(_type(df, c), T.StringType)]
    return df.withColumns({c: parse_currency_col(F.col(c)) for c in cols}) if cols else df


def parse_currency_col(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[$€£,]", "").try_cast("double"), F.lit(float("nan")))


def drop_nonpositive_sales(df: DataFrame, col: str = "Sales") -> DataFrame:
    """Keep Sales > 0 (null Sales dropped too)."""
    return df.filter(F.col(col) > 0) if col in df.columns else df


def missing_recommended(df: DataFrame) -> list[str]:
    """Recommended columns that are absent (metadata only, no job)."""
    return [c for c in RECOMMENDED_COLUMNS if c not in df.columns]


def clip_lower(df: DataFrame, col: str, lower: float = 0.0) -> DataFrame:
    """Negatives -> lower bound; nulls stay null."""
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.col(col), F.lit(lower))))


def having(df: DataFrame, cond: Column) -> DataFrame:
    """Filter after aggregation."""
    return df.filter(cond)


DEFAULT_ORDER = ["Order_Date", "Product_Name", "Sales", "Profit", "Quantity"]


def _fill(df: DataFrame, order_cols: list[str], threshold: float) -> DataFrame:
    """Null filling: medians, modes, and dates from above in ``order_cols`` order (the dates left out)."""
    nulls = null_counts(df).collect()[0].asDict()
    with_nulls = [c for c in df.columns if nulls.get(c)]
    dates = [c for c in with_nulls if isinstance(_type(df, c), (T.DateType, T.TimestampType))]
    df = fill_numeric_median(df, [c for c in with_nulls if isinstance(_type(df, c), _NUMERIC)])
    df = fill_categorical_mode(df, [c for c in with_nulls if isinstance(_type(df, c), T.StringType)], threshold)
    if not dates:
        return df
    lead = [c for c in order_cols if c not in dates]
    return ffill_dates(df, dates, lead + [c for c in df.columns if c not in dates and c not in lead])


def _to_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if isinstance(_type(df, c), _NUMERIC)})


def clean_steps(order_cols: list[str], floor: float | None, threshold: float) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The steps of ``clean`` in order, as (name, function)."""
    return [("coerce_types", lambda d: shared_table(_to_double(parse_currency(coerce_dates(d))), "coerced")),
            ("fill_missing", lambda d: _fill(d, order_cols, threshold)),
            ("dedupe", lambda d: shared_table(dedupe(d, ["Order_ID"], order_cols), "deduped")),
            ("cap_outliers", lambda d: cap_outliers(d, OUTLIER_COLUMNS, floor=floor, materialize=False)),
            ("sales_positive", drop_nonpositive_sales)]


def clean(df: DataFrame, order_cols: list[str] | None = None, floor: float | None = 0.0,
          threshold: float = 0.1) -> DataFrame:
    """Type coercion -> null filling -> dedupe -> outlier capping -> Sales > 0.

    Parsing runs first (so parsed nulls are filled and capping sees numbers).
    Types follow the schema alone: every numeric column is DOUBLE afterwards.
    One small job reads the null count of every column; a column without nulls
    skips its fill, which would change nothing. The typed rows are read by those
    counts and by the deduplication, the deduplicated ones by the passes of
    outlier capping, so both are written once as tables in the shared checkpoint
    folder: each pass scans only its columns.
    """
    order_cols = [c for c in (order_cols or DEFAULT_ORDER) if c in df.columns]
    for _, step in clean_steps(order_cols, floor, threshold):
        df = step(df)
    return df


def clean_audit(df: DataFrame, order_cols: list[str] | None = None, floor: float | None = 0.0,
                threshold: float = 0.1) -> DataFrame:
    """Rows before and after each step of ``clean`` as (Step_No, Step, Rows_Before, Rows_After)."""
    order_cols = [c for c in (order_cols or DEFAULT_ORDER) if c in df.columns]
    parts, before = [], df.agg(F.count(F.lit(1)).alias("Rows_Before"))
    for no, (name, step) in enumerate(clean_steps(order_cols, floor, threshold), 1):
        df = step(df)
        after = df.agg(F.count(F.lit(1)).alias("Rows_After"))
        parts.append(attach_row(before, after).select(F.lit(no).alias("Step_No"), F.lit(name).alias("Step"),
                                                      "Rows_Before", "Rows_After"))
        before = after.withColumnRenamed("Rows_After", "Rows_Before")
    return reduce(DataFrame.unionByName, parts).orderBy("Step_No")
