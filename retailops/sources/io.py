"""Readers, schema checks, profiling and sinks.

Paths are parameters: on a cluster they name shared storage; nothing here
writes to a machine-local folder on its own.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import attach_row
from .schema import (COLUMN_ALIASES, MIN_SCHEMA_COVERAGE, ORDERS_TABLE_COLUMNS, RAW_SCHEMA,
                     REQUIRED_COLUMNS)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename known header aliases to canonical names; unknown names are kept."""
    mapping = {}
    taken = set(df.columns)
    for c in df.columns:
        target = COLUMN_ALIASES.get(c)
        if target and target not in taken:
            mapping[c] = target
            taken.add(target)
    return df.withColumnsRenamed(mapping) if mapping else df


def validate_schema(df: DataFrame) -> tuple[bool, list[str]]:
    """All 15 required columns present? Returns (ok, missing). Metadata only."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    return (not missing, missing)


def schema_coverage(df: DataFrame) -> int:
    """Number of required columns present (a source is usable at >= 10)."""
    return sum(1 for c in REQUIRED_COLUMNS if c in df.columns)


def apply_raw_types(df: DataFrame) -> DataFrame:
    """Cast present canonical columns to the raw schema; bad values become null (ANSI-safe)."""
    casts = {}
    for f in RAW_SCHEMA.fields:
        if f.name not in df.columns or df.schema[f.name].dataType == f.dataType:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            casts[f.name] = F.coalesce(F.try_to_date(c.cast("string"), "yyyy-MM-dd"),
                                       F.try_to_date(c.cast("string"), "MM/dd/yyyy"),
                                       F.try_to_timestamp(c.cast("string")).cast("date"))
        elif isinstance(f.dataType, (T.DecimalType, T.IntegerType)):
            num = F.regexp_replace(c.cast("string"), "[$€£,]", "")
            casts[f.name] = num.try_cast(f.dataType) if isinstance(f.dataType, T.DecimalType) else \
                num.try_cast("double").try_cast("int")
        else:
            casts[f.name] = c.cast(f.dataType)
    return df.withColumns(casts) if casts else df


def read_sales_csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """Header CSV scan; aliases renamed, then typed with the raw schema.

    Columns are read as strings (no schema inference pass over the data)
    and cast after renaming, so aliased headers get the right types.
    """
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    df = standardize_columns(df)
    return apply_raw_types(df) if typed else df


def read_sales_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A01 (columnar variant): Parquet keeps types, pushes filters and prunes columns."""
    return standardize_columns(spark.read.parquet(path))


def load_first_valid(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame:
    """The first source that has all 15 canonical columns.

    Only if no source is complete, the first one with at least 10 is accepted
    with its columns as they are (later steps are guarded by column presence).
    """
    errors, partial = [], None
    for p in paths:
        try:
            df = read_sales_csv(spark, p) if fmt == "csv" else read_sales_parquet(spark, p)
        except Exception as e:  # noqa: BLE001 - unreadable source: try the next one
            errors.append(f"{p}: {type(e).__name__}")
            continue
        complete, missing = validate_schema(df)
        if complete:
            return df
        if partial is None and schema_coverage(df) >= MIN_SCHEMA_COVERAGE:
            partial = df
        errors.append(f"{p}: without {', '.join(missing)}")
    if partial is not None:
        return partial
    raise ValueError("no usable sales source: " + "; ".join(errors))


def profile(df: DataFrame) -> DataFrame:
    """One-row dataset profile: one aggregate, and one narrow pass for each distinct
    count, which reads the counted column only (Spark leaves out left joins that a
    column's distinct values do not need)."""
    aggs = [F.count(F.lit(1)).alias("Rows"), F.lit(len(df.columns)).alias("Columns"),
            sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0)).cast("long")
            .alias("Total_Nulls")]
    if "Order_Date" in df.columns:
        aggs += [F.min("Order_Date").alias("Date_Start"), F.max("Order_Date").alias("Date_End")]
    if "Sales" in df.columns:
        aggs.append(F.sum("Sales").cast("double").alias("Total_Sales"))
    if "Profit" in df.columns:
        aggs.append(F.sum("Profit").cast("double").alias("Total_Profit"))
    out = df.agg(*aggs)
    for c, name in (("Customer_ID", "Unique_Customers"), ("Product_Name", "Unique_Products")):
        if c in df.columns:
            out = attach_row(out, df.select(c).distinct().agg(F.count(c).alias(name)))
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """(Column, Type, Nulls) per column, from one aggregate."""
    nulls = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    arr = F.array(*[F.struct(F.lit(i).alias("Position"), F.lit(c).alias("Column"),
                             F.lit(t).alias("Type"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("Nulls"))
                    for i, (c, t) in enumerate(df.dtypes)])
    return nulls.select(F.inline(arr))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV sink (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


write_raw = write_csv
export_full = write_csv
write_forecast = write_csv


#: Partition values (years) a task writes side by side; a task with more sorts the rest (fixed value).
OPEN_FILES = 16


@contextmanager
def _open_files(spark: SparkSession, n: int):
    """Let a task keep ``n`` partitions' files open, instead of sorting (and spilling) all its rows first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    old = spark.conf.get(key, None)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def write_processed(df: DataFrame, path: str, partition_by: str | None = "Year", rebalance: bool = False) -> None:
    """Features as Parquet partitioned by Year (partition pruning for year filters).

    By default each task writes its rows straight into one file per year it
    holds: no extra shuffle, files of about (split size / years). With few
    partition values that is the cheaper layout at scale. ``rebalance=True``
    adds Spark's REBALANCE on the partition column so AQE sizes the files
    (splitting hot years, merging small ones) at the cost of one shuffle of
    the table - worth it when the partition column has many values.
    """
    if rebalance and partition_by and partition_by in df.columns:
        df = df.hint("rebalance", partition_by)
    w = df.write.mode("overwrite")
    if not (partition_by and partition_by in df.columns):
        w.parquet(path)
        return
    with _open_files(df.sparkSession, OPEN_FILES):
        w.partitionBy(partition_by).parquet(path)


def orders_table(df: DataFrame) -> DataFrame:
    """Projection to the 30 known columns that exist, in their order."""
    return df.select(*[c for c in ORDERS_TABLE_COLUMNS if c in df.columns])


def save_orders_table(df: DataFrame, path: str | None = None, view: str = "orders") -> DataFrame:
    """Replace the orders table (Parquet when a path is given) and register the view."""
    t = orders_table(df)
    if path:
        t.write.mode("overwrite").parquet(path)
        t = df.sparkSession.read.parquet(path)
    t.createOrReplaceTempView(view)
    return t


def run_sql(spark: SparkSession, query: str, params: list | dict | None = None) -> DataFrame:
    """A10: parametrised Spark SQL (positional ``?`` or named ``:name`` markers)."""
    return spark.sql(query, args=params) if params else spark.sql(query)


def preview(df: DataFrame, n: int = 100, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in a defined order (top-k plan, no global sort)."""
    return df.orderBy(*(order or df.columns)).limit(n)


def write_metrics(df: DataFrame, path: str) -> None:
    """One-row metrics frame as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model."""
    model.write().overwrite().save(path)


def write_text_report(lines: DataFrame, path: str, text_col: str = "Text", order_col: str = "Line_No") -> None:
    """An ordered report (a small table of lines) as one text file."""
    lines.orderBy(order_col).select(F.col(text_col).cast("string")).coalesce(1).write.mode("overwrite").text(path)
