"""Helpers that every operator here shares: table reads, hash folds, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailops.session import scratch_folder

#: Rows turned into Python objects at a time inside a task.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, with only the columns an operator reads."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(buckets))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names starting with each stem that the frame does not have yet."""
    have, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in have:
            n += 1
            name = f"{stem}_{n}"
        have.add(name.lower())
        out.append(name)
    return out


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path for a written table, under the shared checkpoint folder; it goes when the driver ends."""
    return f"{scratch_folder(spark, label)}/table"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage ends there,
    so a lost executor costs no recomputation and later passes see the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut incoming Arrow batches so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def per_text(make: Callable[[], Callable[[list], list[pa.Array]]], names: list[str], keep: list[str],
             text: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: ``make()`` runs once in each task and gives a
    function from a list of texts (null: empty) to the arrays named ``names``;
    the columns ``keep`` pass through in front."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in slices(batches):
            texts = [t or "" for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + fn(texts), names=[*keep, *names])
    return run
