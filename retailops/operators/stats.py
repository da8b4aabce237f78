"""Distributed statistics primitives.

* exact quantiles (linear interpolation, as pandas/DuckDB ``quantile_cont``)
  as a one-row DataFrame that is broadcast (its size is one row) to the rows
  that need it, selected by histograms of the values' bits - no value is
  shuffled, and only the quantiles themselves come to the driver;
* quantile binning (``qcut``) from those edges;
* global row numbers without a window over the rows: range partitioning, sorted
  partitions, per-partition counts (one row per partition), prefix offsets;
* forward fill in a global order with the same partition-offset carry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- quantiles ---------------------------------------------------------------

def quantile_row(df: DataFrame, specs: dict[str, tuple[str | Column, list[float]]],
                 strategy: str = "select") -> DataFrame:
    """One row: for each name, the array of exact quantiles (linear interpolation) of a column.

    ``specs = {"edges": ("Customer_Total_Spent", [.25, .5, .75])}``; nulls are ignored.

    * ``select`` (default): distributed exact quantiles (``quantiles_by_selection``);
      no value is shuffled.
    * ``map``: Spark's exact ``percentile``, whose final merge is one task with an
      entry for each distinct value. Only for callers whose rows are bounded by
      the calendar (one row a day), which choose it themselves.
    """
    if strategy == "map":
        return df.agg(*[F.percentile(_c(col).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(n)
                        for n, (col, probs) in specs.items()])
    return quantiles_by_selection(df, specs)


#: Bits of a value's key that one selection pass resolves.
_STEP = 21
#: Histogram entries a task holds before it combines them.
_ENTRIES = 1 << 20


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """The bits of doubles as int64 that sort like the values (nan last, -0.0 as 0.0).

    Spark has no cast from a double to its bits; numpy views them for free.
    """
    bits = (v + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _combine(entries: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    bucket, count, least, most = (np.concatenate(x) for x in zip(*entries))
    keys, at = np.unique(bucket, return_inverse=True)
    total, low, high = np.zeros(len(keys), np.int64), np.full(len(keys), np.inf), np.full(len(keys), -np.inf)
    np.add.at(total, at, count)
    np.fmin.at(low, at, least)
    np.fmax.at(high, at, most)
    nan = np.zeros(len(keys), bool)
    nan[at[np.isnan(most)]] = True
    return keys, total, np.where(nan & np.isinf(low), np.nan, low), np.where(nan, np.nan, high)


def _histogram(df: DataFrame, columns: list[Column], shift: int, within: dict[int, list[int]] | None = None) -> DataFrame:
    """Counts (``_name``: column number, ``_b``: key bits above ``shift``, ``_c``, the least and
    most value) of the non-null values, each task's own first. ``within`` keeps, of
    each column, the values whose bits one step higher are listed."""
    names = [f"v{i}" for i in range(len(columns))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[int, list] = {i: [] for i in range(len(names))}
        held = 0
        for batch in batches:
            for i, name in enumerate(names):
                v = batch.column(name).drop_null().to_numpy(zero_copy_only=False)
                bucket = ordered_bits(v) >> shift
                if within is not None:
                    keep = np.isin(bucket >> _STEP, np.array(within.get(i, []), np.int64))
                    v, bucket = v[keep], bucket[keep]
                if len(v):
                    entries[i].append(_combine([(bucket, np.ones(len(v), np.int64), v, v)]))
                    held += len(entries[i][-1][0])
            if held > _ENTRIES:
                entries = {i: [_combine(e)] if e else [] for i, e in entries.items()}
                held = sum(len(x[0]) for e in entries.values() for x in e)
                if held > _ENTRIES // 2:  # many buckets: hand them to the shuffle
                    yield from emit(entries)
                    entries, held = {i: [] for i in entries}, 0
        yield from emit(entries)

    def emit(entries: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for i, e in entries.items():
            if e:
                keys, total, low, high = _combine(e)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i), pa.int32()), pa.array(keys), pa.array(total), pa.array(low),
                                                  pa.array(high)], names=["_name", "_b", "_c", "_least", "_most"])

    rows = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names)])
    parts = rows.mapInArrow(count, "_name int, _b bigint, _c bigint, _least double, _most double")
    return parts.groupBy("_name", "_b").agg(F.sum("_c").alias("_c"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))


def _literal_rows(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small frame of constants, planned without a scan."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])))


def quantiles_by_selection(df: DataFrame, specs: dict[str, tuple[str | Column, list[float]]]) -> DataFrame:
    """Exact quantiles of several columns by iterated histogram selection.

    Values are never shuffled or sorted. A value's key (``ordered_bits``) is
    resolved 21 to 22 bits at a time: pass one counts all values by the key's
    leading bits (each task its own first; at most 2^22 counts a column and in
    practice some thousands) and finds the bucket of each target rank; the next
    passes count only the values inside those buckets by the next bits. It ends as
    soon as each target's bucket holds one value, at the latest after pass three
    (two for money of usual size). Only the targets of a pass, two for each
    quantile, come to the driver. The ranks floor(h) and ceil(h), h = (n-1)p, are
    interpolated as (ceil-h)*lo + (h-floor)*hi.
    """
    spark = df.sparkSession
    columns = [_c(col) for col, _ in specs.values()]

    def counted(hist: DataFrame, keys: list[str]) -> DataFrame:
        """The histogram with the number of values in front, inside each group of ``keys``."""
        group = Window.partitionBy(*keys)
        before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return hist.withColumns({"_start": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_n": F.sum("_c").over(group)})

    hit = (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_c"))
    found = ["_name", "_j", "_tag", "_b", (F.col("_r") - F.col("_start")).alias("_r"), "_least", "_most"]
    wanted = _literal_rows(spark, ["_name", "_j", "_q"],
                           [(i, j, float(q)) for i, (_, probs) in enumerate(specs.values()) for j, q in enumerate(probs)])
    h = (F.col("_n") - 1).cast("double") * F.col("_q")
    ranks = F.array(F.struct(F.lit(0).alias("_tag"), F.floor(h).alias("_r")), F.struct(F.lit(1).alias("_tag"), F.ceil(h).alias("_r")))
    cum = counted(_histogram(df, columns, 2 * _STEP), ["_name"])
    targets = cum.join(F.broadcast(wanted), "_name").select("*", F.inline(ranks)).filter(hit).select(*found, "_n").collect()
    sizes = {t["_name"]: t["_n"] for t in targets}
    done = {}
    for shift in (_STEP, 0, None):
        done.update({(t["_name"], t["_j"], t["_tag"]): t["_most"] for t in targets if t["_least"] == t["_most"] or shift is None})
        open_ = [t for t in targets if (t["_name"], t["_j"], t["_tag"]) not in done]
        if not open_:
            break
        within: dict[int, list[int]] = {}
        for t in open_:
            within.setdefault(t["_name"], []).append(t["_b"])
        seek = _literal_rows(spark, ["_name", "_p", "_j", "_tag", "_r"], [(t["_name"], t["_b"], t["_j"], t["_tag"], t["_r"]) for t in open_])
        hist = _histogram(df, columns, shift, within).withColumn("_p", F.shiftright("_b", _STEP))
        cum = counted(hist, ["_name", "_p"])
        targets = cum.join(F.broadcast(seek), ["_name", "_p"]).filter(hit).select(*found).collect()

    def value(i: int, j: int, q: float) -> float:
        h = (sizes[i] - 1) * float(q)
        lo, hi = math.floor(h), math.ceil(h)
        return done[i, j, 0] if lo == hi else (hi - h) * done[i, j, 0] + (h - lo) * done[i, j, 1]

    return spark.range(1).select(*[
        (F.array(*[F.lit(value(i, j, q)) for j, q in enumerate(probs)]) if i in sizes else F.lit(None).cast("array<double>")).alias(name)
        for i, (name, (_, probs)) in enumerate(specs.items())])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame to every row (broadcast, size 1)."""
    return df.crossJoin(F.broadcast(one_row))


def qcut_index(value: str | Column, edges: str | Column) -> Column:
    """1-based quantile bin: 1 + number of inner edges strictly below the value.

    Equals right-closed bins with the lowest edge included. Null -> null.
    ``edges`` holds the q-1 inner quantiles.
    """
    v = _c(value).cast("double")
    return F.when(v.isNotNull(), F.lit(1) + F.size(F.filter(_c(edges), lambda e: e < v)))


def qcut(df: DataFrame, value_col: str, q: int, out_col: str,
         labels: list | None = None, key_filter: Column | None = None) -> DataFrame:
    """pandas-style ``qcut`` of ``value_col`` into ``q`` equal-frequency bins.

    Edges are exact quantiles over the rows of ``df`` (optionally only rows
    passing ``key_filter``); labels map bin i to labels[i-1].
    """
    probs = [i / q for i in range(1, q)]
    src = df if key_filter is None else df.filter(key_filter)
    edges = quantile_row(src, {"_qedges": (value_col, probs)})
    idx = qcut_index(value_col, "_qedges")
    if labels is not None:
        lab = F.element_at(F.array(*[F.lit(x) for x in labels]), idx.cast("int"))
        out = F.when(idx.isNotNull(), lab)
    else:
        out = idx.cast("int")
    return attach_row(df, edges).withColumn(out_col, out).drop("_qedges")


# --- global ordering without a single-partition window ----------------------

def _by_range(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """Range partitioning on ``order``: ``n`` partitions when given, otherwise
    sized at runtime - up to ``spark.sql.shuffle.partitions``, coalesced by AQE.
    Coalescing merges adjacent ranges only, so partition ids still follow the
    global order.
    """
    return df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)


#: monotonically_increasing_id: partition number above, position in the partition below.
_POSITION_BITS = 33


def _sorted_parts(df: DataFrame, order: list, num_partitions: int | None) -> DataFrame:
    """Rows range partitioned and sorted on ``order``, with ``_pid`` and the 0-based
    ``_at`` inside the partition, written to the shared checkpoint folder so that
    the partition contents are stable. One shuffle of the rows; nothing downstream
    has to group them by partition again."""
    rows = _by_range(df, order, num_partitions).sortWithinPartitions(*order)
    rows = reliable_checkpoint(rows.withColumn("_mid", F.monotonically_increasing_id()))
    return rows.withColumns({"_pid": F.shiftright("_mid", _POSITION_BITS),
                             "_at": F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))}).drop("_mid")


def global_row_number(df: DataFrame, order: list[Column], out_col: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number in a total order, computed across partitions.

    ``order`` must be a total order (end it with a unique key). The rows are
    range partitioned on it (ties of the leading columns are split by the
    unique key, so a hot value spreads over partitions) and sorted inside each
    partition; a row's number is its position there plus the sizes of the
    partitions before, which are one row each and broadcast.
    """
    rows = _sorted_parts(df, order, num_partitions)
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (rows.join(F.broadcast(offsets), "_pid")
                .withColumn(out_col, (F.col("_off") + F.col("_at") + 1).cast("long"))
                .drop("_pid", "_off", "_at"))


def rank_score(df: DataFrame, value_col: str, tie_col: str, q: int, out_col: str,
               descending_labels: bool = False) -> DataFrame:
    """qcut of the 'first'-method rank into ``q`` bins.

    r = position in (value, tie_col) order, n = rows. With edges
    1 + (n-1)k/q the bin is max(1, ceil((r-1)q/(n-1))), computed with exact
    integer arithmetic; n = 1 gives 1. ``descending_labels`` maps bin b to
    q+1-b.
    """
    ranked = global_row_number(df, [F.col(value_col).asc_nulls_first(), F.col(tie_col).asc()], "_r")
    n = ranked.agg(F.max("_r").alias("_n"))  # reads the checkpointed frame, not the upstream plan
    bin_ = F.greatest(F.lit(1), F.coalesce(int_ceil((F.col("_r") - 1) * q, F.col("_n") - 1), F.lit(1)))
    score = (F.lit(q + 1) - bin_) if descending_labels else bin_
    return attach_row(ranked, n).withColumn(out_col, score.cast("int")).drop("_r", "_n")


def int_ceil(a: Column, b: Column) -> Column:
    """ceil(a / b) for a >= 0, b > 0 with exact long arithmetic; b <= 0 -> null."""
    a = a.cast("long")
    b = b.cast("long")
    t = a + b - 1
    return F.when(b > 0, ((t - F.pmod(t, b)) / b).cast("long"))


# --- forward fill -------------------------------------------------------------

def ffill(df: DataFrame, cols: list[str], order_cols: list[str],
          num_partitions: int | None = None) -> DataFrame:
    """Replace nulls by the last non-null value above in an ascending total order.

    Leading nulls stay null. No window over the rows: they are range partitioned
    and sorted on ``order_cols`` once; each partition reports its last non-null
    value per column (one row per partition), a prefix over those rows gives the
    carry-in, and each partition is filled batch by batch as it streams.
    """
    rows = _sorted_parts(df, [F.col(c) for c in order_cols], num_partitions)
    tails = rows.groupBy("_pid").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_tail_{c}") for c in cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_pid", *[F.last(f"_tail_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}")
                                   for c in cols])
    out = rows.join(F.broadcast(carry), "_pid").drop("_pid", "_at")  # map-side: rows keep their order

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, pa.Scalar] = {}
        for b in batches:
            if not b.num_rows:
                continue
            filled = {}
            for c in cols:
                value = pc.fill_null_forward(b.column(c))
                carried = last.get(c, b.column(f"_carry_{c}")[0])
                filled[c] = value.fill_null(carried) if carried.is_valid else value
                last[c] = filled[c][-1]
            yield pa.RecordBatch.from_arrays([filled.get(c, b.column(c)) for c in names], names=names)

    names = df.columns
    return out.mapInArrow(fill, df.schema)
