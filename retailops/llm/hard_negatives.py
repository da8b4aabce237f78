"""Operator 11: hard negatives by exact integer scores from residue matrix products.

Components are quantised to integers, so a score is an integer inner product. It
is computed in a residue number system: both sides are taken modulo several small
primes as balanced residues, multiplied in float32 (each product of a block of
columns stays below 2^24, where float32 holds every integer), reduced, and put
together by Chinese remaindering in balanced mixed radix, which gives the sign as
well. The number of primes follows from the largest squared length: no score can
exceed it (Cauchy-Schwarz).

Plan: vectors are packed into blocks of rows (one Parquet row each, in the shared
folder), anchors into blocks of their own. The anchors are the stated query set;
each block of anchors meets each block of rows, so the pairs that Spark handles
are pairs of blocks, and a label or a vector held by a third of all rows changes
nothing. Pass one keeps each anchor's best rows of its label, pass two, knowing
the positives' scores, the best rows of other labels inside each score window. A
task keeps the best few of an anchor over all its blocks and emits those; a
window over (anchor) ranks them, with Spark's partial group limit before the
shuffle.

Bounds: a task holds one partition of anchor blocks (bounded by the scan's split
size), one block of rows and one matrix of ANCHORS x ROWS scores. Work is anchors
times rows, as a full search needs.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part. Vectors of unequal lengths: missing components count as
zero. A null id is never an anchor and comes after every other id among ties.
Repeated rows each count: a repeated anchor has results of its own, and its twin
is one of its other rows; equal scores and ids may then appear twice. A positive
whose score is negative has no row in its window. A vector whose squared integer
length reaches 2^56 raises ValueError, as its scores could leave the exact range.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a packed block of vectors, and of anchors.
ROWS, ANCHORS = 2048, 512
#: Scores stay below this, so that 100 of them still fit a 64-bit integer.
LIMIT = 1 << 56
#: No score: below every real one.
NONE = np.iinfo(np.int64).min
_EXACT = 1 << 24  # float32 holds every integer up to here
_PACKED = "n int, dim int, top bigint, ids binary, noid binary, labels binary, parts binary"


# ---- residue arithmetic

def primes_for(bound: int, largest: int = 251) -> list[int]:
    """Odd primes from ``largest`` down whose product covers -bound .. bound."""
    out, product = [], 1
    for p in range(largest, 2, -2):
        if all(p % q for q in range(3, int(p ** 0.5) + 1, 2)):
            out.append(p)
            product *= p
            if product > 2 * bound + 1:
                return out
    raise ValueError(f"no prime set covers {bound}")


def balanced(values: np.ndarray, p: int) -> np.ndarray:
    """Residues in -(p-1)/2 .. (p-1)/2 of exact float32 integers."""
    values = values - np.float32(p) * np.rint(values * np.float32(1 / p))
    return values - np.float32(p) * np.rint(values * np.float32(1 / p))  # the first quotient may be off by one


def residues(parts: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The integer matrix modulo each prime, as balanced float32."""
    return [((r := np.mod(parts, p)) - p * (r > p // 2)).astype(np.float32) for p in primes]


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact int64 inner products [left rows, right rows] from both sides' residues."""
    digits: list[np.ndarray] = []
    for j, p in enumerate(primes):
        step = _EXACT // ((p - 1) // 2) ** 2  # columns whose products sum to below 2^24
        value = np.zeros((len(left[j]), len(right[j])), np.float32)
        for at in range(0, left[j].shape[1], step):
            value = balanced(value + balanced(left[j][:, at:at + step] @ right[j][:, at:at + step].T, p), p)
        for q, digit in zip(primes, digits):  # mixed radix: take off the lower digit, divide by its prime
            value = balanced((value - digit) * np.float32(pow(q, -1, p)), p)
        digits.append(value)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        out *= p
        out += digit.astype(np.int64)
    return out


# ---- packed blocks

def _pack(rows: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                b = b.filter(pc.and_(b.column("label").is_valid(), b.column("vector").is_valid()))
                ids = b.column("id")
                sizes = pc.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(b.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                owner = np.repeat(np.arange(len(sizes)), sizes)
                bad = np.zeros(len(sizes), bool)
                bad[owner[~np.isfinite(flat)]] = True
                with np.errstate(over="ignore", invalid="ignore"):
                    flat = np.floor(scale * flat)
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
                parts = np.zeros((len(sizes), int(sizes.max(initial=0))))
                parts[owner, np.arange(len(flat)) - first[owner]] = flat
                noid = ids.is_null().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((number, noid))
                order = order[~bad[order]]  # by id, null ids last
                if not len(order):
                    continue
                parts = parts[order]
                top = (parts * parts).sum(axis=1).max(initial=0)
                if top >= LIMIT:
                    raise ValueError("a vector is too long for exact integer scores")
                labels = b.column("label").to_numpy(zero_copy_only=False)[order]
                wide = np.int64 if np.abs(parts).max(initial=0) > 32767 else np.int16
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(order)], pa.int32()), pa.array([parts.shape[1]], pa.int32()),
                     pa.array([int(top) + int(top) // 1000 + 1], pa.int64()),
                     pa.array([number[order].astype(np.int64).tobytes()], pa.binary()), pa.array([noid[order].tobytes()], pa.binary()),
                     pa.array([labels.astype(np.int64).tobytes()], pa.binary()), pa.array([parts.astype(wide).tobytes()], pa.binary())],
                    names=["n", "dim", "top", "ids", "noid", "labels", "parts"])
    return run


class Block:
    """A packed block as arrays, with its residues."""

    def __init__(self, row: dict, prefix: str, primes: list[int]):
        n, dim = row[f"{prefix}n"], row[f"{prefix}dim"]
        self.ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
        self.noid = np.frombuffer(row[f"{prefix}noid"], bool)
        self.labels = np.frombuffer(row[f"{prefix}labels"], np.int64)
        raw = row[f"{prefix}parts"]
        kind = np.int64 if dim and len(raw) == 8 * n * dim else np.int16
        parts = np.frombuffer(raw, kind).astype(np.int64).reshape(n, dim)
        self.length2 = (parts * parts).sum(axis=1)
        self.residues = residues(parts, primes)

    def against(self, other: "Block", rows: np.ndarray, cols: np.ndarray, primes: list[int]) -> np.ndarray:
        """Scores of some of these rows and some of the other's; the shorter vectors are filled by zeros."""
        dim = min(self.residues[0].shape[1], other.residues[0].shape[1])
        return scores([r[rows, :dim] for r in self.residues], [r[cols, :dim] for r in other.residues], primes)


class Best:
    """The best k (score, id) of each of m lists, over all the blocks of a task."""

    def __init__(self, m: int, k: int):
        self.score = np.full((m, k), NONE, np.int64)
        self.ids = np.zeros((m, k), np.int64)
        self.noid = np.zeros((m, k), bool)

    def add(self, lists: np.ndarray, found: np.ndarray, block: Block, cols: np.ndarray) -> None:
        """Merge ``found`` [len(lists), len(cols)] (NONE: not a candidate; columns
        in id order), which is overwritten."""
        k = self.score.shape[1]
        take = np.flatnonzero(found.max(axis=1, initial=NONE) >= np.maximum(self.score[lists, -1], NONE + 1))
        if not len(take):
            return
        found, lists = found[take], lists[take]
        at, line = [], np.arange(len(lists))
        new = np.full((len(lists), k), NONE, np.int64)
        for j in range(min(k, found.shape[1])):
            best = found.argmax(axis=1)  # the first of equal scores: the smallest id
            new[:, j] = found[line, best]
            found[line, best] = NONE
            at.append(best)
        where = cols[np.stack(at + [at[-1]] * (k - len(at)), axis=1)]
        score = np.concatenate([self.score[lists], new], axis=1)
        ids = np.concatenate([self.ids[lists], block.ids[where]], axis=1)
        noid = np.concatenate([self.noid[lists], block.noid[where]], axis=1)
        order = np.lexsort((ids, noid, np.where(score == NONE, np.iinfo(np.int64).max, -score)), axis=1)[:, :k]
        self.score[lists] = np.take_along_axis(score, order, 1)
        self.ids[lists] = np.take_along_axis(ids, order, 1)
        self.noid[lists] = np.take_along_axis(noid, order, 1)


def _pairs(batches: Iterator[pa.RecordBatch], primes: list[int]) -> Iterator[tuple[int, dict, Block, Block]]:
    """(anchor block number, row, rows, anchors) of each pair; the last block of either side is kept decoded."""
    rows, anchors, last_rows = None, {}, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            raw = (row["ids"], row["parts"], row["labels"])
            if raw != last_rows:
                rows, last_rows = Block(row, "", primes), raw
            key = row["block"]
            if key not in anchors:
                if len(anchors) >= 8:
                    anchors.clear()
                anchors[key] = Block(row, "a_", primes)
            yield key, row, rows, anchors[key]


def _positives(primes: list[int], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pass one: each anchor's best k + 1 rows of its label, itself among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[Best, np.ndarray, np.ndarray]] = {}
        for key, _, rows, anchors in _pairs(batches, primes):
            if key not in best:
                best[key] = (Best(len(anchors.ids), k + 1), anchors.ids, anchors.length2)
            for label in np.intersect1d(anchors.labels, rows.labels):
                mine, cols = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
                best[key][0].add(mine, anchors.against(rows, mine, cols, primes), rows, cols)
        for key, (b, ids, length2) in best.items():
            pos, at = np.nonzero(b.score != NONE)
            score, found, noid = b.score[pos, at], b.ids[pos, at], b.noid[pos, at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pos), key), pa.int64()), pa.array(pos, pa.int32()), pa.array(ids[pos], pa.int64()),
                 pa.array(found, pa.int64(), mask=noid), pa.array(score, pa.int64()),
                 pa.array((found == ids[pos]) & ~noid & (score == length2[pos]))],
                names=["block", "pos", "anchor_id", "row_id", "score", "own"])
    return run


def _negatives(primes: list[int], k: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pass two: the best k rows of other labels in the score window of each (anchor, positive)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[Best, np.ndarray, np.ndarray]] = {}
        for key, row, rows, anchors in _pairs(batches, primes):
            if key not in best:
                wanted = sorted((w["pos"], w["nth"], w["score"]) for w in row["wanted"])
                pos, nth, score = (np.array(x, np.int64) for x in zip(*wanted))
                best[key] = (Best(len(pos), k), np.stack([pos, nth]), score)
            b, (pos, nth), score = best[key]
            least, most = -(-low * score // 100), high * score // 100
            lines, line_of = np.unique(pos, return_inverse=True)
            cols = np.arange(len(rows.ids))
            found = anchors.against(rows, lines, cols, primes)
            found[anchors.labels[lines][:, None] == rows.labels[None, :]] = NONE
            for n in np.unique(nth):  # one positive of every anchor at a time
                some = np.flatnonzero(nth == n)
                mine = found[line_of[some]]
                mine[(mine < least[some, None]) | (mine > most[some, None])] = NONE
                b.add(some, mine, rows, cols)
        for key, (b, (pos, nth), _) in best.items():
            line, at = np.nonzero(b.score != NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(line), key), pa.int64()), pa.array(pos[line], pa.int32()), pa.array(nth[line], pa.int32()),
                 pa.array(b.ids[line, at], pa.int64(), mask=b.noid[line, at]), pa.array(b.score[line, at], pa.int64())],
                names=["block", "pos", "nth", "row_id", "score"])
    return run


def mine(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: str = "anchor",
         scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a boolean column that marks the query set. A positive is one of
    an anchor's first ``positives`` other rows of its label by score; a negative
    has another label and a score of ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                            F.col(label).cast("long").alias("label"), F.col(anchor).alias("anchor"))
    rows = stored(source.drop("anchor").mapInArrow(_pack(ROWS, scale), _PACKED), "vector-blocks")
    queries = source.where(F.col("anchor") & F.col("id").isNotNull()).drop("anchor")
    anchors = stored(queries.mapInArrow(_pack(ANCHORS, scale), _PACKED)
                     .select(F.monotonically_increasing_id().alias("block"), *[F.col(c).alias(f"a_{c}") for c in ("n", "dim", "ids", "noid", "labels", "parts")]),
                     "anchor-blocks")
    bound = rows.agg(F.max("top")).first()[0]  # one number
    primes = primes_for(bound or 1)
    rows = rows.drop("top")

    ahead = ["block", "pos"]
    by_score = [F.col("score").desc(), F.col("row_id").asc_nulls_last()]
    found = rows.crossJoin(anchors).mapInArrow(_positives(primes, positives),
                                               "block bigint, pos int, anchor_id bigint, row_id bigint, score bigint, own boolean")
    place = F.row_number().over(Window.partitionBy(*ahead).orderBy(*by_score, F.col("own").desc()))
    found = found.withColumn("place", place).where(F.col("place") <= positives + 1)
    # the anchor itself is the first of the rows with its id and its own squared length
    self_at = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy(*ahead))
    nth = F.col("place") - F.when(F.col("place") > F.col("self_at"), 1).otherwise(0)
    chosen = stored(found.withColumn("self_at", self_at).where("self_at IS NULL OR place <> self_at").withColumn("nth", nth)
                    .where(F.col("nth") <= positives).select(*ahead, "nth", "anchor_id", F.col("row_id").alias("positive_id"), "score"),
                    "positives")

    wanted = chosen.where("score >= 0").groupBy("block").agg(F.collect_list(F.struct("pos", "nth", "score")).alias("wanted"))  # at most ANCHORS x positives
    asked = stored(anchors.join(wanted, "block"), "anchor-windows")
    near = rows.crossJoin(asked).mapInArrow(_negatives(primes, negatives, low, high),
                                            "block bigint, pos int, nth int, row_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("block", "pos", "nth").orderBy(*by_score))
    near = near.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return (near.select("block", "pos", "nth", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(chosen.withColumnRenamed("score", "positive_score"), ["block", "pos", "nth"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: The query's rows in DuckDB SQL: plain inner products of all pairs.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
      AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
