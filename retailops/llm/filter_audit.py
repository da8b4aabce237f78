"""Operator 13: audit of how filters interact, by path counting in the subset lattice.

A document is reduced to the set of filters it fails (a bit mask). What any order
of the filters removes depends only on how many documents of a part hold each
mask, so the documents are read once and the rest works on at most 2^n counts of
a part. A state of the lattice is the set of filters applied so far; its edges
add one filter, and an edge's removal is the number of documents that pass the
state and fail that filter. Forward counts (orders that reach a state) and
backward counts (orders that leave it for the full set) weight the edges'
removals: their sum over the edges of a filter is its Shapley total over all
orders. The rows of a single order read the same edges along its path.

Copies (filter E of the query) are found on 128-bit hashes of the texts: the
smallest doc_id of each hash is a partial aggregate, so a text held by a third of
the rows is one row for each task; the join back has the doc_id in its key.

Defined results: a null text is an empty text (it fails A; no words, so not B;
equal to every other empty text). A null doc_id counts as larger than every other;
rows that share the smallest doc_id of a text (repeated rows, null ids alone) have
no smaller one and pass E. Repeated rows count each. A document is good (toxic)
when any of its label rows says so; null doc_ids have no labels. A null part is
the empty string and shares it with real empty strings. An empty table gives no
rows. Only the named columns are read; others may be there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

LETTERS = "ABCDE"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes, chars: int) -> int:
    """Bits 0-3: fails A (few words), B (repeated words), C (capitals), D (marks).
    ``bytes.split`` parts at exactly the six bytes \\x20 and \\x09-\\x0D."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * upper > 10 * chars) << 2
            | (_MARKS.search(text) is not None) << 3)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"),
             pa.array([text_mask(r, len(t)) for r, t in zip(raw, texts)], pa.int32()),
             pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())],
            names=["doc_id", "part", "mask", "h"])


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits A-E of failed filters), good, toxic of every document."""
    rows = stored(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
                  .mapInArrow(_digest, "doc_id bigint, part string, mask int, h binary"), "filter-masks")
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first")).withColumnRenamed("h", "first_h")
    marked = rows.join(first, (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    mask = F.col("mask").bitwiseOR(F.when(F.col("first_h").isNull(), 16).otherwise(0))
    marks = (labels.groupBy(F.col("doc_id").cast("long").alias("label_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    return (marked.withColumn("mask", mask).join(marks, F.col("doc_id") == F.col("label_id"), "left")
            .select("doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
                    F.coalesce("toxic", F.lit(False)).alias("toxic")))


class Lattice:
    """Path counts of the subset lattice of n filters, and removals on its edges.

    States are bit masks. ``forward[s]``: ways to apply the filters of s one by
    one; ``backward[s]``: ways to apply the others after them.
    """

    def __init__(self, n: int):
        self.n, self.size = n, 1 << n
        self.forward = np.zeros(self.size, np.int64)
        self.backward = np.zeros(self.size, np.int64)
        self.forward[0] = self.backward[-1] = 1
        for s in range(self.size):
            for f in range(n):
                if not s >> f & 1:
                    self.forward[s | 1 << f] += self.forward[s]
        for s in reversed(range(self.size)):
            for f in range(n):
                if not s >> f & 1:
                    self.backward[s] += self.backward[s | 1 << f]
        states, f = np.arange(self.size)[:, None], np.arange(n)
        #: The state each edge leads to (itself where the filter is applied already).
        self.after = states | 1 << f
        self.edge = self.after != states

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Documents that pass every filter of a state, from the counts by mask:
        sums over the subsets of the state's complement."""
        below = counts.astype(np.int64).copy()
        for f in range(self.n):
            have = np.arange(self.size) >> f & 1 == 1
            below[have] += below[np.flatnonzero(have) ^ 1 << f]
        return below[::-1].copy()  # the complement of s is size - 1 - s

    def removed(self, kept: np.ndarray) -> np.ndarray:
        """[state, filter]: documents an edge removes."""
        return np.where(self.edge, kept[:, None] - kept[self.after], 0)

    def shapley(self, removed: np.ndarray) -> np.ndarray:
        """Each filter's removals summed over all orders: every edge counts as
        often as orders run through it."""
        return (self.forward[:, None] * self.backward[self.after] * removed).sum(axis=0)


RESULT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
                       T.StructField("step", T.IntegerType())]
                      + [T.StructField(c, T.LongType()) for c in
                         ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def _audit_part(letters: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    n = len(letters)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lattice = Lattice(n)
        masks = rows["mask"].to_numpy()

        def kept(weights: np.ndarray) -> np.ndarray:
            counts = np.zeros(lattice.size, np.int64)
            np.add.at(counts, masks, weights)
            return lattice.kept(counts)

        weights = rows["n"].to_numpy(np.int64)
        all_kept = kept(weights)
        gone = lattice.removed(all_kept)
        good = lattice.removed(kept(weights * rows["good"].to_numpy(bool)))
        toxic = lattice.removed(kept(weights * rows["toxic"].to_numpy(bool)))
        shapley = lattice.shapley(gone)
        only = [int(weights[masks == 1 << f].sum()) for f in range(n)]
        out = []
        for order in permutations(range(n)):
            name, s = "".join(letters[f] for f in order), 0
            for step, f in enumerate(order, 1):
                out.append((key[0], name, step, all_kept[s | 1 << f], gone[s, f], gone[0, f] - gone[s, f], only[f],
                            good[s, f], toxic[s, f], shapley[f]))
                s |= 1 << f
        return pd.DataFrame(out, columns=RESULT.fieldNames())
    return run


def audit_orders(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``document_masks``.

    The counts by (part, mask, flags) are a partial aggregate; a part's lattice
    gets at most 4 * 2^n of them.
    """
    counts = masks.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("part").applyInPandas(_audit_part(letters), RESULT)


#: The same counts in DuckDB SQL, order by order instead of by path counts.
ORACLE_SQL = r"""
WITH marks AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)::INT) AS good, max(coalesce(toxic = 1, FALSE)::INT) AS toxic
               FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                 [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
                 + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
          FROM texts LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
           AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
          FROM orders, range(1, 6) s(step)),
rows AS (SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
         FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM rows
"""
