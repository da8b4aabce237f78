"""SimHash near-duplicates (operator 9), compared bit-sliced.

Fingerprint: A-Z lower-cased; words are runs of non-white-space (ASCII white
space); every run of ``width`` words, repeats included, is hashed with XXH64
(seed 42) over its words joined by one space; a bit is 1 if it is set in more
than half of the hashes. A text with fewer words has the whole sequence as its
one shingle; a text with none has fingerprint zero, which links like any other.

Pairs within ``radius`` bits: equal fingerprints are one node from the start.
The 64 bits are cut into radius + 2 blocks, so two fingerprints within the
radius agree on at least two whole blocks; each fingerprint is keyed by every
pair of blocks (15 keys of about 21 bits at radius 4), which misses no pair.
Keys that only one fingerprint has are dropped. A key with more than ``tile``
fingerprints is dealt out in tiles: its fingerprints fall into chunks by hash,
and each pair of chunks is a task's unit, so no key gathers in one task.

In a unit the fingerprints are stored as bit planes. Distances of a block of
fingerprints to all others grow plane by plane in carry-save counters, 64
pairs to a machine word, and a block is abandoned once all its counters have
passed the radius. A unit returns a spanning forest of its links, not the
links themselves, so a group of copies never becomes all its pairs.

Components: large-star and small-star steps until nothing changes; each step
is written to shared storage.

Defined results: null text is empty; rows that repeat a doc_id each get their
own fingerprint and component; a null doc_id joins its component but is never
its name unless no other is there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, per_text, slices, stored

#: Fingerprints of a key that one unit compares; larger keys are dealt out.
TILE = 4_096
#: Keys under which a group's fingerprints meet the group's name.
SALTS = 16
_GROUP = 512   # small keys are gathered into units of about this many
_ROWS = 256    # fingerprints compared with a unit at a time
_STEP = 8      # planes between two looks at whether a block can be abandoned


def fingerprint(text: str, width: int = 4) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    lo, hi = start[:-width].tolist(), (start[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(lo)
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(lo, hi)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # long texts: few bits are unpacked at a time
        part = h[at:at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))]
    return make


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        per_text(_fingerprints(width), ["fp"], ["doc_id"]), f"doc_id {kind}, fp bigint")


def _blocks(radius: int) -> list[int]:
    """The masks of radius + 2 blocks of nearly equal width."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of bit planes, 64 fingerprints to a word; lanes beyond the last are zero."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(rows: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray | None:
    """Which of the ``n`` fingerprints in ``planes`` lie within the radius of each
    of ``rows``, as a boolean matrix; None if a whole block was abandoned."""
    shape = (len(rows), planes.shape[1])
    width = max(1, radius.bit_length())
    count = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)  # lanes that have passed the radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        carry = planes[b] ^ np.where(rows >> np.uint64(b) & np.uint64(1), ones, np.uint64(0))[:, None]
        for c in count:  # a counter of ``width`` bits in each lane
            new = c & carry
            c ^= carry
            carry = new
        over |= carry
        if b % _STEP == _STEP - 1:
            over |= _passed(count, radius)
            if (over == ones).all():
                return None
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return near


def _passed(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius: a bitwise comparison from the top bit."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            above |= equal & count[k]
            equal = equal & ~count[k]
    return above


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the radius connects: a spanning forest, (from, to)."""
    n = len(fps)
    planes = _planes(fps)
    near = np.zeros((n, n), bool)
    for at in range(0, n, _ROWS):
        got = within(fps[at:at + _ROWS], planes, n, radius)
        if got is not None:
            near[at:at + _ROWS] = got
    near[np.arange(n), np.arange(n)] = False
    todo = near.any(axis=1)  # not yet reached
    a, b = [], []
    while todo.any():
        seed = int(np.argmax(todo))
        todo[seed] = False
        edge = [seed]
        while edge:
            nxt = []
            for i in edge:
                new = np.flatnonzero(near[i] & todo)
                todo[new] = False
                a += [i] * len(new)
                nxt += new.tolist()
                b += new.tolist()
            edge = nxt
    return fps[a], fps[b]


def _compare(radius: int):
    """Rows (unit, fp), sorted by unit, to links (a, b)."""
    def solve(parts: list[np.ndarray]):
        fps = np.unique(np.concatenate(parts)).view(np.uint64)
        a, b = forest(fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # whole units, and at its end perhaps an open one
        size, open_unit = 0, None
        for batch in batches:
            units = batch.column("unit").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]])
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if units[lo] != open_unit and size >= _GROUP:
                    yield solve(held)
                    held, size = [], 0
                open_unit = units[lo]
                held.append(fps[lo:hi])
                size += hi - lo
        if held:
            yield solve(held)
    return run


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct
    fingerprints ``fp`` within ``radius`` bits."""
    masks = _blocks(radius)
    pairs = list(combinations(range(len(masks)), 2))
    keyed = distinct.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | masks[j]))).alias("v"))
        for k, (i, j) in enumerate(pairs)])).alias("key"), "fp").select("key.k", "key.v", "fp")
    shared = keyed.groupBy("k", "v").count().where("count > 1")
    keyed = keyed.join(shared, ["k", "v"])
    # a large key: chunk c goes to every pair of chunks that has c; a small one has chunk 0 only
    chunks = F.ceil(2 * F.col("count") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    units = (keyed.select("k", "v", "fp", F.when(F.col("count") <= tile, F.lit(1)).otherwise(chunks).alias("n"),
                          F.when(F.col("count") <= tile, F.lit(0)).otherwise(chunk).alias("c"))
             .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select(F.xxhash64("k", "v", F.least("c", "d"), F.greatest("c", "d")).alias("unit"), "fp"))
    return (units.repartition("unit").sortWithinPartitions("unit")
            .mapInArrow(_compare(radius), "a bigint, b bigint").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternating star steps (Kiveris et al., 2014): each node's larger, then its
    smaller neighbours are linked to the smallest one; the number of rounds grows
    with the logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: both directions, larger neighbours go to the smallest
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = stored(small, "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (seen.n, seen.h):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (seen.n, seen.h)
    raise RuntimeError("components did not settle")


def _rooted(docs: DataFrame, width: int, radius: int, tile: int) -> DataFrame:
    """doc_id, fp, root (one fingerprint of the component, its real name) and
    component_id (its smallest doc_id) of every document."""
    fps = stored(fingerprints(docs, width), "fingerprints")
    # equal fingerprints meet in one node; its name is the smallest doc_id
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius, tile))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    # a group can be large, so its fingerprints meet its name under SALTS keys; the
    # root itself, and with it every fingerprint without a link, has key 0 alone
    names = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    names = names.select("root", "component_id", F.explode(
        F.sequence(F.lit(0), F.when(F.col("n") > 1, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt"))
    by_fp = (named.withColumn("salt", F.when(F.col("fp") == F.col("root"), F.lit(0))
                              .otherwise(F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")))
             .join(names, ["root", "salt"]).select("fp", "component_id", "root"))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def _hex(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return _rooted(docs, width, radius, tile).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component, with all its columns: the one with the
    smallest doc_id; of rows that repeat that id one, and of a component without
    any doc_id one. Components are told apart by their fingerprints, so unrelated
    texts under one doc_id each keep a row."""
    bad_id, fp_name, hex_, root, name = fresh(docs, "_id", "_fp", "_hex", "_root", "_name")
    found = stored(_rooted(docs, width, radius, TILE), "components")
    # rows that a doc_id alone does not tell apart are few: they are settled by fingerprint
    repeated = stored(found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(bad_id)), "repeated")
    dropped = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(bad_id)).distinct(), "dropped")
    plain = (docs.join(repeated, docs["doc_id"].eqNullSafe(repeated[bad_id]), "left_anti")
             .join(dropped, docs["doc_id"] == dropped[bad_id], "left_anti"))
    odd = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated[bad_id]), "left_semi")
    odd = _with_fingerprint(odd, fp_name, width)
    names = found.select(_hex("fp").alias(hex_), F.col("root").alias(root), F.col("component_id").alias(name)).distinct()
    # of equal ids in a component, and of rows without an id, one stays: combined map-side
    best = odd.join(names, odd[fp_name] == names[hex_]).where(odd["doc_id"].eqNullSafe(names[name]))
    return plain.unionByName(best.dropDuplicates([root]).select(*docs.columns))


def _with_fingerprint(docs: DataFrame, name: str, width: int) -> DataFrame:
    """All columns and the fingerprint in hexadecimal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [f"{fingerprint(t or '', width):016x}" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.string())], names=[*b.schema.names, name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    return docs.mapInArrow(run, schema)
