"""Benchmark decontamination (operator 7): SimHash of item-sized windows.

Words are runs of letters and digits of the lower-cased text. A document is
contaminated by a benchmark item of m words when some window of m words of the
document has a weighted five-word-shingle similarity of at least ``similarity``
with the item (sum of the smaller multiplicities over sum of the larger ones). A
document of fewer than m words is itself the one window.

1. *Anchors.* Such a window shares at least t = ceil(similarity * n) of the
   item's n shingles, so it holds one of any n - t + 1 of them; each item is
   indexed by its rarest n - t + 1. This loses no window. The index is broadcast
   in parts of about ``part`` entries, one pass over the texts for each part, so
   the texts are never shuffled however large the benchmark is. A hit carries
   the words around it, as far as a window of its item's size can reach.
2. *Windows.* Every window of the item's size that holds an anchor gets a 64-bit
   SimHash of its shingles, once: it belongs to its first anchor. Bits are counted
   in packed lanes, four to a number (two where an item has over 32,767 shingles).
   The counts slide: a shingle enters at the first window that holds it and leaves
   after the last, so a hit costs rows in proportion to the item, not its square.
3. *Multi-index.* Fingerprints are cut into radius + 1 blocks: two within the
   radius agree on a whole block, so an equality join on (class, block, value)
   finds all of them; the Hamming distance is then checked.
4. *Verification* compares the shingles of the window and the item exactly.

At similarity 0.8 two fingerprints differ by about 10 of 64 bits (standard
deviation 3); radius 20 lies more than three deviations above that.

All steps are DataFrame functions. Defined results: null texts have no words;
items of fewer than five words have no shingle and match nothing; items with
equal words are one class, named by their smallest non-null item_id (null if none
has one); items of different words are classes of their own even under one
item_id, and a document has a row for each class it matches; repeated documents
give one row for each doc_id; empty tables give no rows; null doc_ids are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

WIDTH = 5


def _words(text: str) -> Column:
    return F.expr(f"array_remove(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')")


def _shingles(words: str) -> Column:
    """A hash for each run of five words, in order."""
    return F.expr(f"""CASE WHEN size({words}) >= {WIDTH}
        THEN transform(sequence(1, size({words}) - {WIDTH - 1}), i -> xxhash64(slice({words}, i, {WIDTH})))
        ELSE array() END""")


def _lanes(h: str, width: int) -> list[Column]:
    """The 64 bits of ``h`` spread over ``width`` columns, 64 / width bits in lanes of ``width`` bits each."""
    ones = sum(1 << (width * j) for j in range(64 // width))
    return [F.expr(f"shiftright({h}, {k}) & {ones}L").alias(f"s{k}") for k in range(width)]


def _majority(n: str, width: int) -> Column:
    """The SimHash: bit width * j + k is set if lane j of sum k is above half of ``n``."""
    bits = [f"if(2 * (shiftrightunsigned(s{k}, {width * j}) & {(1 << width) - 1}L) > {n}, shiftleft(1L, {width * j + k}), 0L)"
            for j in range(64 // width) for k in range(width)]
    return F.expr(" | ".join(bits))


def _lane_width(items: DataFrame) -> int:
    """Lanes of 16 bits count to 32,767 shingles in a signed number, lanes of 32 bits past any text."""
    longest = items.agg(F.max("n")).first()[0]  # one number
    return 16 if (longest or 0) < 1 << 15 else 32


def _blocks(fp: str, radius: int) -> Column:
    """An array of (k, v): the value of each of radius + 1 blocks of a fingerprint."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("k"),
                              F.expr(f"shiftright({fp}, {a}) & {(1 << (b - a)) - 1}L").alias("v"))
                     for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def _items(benchmark: DataFrame) -> DataFrame:
    """One row for each class of items with equal words: cls, item_id, words, shingles, m, n."""
    return (benchmark.select("item_id", _words("text").alias("words")).where(F.size("words") >= WIDTH)
            .groupBy("words").agg(F.min("item_id").alias("item_id"))
            .withColumn("shingles", _shingles("words"))
            .withColumn("m", F.size("words")).withColumn("n", F.size("shingles"))
            .withColumn("cls", F.monotonically_increasing_id()))  # written before it is used


def _item_fingerprints(items: DataFrame, width: int) -> DataFrame:
    return (items.select("cls", F.explode("shingles").alias("h")).select("cls", *_lanes("h", width)).groupBy("cls")
            .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)], F.count("*").alias("n"))
            .select("cls", _majority("n", width).alias("item_fp")))


def _anchors(items: DataFrame, similarity: float) -> DataFrame:
    """(h, cls, m) of the rarest n - t + 1 shingles of each item."""
    spread = items.select("cls", "m", "n", F.posexplode("shingles").alias("at", "h"))
    rare = spread.groupBy("h").agg(F.countDistinct("cls").alias("df"))
    # ranks inside one item: a bounded sort of its own shingles
    ranked = (spread.join(rare, "h").groupBy("cls", "m", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "h", "at"))).alias("order")))
    return (ranked.select("cls", "m", F.expr(f"explode(slice(order, 1, n - cast(ceil({similarity} * n) AS int) + 1))").alias("s"))
            .select("cls", "m", F.col("s.h").alias("h")).distinct())


def _hits(docs: DataFrame, anchors: DataFrame, part: int) -> DataFrame:
    """doc_id, text_hash, cls, m, at (word of the anchor), base and ctx: the words
    from ``base`` on that windows of m words around the anchor can hold."""
    parts = max(1, -(-anchors.count() // part))
    spread = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words("text").alias("words"))
              .select("doc_id", "text_hash", "words", F.posexplode(_shingles("words")).alias("at", "h")))
    found = [spread.join(F.broadcast(anchors.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == k)), "h") for k in range(parts)]
    return (reduce(DataFrame.unionByName, found)
            .withColumn("base", F.expr(f"greatest(0, at - m + {WIDTH})"))
            .select("doc_id", "text_hash", "cls", "m", "at", "base", F.expr("slice(words, base + 1, at - base + m)").alias("ctx")))


def _windows(hits: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, cls, start and fingerprint of every window that holds an anchor."""
    # windows are numbered from base; the ones that hold the anchor before are that one's
    text = ["doc_id", "text_hash", "cls"]
    ours = Window.partitionBy(*text).orderBy("at")
    spans = (hits.dropDuplicates([*text, "at"])
             .withColumn("lo", F.greatest(F.lit(0), F.coalesce(F.lag("at").over(ours) + 1 - F.col("base"), F.lit(0))))
             # words around an anchor are fewer than m only if the document is: one window, all of it
             .withColumn("hi", F.expr("least(at - base, greatest(size(ctx) - m, 0))")).where("lo <= hi"))
    # the shingle j is in the windows first .. last: it enters at one and leaves after the other
    held = (spans.select(*text, "at", "m", "base", "lo", "hi", F.posexplode(_shingles("ctx")).alias("j", "h"))
            .withColumn("first", F.expr(f"greatest(lo, j - m + {WIDTH})")).withColumn("last", F.expr("least(hi, j)"))
            .where("first <= last").select(*text, "at", "base", "hi", "first", "last", *_lanes("h", width)))
    events = held.select(*text, "at", "base", "hi", F.expr("inline(array(struct(first AS s, 1 AS one), struct(last + 1 AS s, -1 AS one)))"),
                         *[f"s{k}" for k in range(width)])
    steps = events.where("s <= hi").groupBy(*text, "at", "base", "s").agg(
        *[F.sum(F.col("one") * F.col(f"s{k}")).alias(f"s{k}") for k in range(width)], F.sum("one").alias("n"))
    run = Window.partitionBy(*text, "at").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select(*text, (F.col("base") + F.col("s")).alias("start"), *[F.sum(f"s{k}").over(run).alias(f"s{k}") for k in range(width)],
                        F.sum("n").over(run).alias("n"))
    return sums.select(*text, "start", _majority("n", width).alias("fp"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20,
                 part: int = 500_000) -> DataFrame:
    """doc_id, item_id, similarity and start (first word of the most similar window)
    of every document and item class that match."""
    items = stored(_items(benchmark), "items")
    width = _lane_width(items)
    hits = stored(_hits(docs, stored(_anchors(items, similarity), "anchors"), part), "hits")
    index = (_item_fingerprints(items, width).withColumn("b", F.explode(_blocks("item_fp", radius)))
             .select("cls", "item_fp", F.col("b.k").alias("k"), F.col("b.v").alias("v")))
    near = (_windows(hits, width).withColumn("b", F.explode(_blocks("fp", radius)))
            .select("doc_id", "text_hash", "cls", "start", "fp", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
            .join(index, ["cls", "k", "v"])
            .where(f"bit_count(fp ^ item_fp) <= {radius}")
            # a window that agrees on several blocks is taken at the first of them
            .where(f"k = {_first_block(radius)}").select("doc_id", "text_hash", "cls", "start"))
    # one hit whose words hold the whole window gives its words back
    words = (near.alias("w").join(hits.alias("h"), F.expr(
        "w.text_hash = h.text_hash AND w.cls = h.cls AND w.doc_id <=> h.doc_id "
        "AND w.start BETWEEN h.base AND h.at"))
        .select("w.doc_id", "w.text_hash", "w.cls", "w.start", F.expr("slice(h.ctx, greatest(1, w.start - h.base + 1), h.m)").alias("window"))
        .dropDuplicates(["doc_id", "text_hash", "cls", "start"]))
    return (words.join(items.select("cls", "item_id", F.col("words").alias("item")), "cls")
            .withColumn("similarity", _similarity("window", "item")).where(F.col("similarity") >= similarity)
            .groupBy("doc_id", "cls", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
            .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"),
                    (-F.col("best.before")).cast("bigint").alias("start")))


def _first_block(radius: int) -> str:
    """SQL for the number of the first block on which fp and item_fp agree."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    cases = " ".join(f"WHEN shiftright(fp ^ item_fp, {a}) & {(1 << (b - a)) - 1}L = 0 THEN {k}"
                     for k, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"(CASE {cases} END)"


def _similarity(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger multiplicities of the five-word shingles of
    two word arrays, on the words themselves."""
    def strings(x):
        return f"transform(sequence(1, size({x}) - {WIDTH - 1}), i -> concat_ws(' ', slice({x}, i, {WIDTH})))"
    # shingles that repeat in both are counted again, the others once
    shared = f"""aggregate(array(struct({strings(a)} AS x, {strings(b)} AS y)), 0, (none, s) ->
        IF(size(array_distinct(s.x)) = size(s.x) OR size(array_distinct(s.y)) = size(s.y), size(array_intersect(s.x, s.y)),
           aggregate(array_intersect(s.x, s.y), 0, (n, g) -> n + least(
            size(filter(s.x, z -> z = g)), size(filter(s.y, z -> z = g))))))"""
    both = f"(size({a}) + size({b}) - {2 * (WIDTH - 1)})"
    return F.expr(f"transform(array({shared}), c -> c / ({both} - c))[0]")


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20) -> DataFrame:
    """The documents that no benchmark item contaminates, with all their columns."""
    (name,) = fresh(docs, "_contaminated")
    bad = stored(contaminated(docs, benchmark, similarity, radius).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")
