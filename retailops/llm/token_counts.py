"""Token counts (operator 10): a map-side look-up of pre-token lengths in two tiers.

Tier one is a table of the most frequent pre-tokens and their token counts. It
has at most ``entries`` entries, is built from the pre-tokens of all rows and is
broadcast. They are counted in each task first, so what is shuffled is a row for
each distinct pre-token of a task. Tier two is a cache in each worker: what tier
one lacks is encoded by the library once and remembered. Every count is the
library's own.

Pre-tokens are cut where no merge can cross. A sentencepiece BPE piece of the
given kind never holds a space mark after another character, nor a line feed,
so a text may be cut before each run of spaces and around each line feed. A
tokenizer file (.json) has no such general cut; there the pre-token is the
whole text and the library counts it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows give a row each; an empty table gives no rows; a null id passes through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: A run of spaces with the word after it, spaces before a line feed, a line feed.
_CUT = re.compile(r" *[^ \n]+| +|\n")
#: Entries of a worker's cache before it starts anew.
CACHE = 400_000
#: Characters of the longest pre-token that tier one takes.
LONGEST = 64
#: Distinct pre-tokens that a task counts before it hands them to the shuffle.
HELD = 400_000


def segments(text: str) -> list[str]:
    """Pieces of a text whose sentencepiece token counts add up to the text's.

    The library puts one space mark before a text and reads U+2581 as that mark.
    """
    return _CUT.findall(" " + text.replace("▁", " ")) if text else []


class Lengths(dict):
    """Token counts by pre-token: the frequent table, then what this worker has met."""

    def __init__(self, frequent: dict[str, int], count: Callable[[str], int], limit: int = CACHE):
        super().__init__(frequent)
        self.frequent, self.count, self.limit = frequent, count, limit + len(frequent)

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= 256:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def piece_counter(model_file: str) -> Callable[[str], int]:
    """Token count of one segment: a line feed before it keeps the library from
    adding a space mark to the segment itself, and costs the same each time."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    extra = len(sp.encode("\n"))
    return lambda piece: len(sp.encode("\n" + piece)) - extra


def text_counter(tokenizer_file: str) -> Callable[[str], int]:
    """Token count of a whole text by a tokenizers file."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: how often the pre-tokens of a task's texts occur, handed on in parts of about ``HELD`` words."""
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          names=["word", "n"])

    seen: Counter[str] = Counter()
    for b in slices(batches):
        for t in b.column("text").to_pylist():
            if t:
                seen.update(w for w in segments(t) if len(w) <= LONGEST)
                if len(seen) >= HELD:
                    yield rows()
                    seen.clear()
    yield rows()


def frequent_lengths(docs: DataFrame, tokenizer: str, entries: int = 65_536, sample: int | None = None) -> dict[str, int]:
    """Tier one: the ``entries`` most frequent pre-tokens of all rows and their token
    counts (none longer than ``LONGEST`` characters; of those that occur as often as
    the last one, any).

    The occurrences are written once, as the least one that still comes in follows
    from how many words occur how often; so only the table comes to the driver, with
    a row for each number of occurrences (fewer than twice the root of all pre-tokens).
    Only a caller that names a ``sample`` has the words of about that many rows, each
    drawn by its own chance, so copies of one text never come in together."""
    docs = docs.select("text")
    if sample is not None:
        docs = docs.sample(min(1.0, sample / max(1, docs.count())), seed=10)
    words = stored(docs.mapInArrow(_occurrences, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best, least = [], None
    for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).toLocalIterator():
        least, room, entries = r.n, entries, entries - r.words
        if entries <= 0:
            break
    if least is not None:
        best = words.filter(F.col("n") > least).collect() + words.filter(F.col("n") == least).limit(room).collect()
    count = piece_counter(tokenizer)
    return {r.word: count(r.word) for r in best}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4_096, entries: int = 65_536,
                 sample: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every text.

    ``tokenizer`` is a path that all workers have: a sentencepiece .model or a
    tokenizers .json. Special strings inside texts are read as the library does
    by default; nothing is cut short, padded or added.
    """
    docs = docs.select("doc_id", "text")
    pieces = not tokenizer.endswith(".json")
    table = frequent_lengths(docs, tokenizer, entries, sample) if pieces else {}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most ``entries`` words of at most ``LONGEST`` characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces:
            lengths = Lengths(shared.value, piece_counter(tokenizer))
            count = lambda t: sum(map(lengths.__getitem__, segments(t)))
        else:
            count = text_counter(tokenizer)
        for b in slices(batches):
            text = pc.fill_null(b.column("text"), "")
            n = [count(t) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
