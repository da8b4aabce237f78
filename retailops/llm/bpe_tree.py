"""Byte-level BPE encoding and decoding (operator 8): a tree reduction over a monoid.

An element is a text span with its token ids. A text is halved until a span
has at most ``leaf`` characters, which the library encodes. Two neighbours are
joined by encoding anew a window around their border; the window grows until
the tokens outside it are proved stable:

* *between pre-tokens*: the split pattern never lets a match run from a
  character that is not white space into a space or line feed, nor from an
  ASCII letter into an ASCII digit or back, whatever stands further left or
  right. The window ends at such cuts, so what lies beyond it is untouched.
* *inside one long pre-token* (a run of ASCII letters with no cut near): a
  token sequence is the BPE encoding of its bytes exactly when each pair of
  neighbouring tokens encodes to itself. Tokens around the border are encoded
  anew in windows that double until the two pairs at the window's ends pass
  that test; all other pairs lie inside sequences that were valid before.

Decoding joins the bytes of halves up the same kind of tree.

Defined results: null text is empty (0 tokens, hashes of the empty string);
repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text

LEAF = 4_096
_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_LETTERS = re.compile(r" ?[A-Za-z]+\Z")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken
        self.leaf = max(2, leaf)
        self.lib = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}

    # one level of BPE on raw bytes, without the split pattern
    def _piece(self, raw: bytes) -> list[int]:
        return self.lib._encode_single_piece(raw)

    def _stable(self, a: int, b: int) -> bool:
        return self._piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.lib.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        p, q = self._cut_before(text, lo, mid), self._cut_after(text, mid, hi)
        a, b = self._tokens(reversed(left), text[p:mid]), self._tokens(right, text[mid:q])
        if q - p > self.leaf and _LETTERS.match(text[p:q]):
            run = self._join_run(left[len(left) - a:], right[:b])
        else:
            run = self.lib.encode_ordinary(text[p:q])
        del left[len(left) - a:]
        left += run
        left += right[b:]
        return left

    def _join_run(self, left: list[int], right: list[int]) -> list[int]:
        """The same inside one pre-token."""
        i = j = 4
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._piece(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i:] + right[:j])))
            ok_left = i == len(left) or self._stable(left[-i - 1], window[0])
            ok_right = j == len(right) or self._stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def _cut_before(self, text: str, lo: int, mid: int) -> int:
        """The last sure cut in text[lo:mid], looked for in growing windows; else lo."""
        w = 64
        while True:
            start = max(lo, mid - w)
            at = None
            for m in _CUT.finditer(text, start, mid):
                if start < m.start() < mid:  # both characters lie in the left span
                    at = m.start()
            if at is not None or start == lo:
                return lo if at is None else at
            w *= 4

    def _cut_after(self, text: str, mid: int, hi: int) -> int:
        m = _CUT.search(text, mid + 1, hi)
        return m.start() if m and m.start() < hi else hi

    def _tokens(self, ids, span: str) -> int:
        """How many tokens of ``ids`` make up the bytes of ``span``."""
        size, n = len(span.encode()), 0
        ids = iter(ids)
        while size > 0:
            size -= len(self.bytes_of[next(ids)])
            n += 1
        assert size == 0, "a sure cut is a token border"
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def coder(path: str, pattern: str, leaf: int = LEAF) -> TreeBPE:
    """One encoder for all tasks of a worker."""
    return TreeBPE(read_ranks(path), pattern, leaf)


def _digests(path: str, pattern: str, leaf: int) -> Callable[[], Callable[[list], list[pa.Array]]]:
    def make():
        bpe = coder(path, pattern, leaf)
        name = [str(i) for i in range(max(bpe.bytes_of) + 1)]

        def run(texts: list[str]) -> list[pa.Array]:
            n, ids_hash, back_hash = [], [], []
            for t in texts:
                ids = bpe.encode(t)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                back_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())]
        return run
    return make


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    def make():
        bpe = coder(ranks, pattern, leaf)
        return lambda texts: [pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_text(make, ["ids"], ["doc_id"]), f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and text (binary) from doc_id and ids; null ids decode to empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern, leaf)
        for b in batches:
            raw = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "text"])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text binary")


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256
    (of the decoded bytes): encode and decode in one pass over the texts, so that
    the ids themselves, several times the text's size, never leave the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fn = per_text(_digests(ranks, pattern, leaf), ["n_tokens", "ids_sha256", "decoded_sha256"], ["doc_id"])
    return docs.select("doc_id", "text").mapInArrow(
        fn, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
