"""Token-id files (operator 6): frequency-ranked ids in a byte-aligned code.

Each id is replaced by its rank in the corpus's id frequencies, so that common
ids are small, and written in one to four little-endian bytes. The lengths
stand apart, two bits an id, four ids to a control byte. A block is

    magic 4 bytes, number of ids u32, number of documents u32,
    ids of each document u32, control bytes, data bytes

and holds whole documents in ascending doc_id order. A file set under a path:
``blocks`` (Parquet: shard, first id of the block in its shard, ids in it, the
documents' ids, the block) and ``ranks`` (rank, id). Shards are ascending
ranges of doc_id, so nothing passes through one task. Decoding looks the four
lengths of a control byte up in a table and gathers the bytes with numpy.

Defined results: null text is empty (only the end id); null doc_ids stand
first; repeated doc_ids are ordered by their ids' number and crc; an empty
table makes an empty file set.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices, stored

MAGIC = b"VLR1"
#: Ids in a block before it is written; a longer document is a block of its own.
BLOCK = 262_144
#: Entries of a worker's cache of pre-tokens before it becomes the older one.
CACHE = 300_000

_HEAD = struct.Struct("<4sII")
#: Byte-level vocabularies show a byte as its Latin-1 character if that is printable
#: and not a space, else as the next free character from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: The lengths of four ids for each control byte, and the bits that a length keeps.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative 32-bit numbers."""
    r = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[:len(r)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers, by a look-up of each control byte."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    four = raw[start] | raw[start + 1] << 8 | raw[start + 2] << 16 | raw[start + 3] << 24
    return four & _MASKS[size]


def pack_block(counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([_HEAD.pack(MAGIC, len(ranks), len(counts)), np.asarray(counts, "<u4").tobytes(), control, data])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' numbers of ids, and all ranks."""
    magic, n, docs = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token-id block")
    at = _HEAD.size + 4 * docs
    end = at + -(-n // 4)
    return np.frombuffer(block, "<u4", docs, _HEAD.size), unpack(block[at:end], block[end:], n)


class Parts(dict):
    """Ids by pre-token; a new one is encoded, unless the cache before this one has it."""

    def __init__(self, encode: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, part: str) -> bytes:
        got = self[part] = self.older.get(part) or self.encode(part)
        return got


class Ids:
    """Ids of texts by a tokenizers file, as little-endian bytes of type ``kind``.

    For a tokenizer that composes, lower-cases, drops white space, splits by the
    pattern below and marks word ends, texts of ASCII and Latin-1 letters are
    split here by that pattern's equal for these characters, and each pre-token's
    ids, which the library's model gives, are remembered. A word (between ASCII
    white space) with any other character goes to the library as it is, a text
    with a special string as a whole. Any other tokenizer gets whole texts.
    """

    #: Fixed value: the split pattern that the cut below is made for.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # the alternatives begin with different characters but for the apostrophe's, so letters may stand first
    _cut = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-zß-öø-ÿ0-9\t-\r ]+").findall
    _plain = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
    _gaps = re.compile(r"[\t-\r ]+").split

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.t = Tokenizer.from_file(file)
        self.t.no_truncation()
        self.t.no_padding()
        self.model = self.t.model
        self.kind = "<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4"
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.cuts = (spec["model"].get("end_of_word_suffix") == "</w>" and norm == ["NFC", "Replace", "Lowercase"]
                     and split.get("type") == "Split" and split.get("behavior") == "Removed"
                     and bool(split.get("invert")) and split["pattern"].get("Regex") == self.SPLIT)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.parts = Parts(self._part, {})

    def _raw(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self._raw(self.t.encode(text, add_special_tokens=False).ids)

    def _split(self, text: str) -> list[str]:
        if self._plain(text):
            return self._cut(text.lower())
        out: list[str] = []
        for word in self._gaps(text):
            if self._plain(word):
                out += self._cut(word.lower())
            else:
                out.append("\n" + word)  # no pre-token has a line feed
        return out

    def _part(self, part: str) -> bytes:
        if part[0] == "\n":
            return self.whole(part)
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_SHOWN)
        return self._raw([x.id for x in self.model.tokenize(shown)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [self.whole(t) for t in texts]
        if len(self.parts) > CACHE:
            self.parts = Parts(self._part, dict(self.parts))
        get = self.parts.__getitem__
        return [self.whole(t) if "<|" in t or any(s in t for s in self.special) else b"".join(map(get, self._split(t)))
                for t in texts]


@lru_cache(maxsize=1)
def _ids(file: str) -> Ids:
    """One tokenizer with its caches for all tasks of a worker."""
    return Ids(file)


def _tokenise(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        ids = _ids(tokenizer)
        end = np.asarray([end_id], ids.kind).tobytes()
        for b in slices(batches):
            raw = [x + end for x in ids([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                names=["doc_id", "n", "crc", "ids"])
    return run


def _frequencies(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column("ids").to_pylist()), kind)
            got = np.bincount(x, minlength=len(total))
            got[:len(total)] += total
            total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                                         names=["id", "n"])
    return run


def _write_blocks(rank_of: np.ndarray, kind: str, doc_type: pa.DataType):
    def run(batches):
        shard, first, block = TaskContext.get().partitionId(), 0, []
        size = 0

        def flush():
            ranks = rank_of[np.frombuffer(b"".join(x for _, x in block), kind)]
            counts = [len(x) // np.dtype(kind).itemsize for _, x in block]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ranks)], pa.int64()),
                 pa.array([[d for d, _ in block]], pa.list_(doc_type)), pa.array([pack_block(counts, ranks)], pa.binary())],
                names=["shard", "first", "n", "doc_ids", "block"])

        for b in slices(batches):
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                block.append((d, x))
                size += len(x) // np.dtype(kind).itemsize
                if size >= BLOCK:
                    yield flush()
                    first, size, block = first + size, 0, []
        if block:
            yield flush()
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encode every text with the tokenizers file, end each document with ``end_id``,
    and write a file set under ``path``."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    doc = docs.schema["doc_id"].dataType
    kind = Ids(tokenizer).kind
    raw = stored(docs.select("doc_id", "text").mapInArrow(
        _tokenise(tokenizer, end_id), f"doc_id {doc.simpleString()}, n bigint, crc bigint, ids binary"), "ids")
    # the frequency of every id of the vocabulary over the whole corpus: bounded by the vocabulary
    ranked = (raw.select("ids").mapInArrow(_frequencies(kind), "id bigint, n bigint")
              .groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect())
    order = np.array([r.id for r in ranked], np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame([(k, r.id, r.n) for k, r in enumerate(ranked)], "rank int, id bigint, n bigint") \
        .coalesce(1).write.parquet(f"{path}/ranks")
    (raw.repartitionByRange("doc_id", "n", "crc").sortWithinPartitions("doc_id", "n", "crc").select("doc_id", "ids")
        .mapInArrow(_write_blocks(rank_of, kind, to_arrow_type(doc)),
                    f"shard int, first bigint, n bigint, doc_ids array<{doc.simpleString()}>, block binary")
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def _read_blocks(id_of: np.ndarray, base: dict[int, int], doc_type: pa.DataType, digest: bool):
    def run(batches):
        for b in slices(batches, 8):
            for shard, first, ids, block in zip(*(b.column(c).to_pylist() for c in ("shard", "first", "doc_ids", "block"))):
                counts, ranks = unpack_block(block)
                flat = id_of[ranks].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                if digest:
                    last = pa.array([zlib.crc32(flat[s:e].tobytes()) for s, e in zip(starts, ends)], pa.int64())
                else:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, doc_type), pa.array(base[shard] + first + starts), pa.array(counts.astype(np.int64)), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array of
    int) of each document of a file set, or with ``digest`` their ids_crc32."""
    from pyspark.sql.pandas.types import to_arrow_type
    blocks = spark.read.parquet(f"{path}/blocks")
    doc = blocks.schema["doc_ids"].dataType.elementType
    id_of = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()] or [0], np.int64)
    # one number for each shard, which is one for each task that wrote the files
    base, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        base[r.shard], total = total, total + r.n
    kind = doc.simpleString()
    return blocks.select("shard", "first", "doc_ids", "block").mapInArrow(
        _read_blocks(id_of, base, to_arrow_type(doc), digest),
        f"doc_id {kind}, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))


def id_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write a file set under the shared checkpoint folder and read every document back."""
    path = scratch_path(docs.sparkSession, "id-files")
    write_ids(docs, tokenizer, path, end_id)
    return read_ids(docs.sparkSession, path, digest=True)
