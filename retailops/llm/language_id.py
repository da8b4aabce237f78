"""Language identification (operator 1): sparse multinomial logistic regression.

Features are hashed character 1-, 2- and 3-grams of the lower-cased text; a
feature's value is its share among the text's n-grams of that length times
its inverse document frequency. Document frequencies come from all training
documents. The weights are fitted by follow-the-regularised-leader (FTRL
proximal) with elastic-net penalties on a bounded sample of labelled rows, at
most about ``per_class`` a language (a documented parameter): shards of the
sample are fitted side by side from the same data order and their leaders are
averaged. A second bounded sample, never used for the weights, sets one
temperature by the least negative log-likelihood; a score is the calibrated
probability of the predicted language.

The model has ``BUCKETS`` weights a language, on the driver and in every worker: half
a megabyte each, so some hundreds of languages are meant, not thousands.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with no labelled row every text is ``und`` with score 0; a tie goes to the
language that sorts first; repeated rows get a row each; an empty table gives
no rows. lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Hash buckets of the features; bounds the model.
BUCKETS = 1 << 16
_ORDERS = 3
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_WINDOW = 1 << 18  # positions whose features are in memory at a time
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For windows of all texts: the text's number at each position, and for each
    order the bucket of the n-gram that begins there. Three zero characters end a
    text, so an n-gram never reaches into the next one; none begins at them."""
    codes = np.frombuffer(("\0\0\0".join(t.lower() for t in texts) + "\0\0\0").encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t.lower()) + 3 for t in texts], np.int64)
    owner_ends = np.cumsum(sizes)
    n = len(codes) - 3
    for lo in range(0, n, _WINDOW):
        hi = min(n, lo + _WINDOW)
        at = np.arange(lo, hi)
        owner = np.searchsorted(owner_ends, at, side="right")
        real = at < owner_ends[owner] - 3
        h, out = np.zeros(hi - lo, np.uint32), []
        for k in range(_ORDERS):
            h = (h ^ codes[lo + k:hi + k]) * _MULT[k] + np.uint32(k + 1)
            out.append(((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)[real])
        yield owner[real], out


def _grams_in(texts: list[str]) -> np.ndarray:
    """N-grams of one order in each text (its characters; at least one, to divide by)."""
    return np.array([max(1, len(t.lower())) for t in texts], float)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each bucket occurs, and the number of documents.
    Each task sends one row a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                seen = np.zeros(BUCKETS, bool)
                for _, grams in _grams([t or ""]):
                    for g in grams:
                        seen[g] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["h", "n"])

    rows = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(BUCKETS, np.int64), 0  # at most BUCKETS rows and one
    for r in rows:
        if r.h < 0:
            total = int(r.n)
        else:
            df[r.h] = r.n
    return df, total


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text."""
    total = np.zeros(BUCKETS)
    for _, grams in _grams([text]):
        for g in grams:
            total += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at] / _grams_in([text])[0] * idf[at]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 2.0,
         beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> np.ndarray:
    """FTRL-proximal with elastic net: weights of shape (BUCKETS, classes)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z, n):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(z, n)


class Model:
    """Languages, weights times inverse document frequency, and the temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, temperature: float = 1.0):
        self.langs, self.table, self.temperature = langs, table, temperature

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for owner, grams in _grams(texts):
            for g in grams:
                got = self.table[g]
                for c in range(len(self.langs)):
                    out[:, c] += np.bincount(owner, got[:, c], minlength=len(texts))
        return out / _grams_in(texts)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        und = [not has_letter(t) for t in texts]
        return (["und" if u else self.langs[k] for u, k in zip(und, best)],
                [0.0 if u else round(float(p[i, k]), 6) for i, (u, k) in enumerate(zip(und, best))])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood."""
    def loss(t):
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 61)
    k = int(np.argmin([loss(t) for t in grid]))
    fine = np.geomspace(grid[max(0, k - 1)], grid[min(60, k + 1)], 41)
    return float(fine[int(np.argmin([loss(t) for t in fine]))])


def _sampled(docs: DataFrame, counts: dict[str, int], per_class: int, salt: int) -> DataFrame:
    """About ``per_class`` rows of each language, by a hash of id and text."""
    rate = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, per_class / c))])
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return docs.where(chance < F.element_at(rate, F.col("lang")))


def fit(docs: DataFrame, per_class: int = 2_000, shards: int = 4) -> Model:
    """A model from the columns doc_id, text, lang of labelled documents (lang not null)."""
    docs = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)))
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(10)) == 0  # rows for the temperature only
    classes, index = len(langs), {x: k for k, x in enumerate(langs)}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in slices(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                rows.append((*_features(t or "", idf), index[y]))
        if rows:
            w = ftrl(rows, classes)
            at, c = np.nonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(c, 0)),
                                              pa.array(np.append(w[at, c] * len(rows), float(len(rows))))], names=["h", "c", "w"])

    # rows are put in one order first, so that a fit repeats
    sample = _sampled(docs.where(~held), counts, per_class, 1).withColumn("_order", F.xxhash64("doc_id", "text", F.lit(2)))
    parts = sample.repartition(shards, "_order").sortWithinPartitions("_order").select("text", "lang")
    got = parts.mapInArrow(train, "h bigint, c bigint, w double").groupBy("h", "c").agg(F.sort_array(F.collect_list("w")).alias("w")).collect()
    table, size = np.zeros((BUCKETS, classes)), 1.0  # at most BUCKETS x languages, a number from each shard
    for r in got:
        if r.h < 0:
            size = sum(r.w)
        else:
            table[r.h, r.c] = sum(r.w)
    model = Model(langs, table / size * idf[:, None])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(model.logits(texts).tolist(), pa.list_(pa.float64())),
                                              b.column("lang")], names=["z", "lang"])

    rows = (_sampled(docs.where(held), counts, max(1, per_class // 4), 3).select("text", "lang")
            .mapInArrow(evaluate, "z array<double>, lang string").collect())  # at most per_class / 4 a language
    rows.sort(key=lambda r: (r.lang, r.z))
    model.temperature = _temperature(np.array([r.z for r in rows]).reshape(len(rows), classes),
                                     np.array([index[r.lang] for r in rows], np.int64))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but text, then lang_pred and score."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = model.predict([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with an identified language of at least that score, with all
    their columns; with no language learned, those that have a letter."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            if model.langs:
                keep = [x != "und" and s >= least for x, s in zip(*model.predict(texts))]
            else:
                keep = [has_letter(t) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
