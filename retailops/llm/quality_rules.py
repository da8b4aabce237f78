"""Quality rules (operator 4) by weak supervision.

Each rule reads counts of a text and votes +1 (good), -1 (bad) or 0 (abstains).
The number of documents with each pattern of votes is counted over all
documents; expectation-maximisation on these counts (at most 3 to the number of
rules) estimates the share of good documents and, for each rule, how often it
is right about good and about bad ones. A document's posterior probability of
being good, not a conjunction of rules, decides. Abstaining says nothing.

Words are runs of non-white-space (ASCII white space) of the whole text.

Defined results: null text has no words (all counts 0, base_failed); repeated
rows give a row each; with no documents there is nothing to estimate and no row;
a text on which all rules abstain has the prior as its posterior.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, slices, stored

#: Characters counted as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: Counts taken from a text, in this order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines",
          "n_upper", "n_digits", "n_marks", "n_symbol_words", "n_upper_words", "n_punctuation"]


def _windows(ids: np.ndarray, distinct: int, width: int) -> np.ndarray:
    """A number for each window of ``width`` ids, equal exactly for equal windows."""
    n = len(ids) - width + 1
    code, top = ids[:n], distinct
    for k in range(1, width):
        if top * distinct >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            top = int(code.max()) + 1
        code, top = code * distinct + ids[k:n + k], top * distinct
    return code


def repeated_words(words: list[bytes], width: int = 5) -> tuple[int, int]:
    """Words inside a window of ``width`` words that occurs at least twice in the
    text, first occurrences included; and the number of distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(ids) <= width:
        return 0, len(seen)
    code = _windows(ids, len(seen), width)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0, len(seen)
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum()), len(seen)


def counts(text: str) -> list[int]:
    """The numbers named in COUNTS."""
    raw = text.encode()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat, distinct = repeated_words(words)
    symbols = without(SYMBOLS)
    symbol_words = sum(len(w.translate(None, SYMBOLS)) < len(w) for w in words) if symbols else 0
    upper = without(_UPPER)
    upper_words = sum(map(bytes.isupper, words)) if upper > len(words) else 0
    return [len(words), len(text) - without(_SPACE), symbols, len(lines) - len(set(lines)), repeat, distinct,
            len(lines), upper, without(_DIGITS), without(b"!?"), symbol_words, upper_words,
            without(_PUNCTUATION)]


# Each rule: name, bad if, good if; neither: it abstains. ``c`` has the counts by name.
RULES: list[tuple[str, Callable, Callable]] = [
    ("length", lambda c: c["n_words"] < 10, lambda c: c["n_words"] >= 50),
    ("word_length", lambda c: not 2 * c["n_words"] <= c["word_chars"] <= 14 * c["n_words"],
     lambda c: 3 * c["n_words"] <= c["word_chars"] <= 10 * c["n_words"]),
    ("symbols", lambda c: 100 * c["n_symbols"] > 10 * c["n_words"], lambda c: 100 * c["n_symbols"] <= c["n_words"]),
    ("symbol_words", lambda c: 100 * c["n_symbol_words"] > 10 * c["n_words"],
     lambda c: 100 * c["n_symbol_words"] <= c["n_words"]),
    ("punctuation", lambda c: 100 * c["n_punctuation"] > 12 * c["word_chars"],
     lambda c: 100 * c["n_punctuation"] <= 7 * c["word_chars"]),
    ("upper_case", lambda c: 100 * c["n_upper"] > 30 * c["word_chars"], lambda c: 100 * c["n_upper"] <= 10 * c["word_chars"]),
    ("upper_words", lambda c: 100 * c["n_upper_words"] > 30 * c["n_words"],
     lambda c: 100 * c["n_upper_words"] <= 5 * c["n_words"]),
    ("marks", lambda c: 100 * c["n_marks"] > 20 * c["n_words"], lambda c: 100 * c["n_marks"] <= 5 * c["n_words"]),
    ("repetition", lambda c: 100 * c["n_repeat_words"] > 15 * c["n_words"],
     lambda c: 100 * c["n_repeat_words"] <= 2 * c["n_words"] and c["n_words"] >= 20),
    ("dup_lines", lambda c: 100 * c["n_dup_lines"] > 20 * c["n_lines"],
     lambda c: c["n_dup_lines"] == 0 and c["n_lines"] >= 3),
    ("variety", lambda c: c["n_words"] >= 50 and 100 * c["n_distinct"] < 15 * c["n_words"],
     lambda c: c["n_words"] >= 20 and 100 * c["n_distinct"] > 25 * c["n_words"]),
    ("digits", lambda c: 100 * c["n_digits"] > 20 * c["word_chars"], lambda c: 100 * c["n_digits"] <= 5 * c["word_chars"]),
]


def votes(row: list[int]) -> tuple[int, ...]:
    c = dict(zip(COUNTS, row))
    return tuple(0 if not c["n_words"] else -1 if bad(c) else 1 if good(c) else 0 for _, bad, good in RULES)


def failed(n_words: int, n_repeat_words: int) -> bool:
    """The base check (fixed by the contract)."""
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def pattern(vote: tuple[int, ...]) -> str:
    return "".join("-0+"[v + 1] for v in vote)


class Model:
    """Prior share of good documents and each rule's reliability."""

    #: Bounds of a rule's chance of being right; a rule is never taken as inverted.
    LEAST, MOST = 0.5, 0.999

    def __init__(self, table: dict[str, int], rounds: int = 100):
        rows = sorted(table)
        v = np.array([["-0+".index(x) - 1 for x in p] for p in rows], float).reshape(len(rows), len(RULES))
        n = np.array([table[p] for p in rows], float)
        good, bad = v > 0, v < 0
        # it begins with a weighted majority: most rules have nothing against a bad
        # document either, so two bad votes outweigh the good votes of all others
        post = 1 / (1 + np.exp(-(good.sum(1) - len(RULES) / 2 * bad.sum(1))))
        self.prior, self.on_good, self.on_bad = 0.9, np.full(len(RULES), 0.9), np.full(len(RULES), 0.6)
        for _ in range(rounds if len(rows) else 0):
            g, b = n * post, n * (1 - post)
            self.prior = float(np.clip((g.sum() + 9) / (n.sum() + 10), 0.5, 0.99))
            # pseudo-counts: nine right votes of ten on good documents, six of ten on bad ones
            self.on_good = np.clip((good.T @ g + 9) / ((good | bad).T @ g + 10), self.LEAST, self.MOST)
            self.on_bad = np.clip((bad.T @ b + 6) / ((good | bad).T @ b + 10), 0.2, self.MOST)
            new = self._posterior(good, bad)
            done = np.abs(new - post).max() < 1e-9
            post = new
            if done:
                break

    def _posterior(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        odds = (np.log(self.prior / (1 - self.prior)) + good @ np.log(self.on_good / (1 - self.on_bad))
                + bad @ np.log((1 - self.on_good) / self.on_bad))
        return 1 / (1 + np.exp(-odds))

    def posterior(self, p: str) -> float:
        v = np.array([["-0+".index(x) - 1 for x in p]])
        return float(self._posterior(v > 0, v < 0)[0])


def _signals():
    def run(texts: list[str]) -> list[pa.Array]:
        rows = [counts(t) for t in texts]
        cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
        return [pa.array(c, pa.int64()) for c in cols] + [pa.array([pattern(votes(r)) for r in rows], pa.string())]
    return run


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the pattern of votes of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        per_text(_signals, [*COUNTS, "votes"], ["doc_id"]),
        f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", votes string")


def fit(found: DataFrame) -> Model:
    """The model of the patterns of all documents: at most 3 ** len(RULES) rows reach the driver."""
    return Model({r["votes"]: r["count"] for r in found.groupBy("votes").count().collect()})


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, kept and the posterior p_good of every document."""
    found = stored(signals(docs), "signals")
    seen = [r["votes"] for r in found.select("votes").distinct().collect()]
    model = fit(found)
    prob = F.create_map(*[F.lit(x) for p in sorted(seen) for x in (p, model.posterior(p))]) if seen else None
    p_good = F.element_at(prob, F.col("votes")) if seen else F.lit(None).cast("double")
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", *COUNTS[:5], bad.alias("base_failed"),
                        (~bad & (p_good >= threshold)).alias("kept"), p_good.alias("p_good"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = fit(signals(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        at = docs_columns.index("text")
        for b in slices(batches):
            keep = []
            for t in b.column(at).to_pylist():
                row = counts(t or "")
                p = pattern(votes(row))
                if p not in known:
                    known[p] = model.posterior(p) >= threshold
                keep.append(known[p] and not failed(row[0], row[4]))
            yield b.filter(pa.array(keep, pa.bool_()))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def all_patterns() -> Iterator[str]:
    """Every pattern of votes that can occur, for tests."""
    return map(pattern, product((-1, 0, 1), repeat=len(RULES)))
