"""Operator 12: personal data by patterns and a character BiLSTM with a CRF.

Patterns find the base spans of four kinds (email, ip, card, phone); they always
stay. A character-level bidirectional LSTM with CRF transitions, written and
trained in numpy, adds spans that the patterns miss: numbers without a plus,
cards in other groups, written-out separators.

Training: windows of characters labelled by the base spans, at most ``per_kind``
of each kind and twice as many without any (the smallest hashes over all
documents, equal windows once), each with a variant whose span is written another
way and one whose span is replaced by a harmless number. Shapes that fail their
check (a card without Luhn, an ip over 255) are left out of training.

Decoding: a text is covered by windows of ``WINDOW`` characters that overlap by
half. Windows without a digit or an ``@`` are skipped: every span must hold one.
Each window's forward-backward pass gives a label distribution at every
character. Windows that overlap form a region; there the distributions are
averaged, weighted by the distance to the window's edge, and one Viterbi pass
over the whole region, under the rules of the labels, gives spans that agree
across windows and may be longer than one. An added span must pass its kind's
check (Luhn, parts up to 255, digit count) and may not touch a base span.

Defined results: a null text is an empty text, with no span; repeated rows have
equal results; offsets are code points, ends exclusive; without labelled spans to
learn from (or any text) there is no model and base spans alone are returned.
``n_email`` to ``n_phone`` and ``base_sha256`` are of the base spans, ``spans`` of
all, ``n_added`` counts the model's. Text length is unbounded: patterns are
matched in linear time and windows decoded in groups. An empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 32
#: Character codes: ASCII as it is, all else one code, then padding.
OTHER, PAD, CODES = 128, 129, 130

# ---- base spans; patterns are split so that each text is matched in linear time

_AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _AT_HOST.match(text, at) if start < at else None
        free = host.end() if host else at + 1
        if host:
            yield start, free, True
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _PHONE.finditer(text):
        yield m.start(), m.end(), 8 <= len(_DIGIT.findall(m[0])) <= 15


_FINDERS = (_emails, _ips, _cards, _phones)


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its check) of every pattern match, by kind, then start."""
    if not _HINT.search(text):
        return []
    return [(k, *m) for k, find in enumerate(_FINDERS) for m in find(text)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---- windows

def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, OTHER).astype(np.uint8)


def window_numbers(code: np.ndarray) -> np.ndarray:
    """Numbers k of the windows [k * STRIDE, k * STRIDE + WINDOW) that hold a digit or an @."""
    at = np.flatnonzero(((code >= 48) & (code <= 57)) | (code == 64)) // STRIDE
    return np.unique(np.maximum(np.concatenate([at, at - 1]), 0)) if len(at) else at


def window_codes(code: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    padded = np.concatenate([code, np.full(WINDOW, PAD, np.uint8)])
    return padded[np.minimum(numbers[:, None] * STRIDE + np.arange(WINDOW), len(padded) - 1)]


def span_labels(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of every character; of spans that overlap the first kind stays."""
    out = np.zeros(n, np.uint8)
    for k, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows: text, labels as digits, the first kind in it (4: none)."""
    for b in slices(batches):
        rows = []
        for text in b.column("text").to_pylist():
            found = matches(text) if text else []
            if not text or not _HINT.search(text):
                continue
            code = codes(text)
            label = span_labels(len(text), [m[:3] for m in found if m[3]])
            # a long number that fails its check is neither a span nor surely none
            unsure = np.zeros(len(text), bool)
            for kind, a, e, ok in found:
                if not ok and (kind != 2 or e - a >= 13) and not label[a:e].any():
                    unsure[a:e] = True
            for k in window_numbers(code):
                cut = slice(k * STRIDE, k * STRIDE + WINDOW)
                if not unsure[cut].any():
                    kinds = label[cut][label[cut] > 0]
                    rows.append((text[cut], "".join(map(str, label[cut])), int(kinds[0] - 1) // 2 if len(kinds) else len(KINDS)))
        if rows:
            text, label, kind = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(label, pa.string()), pa.array(kind, pa.int32())],
                                             names=["text", "label", "kind"])


def training_windows(docs: DataFrame, per_kind: int) -> list[tuple[str, str]]:
    """At most ``per_kind`` windows of each kind, twice as many without a span."""
    all_ = docs.select("text").mapInArrow(_windows, "text string, label string, kind int").dropDuplicates(["text"])
    most = F.when(F.col("kind") == len(KINDS), 2 * per_kind).otherwise(per_kind)
    # the smallest hashes of a kind are among the smallest of each of its sixty-four shares
    some = all_.withColumns({"hash": F.xxhash64("text"), "share": F.pmod(F.crc32("text"), F.lit(64))})
    for keys in (["kind", "share"], ["kind"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "text"))
        some = some.withColumn("nth", nth).where((F.col("nth") <= 2 * per_kind) & (F.col("nth") <= most))
    return sorted((r.text, r.label) for r in some.select("text", "label").collect())


_NOISE = ("{0}-0{1}-1{2}", "{1}{0}:{3}{2}", "{0}{1}{2}.{3}{4}", "{0},{1}{2}{3}.{4}{5}", "v{0}.{1}.{2}", "{0}{1}{2}{3}{4}", "#{0}{1}{2}",
          "p. {0}{1}", "{0}x{1}{2}", "a{0}f{1}c{2}{3}e{4}b{5}", "199{0}", "{0}{1} %", "@{0}{1}", "20{0}{1}/{2}{3}")


def _rewritten(kind: int, span: str, rnd: np.random.Generator) -> str:
    """The same datum in a form the patterns do not match."""
    digits = "".join(_DIGIT.findall(span))
    if kind == 0:
        return span.replace("@", (" @ ", "(at)@", "@ ")[rnd.integers(3)], 1)
    if kind == 1:
        return span.replace(".", (" . ", "[.]", ". ")[rnd.integers(3)])
    if kind == 2:
        gap = (".", "  ", "/", "_")[rnd.integers(4)]
        return gap.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    d = digits[-10:]
    return ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0{} {} {}", "{} {}-{}")[rnd.integers(5)].format(d[:-7], d[-7:-4], d[-4:])


def variants(windows: list[tuple[str, str]], seed: int = 12) -> list[tuple[str, str]]:
    """Each window, and for its first whole span a rewritten and a harmless form."""
    rnd, out = np.random.default_rng(seed), list(windows)
    for text, label in windows:
        for m in re.finditer("|".join(f"{1 + 2 * k}{2 + 2 * k}+" for k in range(len(KINDS))), label):
            a, b, kind = m.start(), m.end(), (int(label[m.start()]) - 1) // 2
            if a and b < len(text):
                new = _rewritten(kind, text[a:b], rnd)
                noise = _NOISE[rnd.integers(len(_NOISE))].format(*rnd.integers(1, 10, 6))
                for put, tags in ((new, label[a] + str(2 + 2 * kind) * (len(new) - 1)), (noise, "0" * len(noise))):
                    # the left context gives way where the new form is longer
                    whole, marks = text[:a] + put + text[b:], label[:a] + tags + label[b:]
                    skip = min(a, max(0, len(whole) - WINDOW))
                    out.append((whole[skip:skip + WINDOW], marks[skip:skip + WINDOW]))
                break
    return out


# ---- the network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Embedding, one LSTM each way, a linear layer to label scores, CRF transitions."""

    def __init__(self, embed: int = 16, hidden: int = 24, seed: int = 12):
        rnd = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return rnd.normal(0, shape[0] ** -0.5, shape)

        self.h = hidden
        self.w = {"embed": rnd.normal(0, 0.3, (CODES, embed)), "out": normal(2 * hidden, LABELS), "out_b": np.zeros(LABELS),
                  "step": np.zeros((LABELS, LABELS)), "first": np.zeros(LABELS)}
        for way in "fb":
            self.w |= {f"{way}x": normal(embed, 4 * hidden), f"{way}h": normal(hidden, 4 * hidden), f"{way}c": np.zeros(4 * hidden)}
            self.w[f"{way}c"][hidden:2 * hidden] = 1  # forget gates start open

    # the forward pass keeps what the backward pass needs when ``keep`` is a dict

    def _lstm(self, code: np.ndarray, way: str, keep: dict | None) -> np.ndarray:
        """[time, window, hidden]; ``code`` is [time, window]; way b runs from the end."""
        w, h, n = self.w, self.h, code.shape[1]
        table = w["embed"] @ w[f"{way}x"] + w[f"{way}c"]  # gate inputs of each character
        out, state, cell = np.zeros((len(code), n, h)), np.zeros((n, h)), np.zeros((n, h))
        for t in range(len(code)) if way == "f" else range(len(code) - 1, -1, -1):
            gates = table[code[t]] + state @ w[f"{way}h"]
            ifo, g = _sigmoid(gates[:, :3 * h]), np.tanh(gates[:, 3 * h:])
            before, cell = cell, ifo[:, h:2 * h] * cell + ifo[:, :h] * g
            tanh_cell, previous = np.tanh(cell), state
            state = out[t] = ifo[:, 2 * h:] * tanh_cell
            if keep is not None:
                keep[way, t] = ifo, g, before, tanh_cell, previous
        return out

    def emissions(self, code: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Label scores [time, window, label] of windows [window, time]."""
        code = code.T
        both = np.concatenate([self._lstm(code, "f", keep), self._lstm(code, "b", keep)], axis=2)
        if keep is not None:
            keep["both"], keep["code"] = both, code
        return both @ self.w["out"] + self.w["out_b"]

    def marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRF forward-backward: log partition, log marginals, expected transition counts."""
        step, n = self.w["step"], len(score)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = score[0] + self.w["first"]
        for t in range(1, n):
            ahead[t] = _lse(ahead[t - 1][:, :, None] + step, 1) + score[t]
        total = _lse(ahead[-1], 1)
        pairs = np.zeros_like(step)
        for t in range(n - 2, -1, -1):
            right = behind[t + 1] + score[t + 1]
            both = step + right[:, None, :]
            behind[t] = _lse(both, 2)
            pairs += np.exp(ahead[t][:, :, None] + both - total[:, None, None]).sum(axis=0)
        return total, ahead + behind - total[:, None], pairs

    def _gradient(self, code: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        w, h = self.w, self.h
        score, gold = self.emissions(code, keep), label.T
        _, log_p, pairs = self.marginals(score)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        d_score = np.exp(log_p)
        d_score[np.arange(len(gold))[:, None], np.arange(gold.shape[1]), gold] -= 1
        grad["first"] = d_score[0].sum(axis=0)
        np.subtract.at(pairs, (gold[:-1], gold[1:]), 1)
        grad["step"] = pairs
        grad["out"] = np.einsum("tbh,tbl->hl", keep["both"], d_score)
        grad["out_b"] = d_score.sum(axis=(0, 1))
        d_both = d_score @ w["out"].T
        for way, d_out in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            d_state, d_cell = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
            d_table = np.zeros((CODES, 4 * h))
            steps = range(len(gold))
            for t in reversed(steps) if way == "f" else steps:
                ifo, g, before, tanh_cell, previous = keep[way, t]
                i, f, o = ifo[:, :h], ifo[:, h:2 * h], ifo[:, 2 * h:]
                d_state = d_state + d_out[t]
                d_cell = d_cell + d_state * o * (1 - tanh_cell ** 2)
                d_gates = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f),
                                          d_state * tanh_cell * o * (1 - o), d_cell * i * (1 - g ** 2)], axis=1)
                grad[f"{way}h"] += previous.T @ d_gates
                np.add.at(d_table, keep["code"][t], d_gates)
                d_state, d_cell = d_gates @ w[f"{way}h"].T, d_cell * f
            grad[f"{way}c"] = d_table.sum(axis=0)
            grad[f"{way}x"] = w["embed"].T @ d_table
            grad["embed"] += d_table @ w[f"{way}x"].T
        return {k: v / len(code) for k, v in grad.items()}

    def loss(self, code: np.ndarray, label: np.ndarray) -> float:
        """Mean negative log likelihood of the labels."""
        score, gold = self.emissions(code), label.T
        total, _, _ = self.marginals(score)
        at = np.take_along_axis(score, gold[:, :, None].astype(np.int64), 2)[:, :, 0].sum(axis=0)
        return float((total - at - self.w["first"][gold[0]] - self.w["step"][gold[:-1], gold[1:]].sum(axis=0)).mean())

    def train(self, code: np.ndarray, label: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 12) -> None:
        """Adam over shuffled batches, clipped gradients."""
        rnd, t = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        var = {k: np.zeros_like(v) for k, v in self.w.items()}
        for _ in range(epochs):
            order = rnd.permutation(len(code))
            for at in range(0, len(order), batch):
                grad = self._gradient(code[order[at:at + batch]], label[order[at:at + batch]])
                size = np.sqrt(sum((g ** 2).sum() for g in grad.values()))
                t += 1
                for k, g in grad.items():
                    g = g * min(1.0, 5 / max(size, 1e-12))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    self.w[k] -= rate * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(var[k] / (1 - 0.999 ** t)) + 1e-8)


def fit(docs: DataFrame, per_kind: int = 250, epochs: int = 8) -> Tagger | None:
    """The tagger, trained on the bounded sample of ``training_windows``; None without a labelled span."""
    windows = training_windows(docs, per_kind)
    if not any(set(label) - {"0"} for _, label in windows):
        return None
    rows = variants(windows)
    code, label = np.full((len(rows), WINDOW), PAD, np.uint8), np.zeros((len(rows), WINDOW), np.uint8)
    for i, (t, marks) in enumerate(rows):
        code[i, :len(t)], label[i, :len(t)] = codes(t), np.frombuffer(marks.encode(), np.uint8) - 48
    model = Tagger()
    model.train(code, label, epochs)
    return model


# ---- decoding

def allowed() -> np.ndarray:
    """[from, to]: inside follows only its own begin or inside; 0 or minus infinity."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -np.inf
        out[[inside - 1, inside], inside] = 0
    return out


def best_path(score: np.ndarray) -> np.ndarray:
    """Viterbi over one region [time, label] under the rules of the labels."""
    rules, start = allowed(), np.where(np.arange(LABELS) % 2 + (np.arange(LABELS) == 0) > 0, 0, -np.inf)
    best, back = score[0] + start, np.zeros(score.shape, np.int8)
    for t in range(1, len(score)):
        both = best[:, None] + rules
        back[t] = both.argmax(axis=0)
        best = both.max(axis=0) + score[t]
    path = np.zeros(len(score), np.int8)
    path[-1] = best.argmax()
    for t in range(len(score) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)


def regions(numbers: np.ndarray, p: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, averaged label distribution) of each run of overlapping windows;
    ``p`` is [window, time, label]."""
    for run in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers) != 1) + 1):
        start = int(numbers[run[0]]) * STRIDE
        end = int(numbers[run[-1]]) * STRIDE + WINDOW
        total, weight = np.zeros((end - start, LABELS)), np.zeros((end - start, 1))
        for i in run:
            at = int(numbers[i]) * STRIDE - start
            total[at:at + WINDOW] += _WEIGHT * p[i]
            weight[at:at + WINDOW] += _WEIGHT
        yield start, (total / weight)[:length - start]


_DATE = re.compile(r"(?:19|20)[0-9]{2}[^0-9][0-9]{1,2}[^0-9][0-9]{1,2}|[0-9]{1,2}[^0-9][0-9]{1,2}[^0-9](?:19|20)[0-9]{2}")
_PLAUSIBLE_AT = re.compile(r"[^\s@]\s?(?:\(at\))?@\s?[^\s@]")


def plausible(kind: int, span: str) -> bool:
    """The check of an added span."""
    digits = "".join(_DIGIT.findall(span))
    if kind == 0:
        return bool(_PLAUSIBLE_AT.search(span)) and "." in span.split("@")[-1]
    if kind == 1:
        numbers = re.findall("[0-9]+", span)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and len(span) <= 2 * len(digits) and luhn(digits)
    return 8 <= len(digits) <= 15 and len(span) <= 2 * len(digits) and not _DATE.fullmatch(span)


def added_spans(text: str, base: list[tuple[int, int, int]], numbers: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """The model's spans that pass their check and touch no base span."""
    taken, out = np.zeros(len(text) + 1, bool), []
    for _, a, b in base:
        taken[a:b] = True
    for start, score in regions(numbers, p, len(text)):
        path = best_path(np.log(np.maximum(score, 1e-12)).round(9))
        for a in np.flatnonzero(path % 2 == 1):
            kind, b = int(path[a]) // 2, a + 1
            while b < len(path) and path[b] == path[a] + 1:
                b += 1
            span = text[start + a:start + b]
            left, right = len(span) - len(span.lstrip()), len(span.rstrip())
            if right > left and not taken[start + a + left:start + a + right].any() and plausible(kind, span[left:right]):
                out.append((kind, int(start + a + left), int(start + a + right)))
    return out


def _find(model: Tagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = [[m[:3] for m in matches(t) if m[3]] for t in texts]
            spans = [list(s) for s in base]
            if model is not None:
                work = [(i, n, window_codes(c, n)) for i, t in enumerate(texts) if _HINT.search(t)
                        for c in [codes(t)] for n in [window_numbers(c)]]
                flat = np.concatenate([w[2] for w in work]) if work else np.zeros((0, WINDOW), np.uint8)
                p = np.zeros((len(flat), WINDOW, LABELS), np.float32)
                for at in range(0, len(flat), 512):
                    _, log_p, _ = model.marginals(model.emissions(flat[at:at + 512]))
                    p[at:at + 512] = np.exp(log_p).transpose(1, 0, 2)
                at = 0
                for i, numbers, _ in work:
                    spans[i] = sorted(base[i] + added_spans(texts[i], base[i], numbers, p[at:at + len(numbers)]))
                    at += len(numbers)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([sum(s[0] == k for s in one) for one in base], pa.int64()) for k in range(len(KINDS))],
                 pa.array([hashlib.sha256(written(one).encode()).hexdigest() for one in base], pa.string()),
                 pa.array([written(one) for one in spans], pa.string()),
                 pa.array([len(s) - len(one) for s, one in zip(spans, base)], pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return run


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, counts and hash of the base spans, all spans written out, n_added."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _find(model), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
