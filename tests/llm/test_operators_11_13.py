"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from retailops.llm import filter_audit, hard_negatives, pii_tagger

VECTORS = "vec_id bigint, embedding array<float>, label int, anchor boolean, source string"


# ---- 11: hard negatives

def test_residue_products_are_exact():
    rnd = np.random.default_rng(1)
    for bound, dim in ((1 << 8, 64), (1 << 13, 700), (1 << 22, 2500)):
        a, b = rnd.integers(-bound, bound + 1, (7, dim)), rnd.integers(-bound, bound + 1, (9, dim))
        a[0], b[0], b[1] = bound, bound, -bound  # the extremes of the range
        primes = hard_negatives.primes_for(max((a * a).sum(1).max(), (b * b).sum(1).max()))
        got = hard_negatives.scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert got.dtype == np.int64 and (got == a @ b.T).all()


def mined_slowly(rows, positives=5, negatives=3, low=50, high=95):
    def key(s_id):
        return (-s_id[0], s_id[1] is None, s_id[1] or 0)

    clean = []
    for k, (vec_id, vector, label, anchor, _) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            clean.append((k, vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vector], label, anchor))
    out = Counter()
    for k, anchor_id, q, label, anchor in clean:
        if not anchor or anchor_id is None:
            continue
        scored = [(sum(x * y for x, y in zip(q, w)), v, lab) for j, v, w, lab, _ in clean if j != k]
        for p_score, p_id, _ in sorted((s for s in scored if s[2] == label), key=key)[:positives]:
            near = [s for s in scored if s[2] != label and low * p_score <= 100 * s[0] <= high * p_score]
            for rank, (n_score, n_id, _) in enumerate(sorted(near, key=key)[:negatives], 1):
                out[anchor_id, p_id, rank, n_id, p_score, n_score] += 1
    return out


def mined(df):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def vector_rows(n=260, dim=12, seed=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.2, (4, dim))
    return [(k, [float(x) for x in np.float32(centres[k % 4] + rnd.normal(0, 0.15, dim))], int(rnd.integers(0, 4)), k % 20 == 0, "s")
            for k in range(n)]


def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch):
    rows = vector_rows()
    rows += [(None, rows[3][1], 1, True, "s"), (None, rows[5][1], 2, False, "s"), (9001, None, 1, True, "s"), (9002, rows[1][1], None, True, "s"),
             (9003, [0.1, float("nan")] * 6, 1, False, "s"), (9004, [0.1, None] * 6, 1, False, "s"), (9005, [float("inf")] * 12, 1, True, "s"),
             (9006, [], 1, True, "s"), (9007, [0.5, 0.25], 2, True, "s"), (9008, [200.0] * 12, 3, True, "s"), (9009, rows[8][1], 0, None, "s")]
    rows += [rows[0], rows[0], rows[7]]  # repeated rows: an anchor three times, another row twice
    rows += [(10_000 + k, rows[40][1], rows[40][2], False, "s") for k in range(90)]  # one very common vector
    want = mined_slowly(rows)
    assert len(want) > 100
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(hard_negatives.mine(df.repartition(5))) == want
    monkeypatch.setattr(hard_negatives, "ROWS", 16)  # many blocks on both sides
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    assert mined(hard_negatives.mine(df.repartition(3))) == want


def test_hard_negatives_without_rows_and_past_the_exact_range(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, [1.0], 1, True, "s")], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too long"):
        hard_negatives.mine(spark.createDataFrame([(50, [1e9], 1, True, "s")], VECTORS))


def test_cartesian_product_gives_the_same_rows(spark):
    rows = vector_rows(200, seed=9)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert mined(hard_negatives.mine(df)) == mined_slowly(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ---- 12: personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_slowly(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_slowly(text):
    def digits(s):
        return [c for c in s if c in "0123456789"]

    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn_slowly(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_patterns():
    rnd = random.Random(5)
    texts = ["a@b@c.d e@f..g h@i.j.k-l@m.n", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.2.3.4 1..2.3.4", "4111 1111-1111 1111 4111111111111112 12-3",
             "+1 (361) 555-8283, +1234567 +1-- +12345678901234567 ++49 30 1234567", "x.y@z.w" * 3, "é@x.y ٣@x.y a@ä.b 1.2.3.4é5"]
    texts += ["".join(rnd.choice("0123456789.@+- ()ab%_\né") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    for t in texts:
        assert [m[:3] for m in pii_tagger.matches(t) if m[3]] == base_slowly(t), t


def test_patterns_take_linear_time():
    import time
    start = time.time()
    for t in ("a" * 1_000_000 + "1", "1" * 1_000_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000, "1 " * 500_000, "+1 " * 300_000):
        pii_tagger.matches(t)
    assert time.time() - start < 20


def test_network_gradient_is_that_of_the_loss():
    model = pii_tagger.Tagger(embed=3, hidden=4, seed=2)
    rnd = np.random.default_rng(3)
    code, label = rnd.integers(40, 60, (3, 7)).astype(np.uint8), rnd.integers(0, pii_tagger.LABELS, (3, 7)).astype(np.uint8)
    grad = model._gradient(code, label)
    for name, w in model.w.items():
        for _ in range(6):
            at = tuple(rnd.integers(0, n) for n in w.shape)
            if name == "embed":
                at = (int(code[0, 0]), at[1])
            keep, eps = w[at], 1e-5
            w[at] = keep + eps
            up = model.loss(code, label)
            w[at] = keep - eps
            down = model.loss(code, label)
            w[at] = keep
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-6, name


def test_crf_sums_and_best_path_are_those_of_all_paths():
    model = pii_tagger.Tagger(seed=4)
    rnd = np.random.default_rng(5)
    model.w["step"], model.w["first"] = rnd.normal(size=(9, 9)), rnd.normal(size=9)
    score = rnd.normal(size=(4, 1, 9))
    paths = list(itertools.product(range(9), repeat=4))
    logs = np.array([model.w["first"][p[0]] + sum(score[t, 0, p[t]] for t in range(4)) + sum(model.w["step"][p[t], p[t + 1]] for t in range(3))
                     for p in paths])
    total, log_p, _ = model.marginals(score)
    assert abs(total[0] - np.log(np.exp(logs).sum())) < 1e-9
    assert abs(np.exp(log_p[2, 0, 3]) - np.exp(logs - total[0])[[p[2] == 3 for p in paths]].sum()) < 1e-9

    def valid(p):
        return all(x == 0 or x % 2 or (t and p[t - 1] in (x, x - 1)) for t, x in enumerate(p))
    best = max((p for p in paths if valid(p)), key=lambda p: sum(score[t, 0, p[t]] for t in range(4)))
    assert tuple(pii_tagger.best_path(score[:, 0])) == best


def people(rnd, n=700):
    """Texts with a labelled datum each, and harmless numbers."""
    words = "the of and letter river over house table paper number please contact today with from".split()

    def prose(k):
        return " ".join(rnd.choice(words) for _ in range(k))

    def card():
        d = [rnd.randint(0, 9) for _ in range(15)]
        return "".join(map(str, d)) + str(next(c for c in range(10) if luhn_slowly([*d, c])))
    data = [lambda: f"{rnd.choice(words)}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com",
            lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), card,
            lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}",
            lambda: str(rnd.randint(1, 99999)), lambda: f"20{rnd.randint(10, 29)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}"]
    return [f"{prose(rnd.randint(4, 30))} {data[k % 6]()} {prose(rnd.randint(4, 30))}" for k in range(n)]


@pytest.fixture(scope="module")
def tagger(spark):
    texts = people(random.Random(6))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return pii_tagger.fit(docs, per_kind=110)


def test_tagger_finds_new_forms_and_leaves_clean_text(spark, tagger):
    # held-out: forms the patterns miss, other numbers
    rnd = random.Random(77)
    rows, truth = [], {}
    for k in range(120):
        d = f"{rnd.randint(200, 999)}-555-{rnd.randint(1000, 9999)}"
        form = (f"({d[:3]}) {d[4:]}", d, d.replace("-", "."))[k % 3]
        text = f"please contact the house over {form} today with the paper"
        at = text.index(form)
        truth[k] = f"phone:{at}:{at + len(form)}"
        rows.append((k, text))
    rows += [(1000 + k, t) for k, t in enumerate(people(rnd, 300)[4::6] + people(rnd, 300)[5::6])]
    got = {r.doc_id: r.spans for r in pii_tagger.find(spark.createDataFrame(rows, "doc_id bigint, text string"), tagger).collect()}
    assert sum(got[k] == truth[k] for k in truth) >= 0.85 * len(truth)
    clean = [got[d] for d, _ in rows if d >= 1000]
    assert sum(s != "" for s in clean) <= 0.03 * len(clean)


def test_pii_rows_on_odd_texts(spark, tagger):
    long = ("the letter 4111111111111111 and " + "word " * 300) * 40 + "a.b@c.example"
    texts = [None, "", " \n", "no data", "a.b@c.example", "a.b@c.example", "1" * 5000, "é 10.0.0.1 \U0001F600 +49 30 1234567", long, "1.2.3." * 900]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "10.0.0.1", "x"), (4, "10.0.0.1", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string").repartition(3)
    for model in (tagger, None):
        got = pii_tagger.find(df, model).collect()
        assert len(got) == len(rows)
        want = Counter()
        for d, t, _ in rows:
            spans = base_slowly(t or "")
            want[(d, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(
                ",".join(f"{pii_tagger.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
        for r in got:  # base spans stay, spans are in order and apart
            spans = [(pii_tagger.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
            assert spans == sorted(spans) and len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert pii_tagger.find(df.limit(0), tagger).count() == 0
    assert pii_tagger.fit(df.limit(0)) is None


def test_windows_are_reconciled_over_their_edges(tagger):
    text = "word " * 11 + "+1 (361) 555-8283" + " word" * 20  # the span crosses an edge of the first window
    code = pii_tagger.codes(text)
    numbers = pii_tagger.window_numbers(code)
    assert len(numbers) >= 2
    _, log_p, _ = tagger.marginals(tagger.emissions(pii_tagger.window_codes(code, numbers)))
    spans = pii_tagger.added_spans(text, [], numbers, np.exp(log_p).transpose(1, 0, 2))
    assert [text[a:b] for k, a, b in spans] == ["+1 (361) 555-8283"]


# ---- 13: filter audit

DOCS = "doc_id bigint, text string, lang string, part string"


def audited_slowly(docs, labels):
    def fails(text, doc_id):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        twins = [d for d, t, _ in docs if (t or "") == text]
        known = [d for d in twins if d is not None]
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": any(doc_id is None or d < doc_id for d in known)}
    failing = [(lang or "", {f for f, bad in fails(t or "", d).items() if bad}, any(x == d and q == 1 for x, q, _ in labels if x is not None),
                any(x == d and y == 1 for x, _, y in labels if x is not None)) for d, t, lang in docs]
    out = Counter()
    for part in {p for p, *_ in failing}:
        mine = [f for f in failing if f[0] == part]
        totals, rows = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                totals[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(f in m[1] for m in mine) - len(gone),
                             sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
        for r in rows:
            out[(*r, totals[r[1][r[2] - 1]])] += 1
    return out


def test_audit_is_that_of_all_orders(spark):
    rnd = random.Random(8)

    def text():
        n = rnd.choice([3, 99, 100, 140])
        pool = [f"w{k}" for k in range(rnd.choice([40, 400]))]
        t = rnd.choice([" ", "\n", "\t\x0b", "\x0c\r "]).join(rnd.choice(pool) for _ in range(n))
        return (t.upper() if rnd.random() < 0.2 else t) + rnd.choice(["", "", " #", "|", "\x1c", "é"])
    texts = [text() for _ in range(40)] + [None, "", " ", "A", "x\x1cy " * 120, "wörd " * 150]
    docs = [(k, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (None, "only null ids", "en"), (None, "only null ids", "de"), (7, texts[1], "en"), (7, texts[1], "en")]
    labels = [(rnd.choice([None, *range(160)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(120)]
    df = spark.createDataFrame([(d, t, lang, "z") for d, t, lang in docs], DOCS).repartition(4)
    lab = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = filter_audit.audit_orders(filter_audit.document_masks(df, lab)).collect()
    assert Counter(tuple(r) for r in got) == audited_slowly(docs, labels)
    assert filter_audit.audit_orders(filter_audit.document_masks(df.limit(0), lab)).count() == 0
    assert filter_audit.audit_orders(filter_audit.document_masks(df, lab.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0


def test_lattice_counts_paths():
    lattice = filter_audit.Lattice(5)
    assert (lattice.forward * lattice.backward).sum() == 6 * 120  # every order passes one state of each size
    assert lattice.forward[-1] == lattice.backward[0] == 120
    removed = np.ones((32, 5), np.int64)
    assert (lattice.shapley(removed * lattice.edge) == 120).all()  # each order applies each filter once
