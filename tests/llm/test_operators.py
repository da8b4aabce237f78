"""The ten operators against brute force, exact round trips and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from retailops.llm import (bpe_tree, context_mixing, decontaminate, html_extract, language_id, quality_rules,
                           simhash_dedup, token_counts, token_file, url_filter)
from retailops.llm.queries import URL_RULES

SCHEMA = "doc_id bigint, text string, lang string, source string, held_out boolean, fp string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river "
         "and nobody in the village knows why they came or when they will leave again before the winter snow")


def odd_texts():
    """Null, empty, white space, ties, very long, and characters of many kinds."""
    rnd = random.Random(3)
    alphabet = " \n\t'abcsTDéİßÀ.,!?#%1234▁ 　中文́\x00\x1c😀—“σΣ"
    texts = [None, "", " \n\t ", "a", PROSE, PROSE, "x" * 9000, (PROSE + "\n") * 60, "a b " * 3000, "<|endoftext|> <s> it's 'LL",
             "".join(rnd.choice("thernsio") for _ in range(9000))]
    return texts + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(120)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s", True, "z") for k, t in enumerate(odd_texts())]
    rows += [(None, PROSE, None, None, None, None), (4, PROSE, "en", "s", False, "q")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def as_set(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# ---- 10: token counts

def test_token_counts_are_the_librarys(odd, empty):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((d, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 50) for d, t in texts_of(odd))
    for entries in (5, 10_000):  # a small first tier changes nothing
        got = token_counts.token_counts(odd, PIECES, limit=50, entries=entries)
        assert as_set(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_frequent_lengths_of_copies_and_derived_rows(spark):
    # 40,000 copies of one text are sampled row by row; a derived frame needs no file of its own
    docs = spark.range(40_000).selectExpr("id AS doc_id", f"'{PROSE}' AS text").where("doc_id % 2 = 0")
    rows = docs.select("text").sample(200 / 20_000, seed=10).count()
    assert 100 < rows < 300
    table = token_counts.frequent_lengths(docs, PIECES, entries=12, sample=200)
    assert len(table) == 12 and set(table) <= set(token_counts.segments(PROSE))


def test_frequent_lengths_are_of_all_rows(spark, monkeypatch):
    # word k occurs 40 + k times in 9,000 or more rows; a sample of them ranks near neighbours otherwise
    docs = spark.createDataFrame([(f"w{k:03d}",) for k in range(120) for _ in range(40 + k)] + [(None,), ("",), ("x" * 65,)], "text string").repartition(5)
    monkeypatch.setattr(token_counts, "HELD", 50)  # counts are handed on in parts
    assert set(token_counts.frequent_lengths(docs, PIECES, entries=30)) == {f" w{k:03d}" for k in range(90, 120)}
    tied = spark.createDataFrame([("b a\nc",), ("c b",), ("x" * 65,)], "text string")
    assert set(token_counts.frequent_lengths(tied, PIECES)) == {" b", "\n", " a", " c", "c"}
    some = token_counts.frequent_lengths(tied, PIECES, entries=3)
    assert len(some) == 3 and " b" in some and not token_counts.frequent_lengths(tied.limit(0), PIECES)


def test_length_cache_starts_anew():
    cache = token_counts.Lengths({"a": 1}, len, limit=2)
    assert [cache[x] for x in ("a", "bb", "ccc", "dddd", "bb")] == [1, 2, 3, 4, 2] and len(cache) <= 3 and cache["a"] == 1


# ---- 8: BPE

@pytest.mark.parametrize("leaf", [2, 7, 64, 4096])
def test_tree_encoding_is_the_librarys(leaf):
    import tiktoken
    ranks = bpe_tree.read_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree = bpe_tree.TreeBPE(ranks, public_tokenizers.PATTERN, leaf)
    for t in [x or "" for x in odd_texts()] + ["b'll" * 200, "'s" * 500, "x1" * 900, " " * 3000 + "a", "é" * 2000]:
        ids = tree.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert tree.decode(ids) == t.encode()


def test_round_trip_digests(odd, empty):
    import tiktoken
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.read_ranks(RANKS), special_tokens={})

    def digest(t):
        ids = lib.encode_ordinary(t)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    got = bpe_tree.bpe_round_trip(odd, RANKS, public_tokenizers.PATTERN, leaf=32)
    assert as_set(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((d, *digest(t)) for d, t in texts_of(odd))
    back = bpe_tree.bpe_decode(bpe_tree.bpe_encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.text)) for r in back.collect()) == Counter((d, t.encode()) for d, t in texts_of(odd))
    assert bpe_tree.bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- 6: token-id files

def test_variable_length_code_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        x = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        assert (token_file.unpack(*token_file.pack(x), n) == x).all()
    counts, ranks = token_file.unpack_block(token_file.pack_block([2, 0, 1], np.array([5, 300, 70000])))
    assert counts.tolist() == [2, 0, 1] and ranks.tolist() == [5, 300, 70000]


def test_id_files_hold_the_librarys_ids(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(WORDS)
    path = f"file://{tmp_path}/ids"
    token_file.write_ids(odd, WORDS, path)
    rows = sorted(token_file.read_ids(spark, path).collect(), key=lambda r: r.start)
    want = {}
    for d, t in texts_of(odd):
        want.setdefault(d, []).append(lib.encode(t, add_special_tokens=False).ids + [1])
    at = 0
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and list(r.ids) in want[r.doc_id]
        at += r.n_tokens
    digests = token_file.id_file_digests(odd, WORDS)
    assert as_set(digests, "doc_id", "start", "n_tokens", "ids_crc32") == Counter(
        (r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)
    assert token_file.id_file_digests(empty, WORDS).count() == 0


# ---- 9: SimHash

def slow_fingerprint(text, width=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius):
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                name[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[root(k)] for k in range(len(rows))]


def test_simhash_components_against_all_pairs(odd, empty):
    got = simhash_dedup.simhash_components(odd, width=4, radius=4)
    rows = [(d, slow_fingerprint(t)) for d, t in texts_of(odd)]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, slow_components(rows, 4)))
    assert as_set(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash_dedup.simhash_components(empty).count() == 0


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_connect_what_the_radius_connects(spark, tile):
    """Groups of fingerprints a few bits apart, hot keys dealt out in small tiles."""
    rnd = random.Random(5)
    fps = []
    for size in (60, 9, 2, 1, 1):
        f = rnd.getrandbits(64)
        for _ in range(size):
            fps.append(f)
            for _ in range(rnd.randint(1, 5)):
                f ^= 1 << rnd.randrange(64)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash_dedup._signed(f),) for f in fps], "fp bigint")
    got = simhash_dedup.components(simhash_dedup.links(df, 4, tile))
    group = {r.node: r.root for r in got.collect()}
    mine = [group.get(simhash_dedup._signed(f), simhash_dedup._signed(f)) for f in fps]
    theirs = slow_components(list(enumerate(fps)), 4)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_large_group_has_one_name(spark, monkeypatch):
    # a chain of fingerprints, each one bit from the next, beside some without a link
    chain = [(1 << k) - 1 for k in range(64)]
    alone = [0x5555555555555555, 0x3333333333333333]
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, width: docs.selectExpr("doc_id", "cast(text AS bigint) AS fp"))
    rows = [(900 - k, str(f if f < 1 << 63 else f - (1 << 64))) for k, f in enumerate(chain + alone)]
    got = {r.doc_id: r.component_id for r in simhash_dedup.simhash_components(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: (837 if d >= 837 else d) for d, _ in rows}


def test_bit_sliced_distances():
    rnd = np.random.default_rng(2)
    for radius in (0, 1, 3, 4, 7, 9):
        base = rnd.integers(0, 1 << 63, 3, dtype=np.uint64)
        fps = np.concatenate([base ^ np.uint64(m) for m in (0, 1, 3, 7, 15, 31, 255, 1023, 65535)] + [rnd.integers(0, 1 << 63, 50, dtype=np.uint64)])
        near = simhash_dedup.within(fps, simhash_dedup._planes(fps), len(fps), radius)
        want = [[bin(int(a) ^ int(b)).count("1") <= radius for b in fps] for a in fps]
        assert near.tolist() == want
    far = simhash_dedup._planes(np.array([2**64 - 1] * 64, np.uint64))
    assert simhash_dedup.within(np.zeros(2, np.uint64), far, 64, 4) is None  # abandoned


def test_keep_first_leaves_one_of_each_group(spark, odd):
    kept = simhash_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [(d, slow_fingerprint(t)) for d, t in texts_of(odd)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(rows, 4)))
    none = spark.createDataFrame([(None, PROSE), (None, PROSE)], "doc_id bigint, text string")
    assert simhash_dedup.keep_first(none).count() == 1


def test_keep_first_tells_components_apart_by_text(spark):
    a, b = PROSE, " ".join(f"other{k}" for k in range(60))
    rows = [(5, a), (7, a), (5, b), (9, b), (None, "lone words of a null id"), (None, "lone words of a null id")]
    for shuffled in (rows, rows[::-1]):
        kept = simhash_dedup.keep_first(spark.createDataFrame(shuffled, "doc_id bigint, text string")).collect()
        assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, a), (5, b), (None, rows[4][1])])


def test_linked_rows_without_an_id_leave_one(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "fingerprint", lambda t, width: {"p": 0, "q": 3, "r": 2**40 - 1}[t])
    docs = spark.createDataFrame([(None, "p"), (None, "q"), (None, "r")], "doc_id bigint, text string")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, width: docs.selectExpr(
        "doc_id", "CASE text WHEN 'p' THEN 0L WHEN 'q' THEN 3L ELSE 1099511627775L END AS fp"))
    monkeypatch.setattr(simhash_dedup, "_with_fingerprint", lambda docs, name, width: docs.selectExpr(
        "*", f"CASE text WHEN 'p' THEN '{0:016x}' WHEN 'q' THEN '{3:016x}' ELSE '{2**40 - 1:016x}' END AS {name}"))
    kept = [r.text for r in simhash_dedup.keep_first(docs).collect()]
    assert len(kept) == 2 and "r" in kept


# ---- 7: decontamination

def slow_contaminated(docs, items, similarity=0.8):
    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    grams = lambda w: Counter(" ".join(w[i:i + 5]) for i in range(len(w) - 4))
    classes = {}
    for i, t in items:
        w = tuple(words(t))
        if len(w) >= 5:
            classes[w] = min(i, classes.get(w, i))
    out = set()
    for d, t in docs:
        w = words(t)
        for item, i in classes.items():
            b, best = grams(item), None
            for s in range(len(w) - len(item) + 1):
                a = grams(w[s:s + len(item)])
                v = sum((a & b).values()) / sum((a | b).values())
                if v >= similarity and (best is None or v > best[0]):
                    best = (v, s)
            if best:
                out.add((d, i, round(best[0], 9), best[1]))
    return out


def test_contaminated_against_all_windows(spark, odd, empty):
    w = PROSE.split()
    items = [(1, " ".join(w[3:25])), (2, " ".join(w[3:25]).upper()), (3, " ".join(w[20:30])), (4, "too short"), (5, None), (6, ""),
             (7, "a b " * 10), (8, "none of these words occurs in any text here at all")]
    extra = [(900, " ".join(["so", *w[:14], "changed", *w[15:]]), "en", "s", True, "x"), (901, " ".join(w[10:26] + w[3:10]), "en", "s", True, "x"),
             (902, "Near. " + ", ".join(w[1:27]) + "! end", None, None, None, None)]
    docs = odd.unionByName(spark.createDataFrame(extra, SCHEMA))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = slow_contaminated(texts_of(docs), items)
    assert {d for d, *_ in want} >= {902, 4}
    for part in (500_000, 3):  # the index in one part and in many
        got = decontaminate.contaminated(docs, bench, part=part)
        assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in got.collect()} == want
    clean = decontaminate.keep_clean(docs, bench)
    bad = {d for d, *_ in want}
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in texts_of(docs) if d not in bad)
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_documents_shorter_than_the_item(spark):
    """A cut item is one window, the whole document."""
    grams = lambda w: Counter(" ".join(w[i:i + 5]) for i in range(len(w) - 4))
    w = PROSE.split()
    item = w[:38]
    docs = [(0, item[:-1]), (1, item[:34]), (2, item[3:]), (3, item[:30]), (4, item[:15] + ["new"] + item[16:36]), (5, item[:4]),
            (6, []), (7, item[:20] + item[21:]), (8, item), (None, item[1:-1])]
    want = set()
    for d, x in docs:
        a, b = grams(x), grams(item)
        v = sum((a & b).values()) / sum((a | b).values())
        if v >= 0.8:
            want.add((d, 1, round(v, 9), 0))
    assert {d for d, *_ in want} >= {0, 1, 2, 8, None} and not {d for d, *_ in want} & {3, 5, 6}
    frame = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id bigint, text string")
    got = decontaminate.contaminated(frame, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in got.collect()} == want


def test_items_without_an_id_and_with_a_shared_one(spark, monkeypatch):
    w = PROSE.split()
    items = [(None, w[:12]), (None, w[12:24]), (3, w[12:24]), (5, w[20:32]), (5, w[:8] + w[30:36])]
    docs = [(0, w[:13]), (1, w[11:25]), (2, w[19:33]), (3, w[:8] + w[30:36]), (4, w[24:30])]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id bigint, text string")
    frame = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id bigint, text string")
    for width in (16, 32):  # the lanes of ordinary and of very long items
        monkeypatch.setattr(decontaminate, "_lane_width", lambda items, width=width: width)
        got = decontaminate.contaminated(frame, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(0, None), (1, 3), (2, 5), (3, 5)}
    assert [r.doc_id for r in decontaminate.keep_clean(frame, bench).collect()] == [4]


def test_long_items_and_repeated_shingles(spark):
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(5000)}" for _ in range(3000)]
    item = words[200:1700]
    near = list(item)
    for k in range(0, 1500, 90):
        near[k] = "new"
    again = "a b c d e f ".split() * 40
    docs = [(0, words), (1, ["x"] * 700 + near + ["y"] * 300), (2, words[:900]), (3, again[3:] + ["end"]), (4, again[:100])]
    items = [(1, item), (2, again)]
    frame = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in decontaminate.contaminated(frame, bench).collect()}
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    a, b = grams(near), grams(item)
    assert got.pop((0, 1)) == (1.0, 200)
    assert got.pop((1, 1)) == (round(sum((a & b).values()) / sum((a | b).values()), 9), 700)
    a, b = grams(again[3:] + ["end"]), grams(again)
    assert got == {(3, 2): (round(sum((a & b).values()) / sum((a | b).values()), 9), 0)}


# ---- 4: quality rules

def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_and_verdicts(odd, empty):
    got = quality_rules.quality(odd)
    want = Counter()
    for d, t in texts_of(odd):
        c = slow_counts(t)
        want[(d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert as_set(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("kept AND base_failed").count() == 0
    assert got.where("kept IS NULL OR p_good IS NULL").count() == 0
    kept = quality_rules.keep_good(odd)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got.where("kept").collect())
    assert quality_rules.quality(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_repeated_windows_with_large_vocabularies():
    rnd = random.Random(4)
    words = [str(rnd.randrange(9000)).encode() for _ in range(30_000)]
    words += words[500:700]
    text = b" ".join(words).decode()
    assert quality_rules.repeated_words(words)[0] == slow_counts(text)[4]


def test_rules_are_weighed_by_the_documents(spark, small_dir):
    """Held against labels that the model never sees."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    r = quality_rules.quality(docs).join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {x.quality: x.share for x in r}
    assert share[1] > 0.9 and share[0] < 0.2


# ---- 1: language ID

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
    model = language_id.fit(docs.where("not held_out"))
    zeros = (model.table == 0).mean()
    assert zeros > 0.3  # elastic net leaves a sparse table
    got = language_id.identify(docs, model).where("held_out and lang is not null")
    n, right, low, high = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right / n > 0.97 and 0 <= low <= high <= 1


def test_language_of_odd_texts(odd, empty):
    model = language_id.fit(odd)
    got = language_id.identify(odd.select("doc_id", "text", "source"), model)
    assert got.columns == ["doc_id", "source", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert [(by[k].lang_pred, by[k].score) for k in (0, 1, 2)] == [("und", 0.0)] * 3 and by[4].lang_pred == "en"
    nothing = language_id.fit(empty)
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd.select("doc_id", "text"), nothing).collect()} == {("und", 0.0)}
    assert language_id.keep_identified(odd, nothing).where("doc_id = 4").count() == 2
    assert language_id.identify(empty.select("doc_id", "text"), model).count() == 0


def slow_features(text, idf):
    """Hashed 1- to 3-grams one by one: share among the text's characters times idf."""
    codes = [ord(c) for c in text.lower()] + [0, 0, 0]
    total = Counter()
    for i in range(len(codes) - 3):
        h = 0
        for k in range(3):
            h = ((h ^ codes[i + k]) * int(language_id._MULT[k]) + k + 1) % 2**32
            total[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 16] += 1
    return {b: n / max(1, len(codes) - 3) * idf[b] for b, n in total.items()}


def test_features_and_frequencies_are_those_of_single_grams(spark):
    texts = ["", "a", "Ab", "the quick brown fox", "été à Noël " * 3, "\U0001F600x" * 5, "aaaa" * 50, "İstanbul"]
    idf = np.random.default_rng(3).random(language_id.BUCKETS) + 1
    for t in texts:
        at, value = language_id._features(t, idf)
        want = slow_features(t, idf)
        assert set(at.tolist()) == set(want) and all(abs(value[i] - want[b]) < 1e-12 for i, b in enumerate(at.tolist()))
    df, n = language_id.document_frequencies(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3))
    slow = Counter(b for t in texts for b in slow_features(t, idf))
    assert n == len(texts) + 1 and {b: c for b, c in enumerate(df.tolist()) if c} == dict(slow)


def test_ftrl_takes_the_papers_steps():
    """Each coordinate by itself, in plain numbers, over the same order of rows."""
    rnd = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        at = np.sort(rnd.choice(8, 3, replace=False))
        rows.append((at, rnd.random(3), int(rnd.integers(0, 3))))
    alpha, beta, l1, l2 = 2.0, 1.0, 0.002, 0.01
    z, n = Counter(), Counter()

    def weight(i, c):
        v = z[i, c]
        if abs(v) <= l1:
            return 0.0
        return -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[i, c])) / alpha + l2)
    for epoch in range(2):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            dots = [sum(x[j] * weight(i, c) for j, i in enumerate(at)) for c in range(3)]
            top = max(dots)
            e = [math.exp(d - top) for d in dots]
            p = [v / sum(e) for v in e]
            new = {}
            for j, i in enumerate(at):
                for c in range(3):
                    g = (p[c] - (c == y)) * x[j]
                    sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha
                    new[i, c] = (z[i, c] + g - sigma * weight(i, c), n[i, c] + g * g)
            for key, (zz, nn) in new.items():
                z[key], n[key] = zz, nn
    got = language_id.ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert all(abs(got[i, c] - weight(i, c)) < 1e-12 for i in range(8) for c in range(3))
    assert not got[8:].any()


def test_temperature_is_the_best_of_a_dense_grid():
    rnd = np.random.default_rng(5)
    for scale in (0.2, 1.0, 6.0):
        y = rnd.integers(0, 3, 400)
        z = rnd.normal(0, 1, (400, 3))
        z[np.arange(400), y] += 1
        z *= scale

        def loss(t):
            e = np.exp(z / t - (z / t).max(1, keepdims=True))
            return -np.log(e[np.arange(400), y] / e.sum(1)).mean()
        got = language_id._temperature(z, y)
        assert loss(got) <= min(loss(t) for t in np.geomspace(0.02, 20, 4000)) + 1e-5
    assert language_id._temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_a_tie_goes_to_the_first_language():
    model = language_id.Model(["de", "en"], np.ones((language_id.BUCKETS, 2)), 1.0)
    assert model.predict(["abc", "", "12"]) == (["de", "und", "und"], [0.5, 0.0, 0.0])


def test_prediction_does_not_depend_on_the_batch():
    rnd = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rnd.normal(size=(language_id.BUCKETS, 2)), 1.0)
    texts = [t or "" for t in odd_texts()]
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together == ([a[0][0] for a in alone], [a[1][0] for a in alone])


# ---- 3: URL filter

def test_url_parts_rules_and_model(spark):
    import duckdb
    rnd = random.Random(6)
    hosts = ["Example.com", "a.example.com", "www.example.com", "x.net", "net", "notexample.com", "y.org", "z.org"]
    urls = [None, "", "nonsense", "http://", "http://com", "http://com/", "https://NET/es/x?y#z", "http://x.net/fr", "ftp://x.net/fr/", "http://y.org/ü/中?q"]
    urls += [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randint(1, 99)}{rnd.choice(['', '.html', '?a=b', '#t'])}" for _ in range(150)]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)] + [(None, "http://x.net/es/1", "q"), (3, "http://y.org/", "q")],
                                  "page_id bigint, url string, verdict string")
    got = url_filter.judge(pages, URL_RULES)
    by = {r.page_id: r for r in got.collect()}
    assert (by[0].host, by[0].path, by[0].rule) == ("", "", None) and by[4].path == "" and by[4].rule is None
    assert (by[5].rule, by[5].verdict) == ("com/", "allow") and (by[6].host, by[6].path, by[6].rule) == ("net", "/es/x", "net/es/")
    assert by[7].rule is None and by[8].rule == "net/fr/"
    view = pages.drop("verdict").toPandas()  # noqa: F841  read by DuckDB below
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT AS page_id, url FROM view")
    want = Counter(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.oracle_sql(URL_RULES)})").fetchall())
    assert as_set(got, "page_id", "host", "path", "rule", "verdict") == want
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    none = url_filter.judge(pages, [])
    assert none.where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


# ---- 5: HTML extraction

def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body, text", [
    ("<nav><ul><li>Home</li></ul></nav><article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four<ul><li>x<li>y</ul></article><footer>f</footer>",
     "A & B\none two three\nfour\nx\ny"),
    ("<header>site</header><main><header>kept</header><p>t<script>var a='</p>';</script>u</p><aside>no</aside></main>", "kept\ntu"),
    ("<article><p>a<!-- <p>no</p> --> b</p><div class='reader-comments'><p>no</p></div><form><p>no</p></form></article>", "a b"),
    ("<div class=\"cookie-notice\">no</div><article><p title='a > b'>&eacute;&#233;&nbsp;x</p></article>", "éé x"),
    ("<p>plain &lt;page&gt;</p><div id=ad1 class=ad>no</div><p hidden>no</p>", "plain <page>"),
    ("", ""),
])
def test_main_text_of_a_page(body, text):
    assert html_extract.main_text(html_extract.read(page(body)), set()) == text


@pytest.mark.parametrize("source, text", [
    ("<body class='has-sidebar'><article><p>a</p></article></body>", "a"),
    ("<body class='has-sidebar'><p>a</p></body>", "a"),
    ("<html class=search><main id=search><p>a</p></main></html>", "a"),
    ("<article class='post comments-open'><p>a</p><div class=comments><article class=comment>no</article></div></article>", "a"),
    ("<div id=content class='with-sidebar'><article><p>a</p></article><div class=sidebar>no</div></div>", "a"),
    ("<div class='page-header-menu'><main><div class='with-sidebar'><article>a</article><div class=share>no</div></div></main></div>", "a"),
    ("<main><article>a</article><article class='share'>b</article><section class=comments><article>no</article></section></main>", "a\nb"),
])
def test_names_do_not_count_on_what_holds_the_text(source, text):
    assert html_extract.main_text(html_extract.read(source), set()) == text


def test_template_of_a_host(spark):
    """Pages without an article: what all pages share is the template, the slots remain."""
    rnd = random.Random(7)
    rows, want = [], {}
    for k in range(12):
        lines = [" ".join(rnd.choices(PROSE.split(), k=9)) for _ in range(rnd.randint(1, 4))]
        body = "<div class=top>Our site greets you</div><div class=x>" + "".join(f"<p>{x}</p>" for x in lines) + "</div><div>All rights kept</div>"
        rows.append((k, "http://a.org/1", page(body)))
        want[k] = "\n".join(lines)
    rows += [(50, None, None), (51, "x", ""), (52, "http://b.org/", "no tags"), (53, "http://b.org/", "<p>a</p></div></p><b>c")]
    want |= {50: "", 51: "", 52: "no tags", 53: "a\nc"}
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    got = html_extract.extract(pages)
    assert {r.page_id: r.text for r in got.collect()} == want
    assert got.where("n_chars <> length(text)").count() == 0
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_template_text_inside_articles(spark):
    """Fixed text in an article is the article's, but for a slot of its own at the end that holds nothing else."""
    bodies = {
        "a": lambda k: f"<nav>x</nav><article><h1>title {k}</h1><p>text {k}</p><div class='box'><p>Read our newsletter</p></div></article>",
        "b": lambda k: f"<article><p>text {k}</p><div><p>{'same' if k % 8 < 3 else k}</p></div></article>",
        "c": lambda k: f"<article><h2>Summary</h2><p>text {k}</p><h2>References</h2><p>more {k}</p></article>",
        "d": lambda k: f"<article><p class='lead'>Abstract</p><p>text {k}</p><h2>The end</h2></article>",
        "e": lambda k: f"<article><p>text {k}</p><p>A closing line</p></article>",
        "f": lambda k: f"<article><p class='share-price'>Shares at 4</p><p class='search-results'>found {k}</p></article>",
        "g": lambda k: f"<div class='with-sidebar'><p>text {k} of a page</p><div class='sidebar'>menu</div></div>",
        "h": lambda k: f"<div class='sidebar-layout'><p>text {k} of a page that is long</p><div class='sidebar'>menu</div></div>"}
    keep = {"a": lambda k: f"title {k}\ntext {k}", "b": lambda k: f"text {k}\n{'same' if k % 8 < 3 else k}",
            "c": lambda k: f"Summary\ntext {k}\nReferences\nmore {k}", "d": lambda k: f"Abstract\ntext {k}\nThe end",
            "e": lambda k: f"text {k}\nA closing line", "f": lambda k: f"Shares at 4\nfound {k}", "g": lambda k: f"text {k} of a page",
            "h": lambda k: f"text {k} of a page that is long"}
    rows, want = [], {}
    for j, (host, body) in enumerate(bodies.items()):
        for k in range(10 * j, 10 * j + 8):
            rows.append((k, f"http://{host}.org/1", page(body(k))))
            want[k] = keep[host](k)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def slow_template(pages):
    """Equivalence classes of one host from whole occurrence vectors, nested by brute force."""
    reads = [html_extract.read(x) for x in dict.fromkeys(pages)]
    vectors, parents, texts = {}, {}, {}
    for k, p in enumerate(reads):
        for path, n in p.paths.items():
            vectors.setdefault(path, [0] * len(reads))[k] += n
            parents.setdefault(path, set()).add(p.parents[path])
        for b in p.blocks:
            t = html_extract._text_token(b)
            vectors.setdefault(t, [0] * len(reads))[k] += 1
            parents.setdefault(t, set()).add(b.path)
            texts.setdefault(b.path, []).append(t)
    often = {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= 3 and 2 * sum(map(bool, v)) >= len(reads)}
    valid = {t for t in often if sum(v == often[t] for v in often.values()) > 1}
    while True:
        more = {t for t in often if t not in valid and min(parents[t]) in valid}
        if not more:
            break
        valid |= more
    seen = {path: sum(any(b.path == path for b in p.blocks) for p in reads) for path in texts}
    slots = {html_extract._slot_token(path) for path, t in texts.items()
             if set(t) <= valid and seen[path] >= 3 and 2 * seen[path] >= len(reads)}
    return valid | slots


def test_template_is_that_of_whole_vectors(spark):
    rnd = random.Random(21)
    hosts = {}
    for h in range(5):
        fixed = [f"<div class=c{rnd.randrange(4)}><p>{rnd.choice('xyz')} fixed {j}</p></div>" for j in range(3)]
        hosts[f"h{h}.org"] = [page("".join([*fixed[:rnd.randint(1, 3)], "<ul>" + "".join(f"<li>{rnd.choice('abc')}" for _ in range(rnd.randint(0, 3))) + "</ul>",
                                            f"<article><h1>{k}</h1>" + "<p>same</p>" * rnd.randint(0, 2) + "</article>"])) for k in range(rnd.randint(2, 9))]
    rows = [(k, h, x) for h, pages in hosts.items() for k, x in enumerate([*pages, pages[0]])]
    frame = spark.createDataFrame(rows, "page_id bigint, host string, html string").repartition(4)
    got = {r.host: set(r.template) for r in html_extract.templates(frame).collect()}
    assert {h: got.get(h, set()) for h in hosts} == {h: slow_template(pages) for h, pages in hosts.items()}


def test_reading_takes_linear_time():
    import time
    for unit in ('<a "', "<a '>", "<b><hr>", "<noscript>", "<!x", "<li><b>", "</i><b>", '<a b="', "<p><b>", "<div>", "&amp", "<td><i></p>"):
        start = time.time()
        html_extract.read(unit * (1_000_000 // len(unit)))
        assert time.time() - start < 12, unit
    start = time.time()
    html_extract.read('<a "' * 250_000)
    assert time.time() - start < 2


def test_nesting_does_not_depend_on_the_order():
    import pyarrow as pa
    chain = [[{"token": t, "parent": t - 1}] for t in range(3, 9)]
    pair = [{"token": 1, "parent": 0}, {"token": 2, "parent": 1}]
    other = [[{"token": 21, "parent": 20}]]
    for classes in (chain + [pair] + other, other + [pair] + chain[::-1]):
        (b,) = html_extract._nested([pa.RecordBatch.from_pydict({"host": ["a"], "classes": [classes]})])
        assert sorted(b.column("template").to_pylist()[0]) == list(range(1, 9))


def test_copies_are_one_page_of_a_host(spark):
    """Copies alone, and copies that are half of a host's pages, keep their text."""
    def body(text):
        return page(f"<div class=top>Our site greets you</div><div class=x><p>{text}</p><p>{text} again</p></div>")
    rows = [(k, "http://a.org/1", body("only this")) for k in range(4)]
    rows += [(k, "http://b.org/1", body("copied")) for k in range(10, 18)] + [(k, "http://b.org/1", body(f"other {k}")) for k in range(20, 24)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    greeting = "Our site greets you\n"
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert {got[k] for k in range(4)} == {greeting + "only this\nonly this again"}
    assert {got[k] for k in range(10, 18)} == {"copied\ncopied again"}
    assert all(got[k] == f"other {k}\nother {k} again" for k in range(20, 24))


# ---- 2: LM scoring

def test_lm_counts_base_and_score(odd, empty):
    docs = odd.withColumn("held_out", F.coalesce(F.pmod(F.col("doc_id"), F.lit(7)) == 2, F.lit(False)))
    got = context_mixing.score(docs)
    rows = [(r.doc_id, bool(r.held_out), (r.text or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    seen = Counter(w for _, held, ws in rows if not held for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = Counter((d, held, len(ws), sum(seen[w] > 0 for w in ws), n,
                    round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, held, ws in rows)
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect())
    assert have == want
    assert got.where("score IS NULL OR isnan(score) OR score >= 0").count() == 0
    small = context_mixing.score(docs, frequent=3)  # nearly all types are joined: the same scores
    assert {(r.doc_id, round(r.score, 6)) for r in small.collect()} == {(r.doc_id, round(r.score, 6)) for r in got.collect()}
    assert context_mixing.score(empty).count() == 0


def test_prefix_counts_are_exact():
    words = sorted([b"the", b"then", b"them", b"there", b"thesis", b"a", b"there"])
    counts, classes = np.array([5, 1, 2, 3, 4, 1, 7]), np.array([0, 0, 1, 0, 1, 0, 1])
    x = context_mixing.Spelled(words, classes, counts)
    for by_class in (False, True):
        found = x.prefixes(by_class)
        for k in range(len(x.flat)):
            i, j = x.owner[k], x.at[k]
            if j < context_mixing.SHARED:
                continue
            for t in range(8):
                def shares(bits):
                    mine = int.from_bytes(x.words[i][:j + 1], "big") >> 8 - bits
                    return sum(c for w, c, cl in zip(x.words, counts, classes) if len(w) > j and (not by_class or cl == classes[i])
                               and int.from_bytes(w[:j + 1], "big") >> 8 - bits == mine)
                assert (found[t][0][k], found[t][1][k]) == (shares(t), shares(t + 1))


def test_prefix_counts_reach_the_end_of_long_tokens():
    long = b"http://" + b"a" * 90
    words = sorted([long, long, long + b"/b", long[:60] + b"/c", b"httq", "\u4e2d".encode() * 40])
    counts, classes = np.array([3, 1, 20, 6, 7, 9]), np.array([0, 0, 1, 2, 0, 0])
    classes[[w == long for w in words].index(True)] = 1
    x = context_mixing.Spelled(words, classes, counts)
    for by_class in (False, True):
        found = x.prefixes(by_class)
        for k in np.flatnonzero(x.at >= context_mixing.SHARED):
            i, j = x.owner[k], x.at[k]
            same = [len(w) > j and (not by_class or c == classes[i]) and w[:j] == x.words[i][:j] for w, c in zip(x.words, classes)]
            for t in (0, 3, 8):
                want = sum(c for ok, w, c in zip(same, x.words, counts) if ok and w[j] >> 8 - t == x.words[i][j] >> 8 - t)
                assert (found[t][0][k] if t < 8 else found[7][1][k]) == want


def test_split_groups_have_the_counts_of_the_whole(spark):
    """Hot prefixes are told apart by more bytes; all counts are those of one group."""
    rnd = random.Random(8)
    words = {b"http" + bytes(rnd.choices(b"ab:/", k=rnd.randint(0, 6))) for _ in range(150)} | {b"htt", b"other", b"http\x01"}
    rows = sorted((context_mixing._spelled(w), w, c, rnd.randint(0, 9)) for w in words for c in (0, 3, 5) if rnd.random() < 0.7)
    types = spark.createDataFrame([(bytearray(w), c, n) for _, w, c, n in rows], "word binary, cls int, train bigint")
    groups = context_mixing._groups(types, 12)
    assert {b"http", b"httpa"} <= set(groups.hot) and context_mixing._groups(types, 10_000).hot == {}
    keyed = {(bytes(r.word), bytes(r.k)) for r in types.select("word", context_mixing._group_key(groups).alias("k")).collect()}
    assert keyed == {(w, groups.key(s)) for s, w, *_ in rows}

    def counts(part, of):
        x = of.whole([r[1] for r in part], np.array([r[2] for r in part]), np.array([r[3] for r in part]))
        found = [x.prefixes(by_class) for by_class in (False, True)]
        return {(x.words[i], x.cls[i], x.at[k]): [f[t][b][k] for f in found for t in range(8) for b in (0, 1)]
                for k in range(len(x.flat)) for i in [x.owner[k]] if x.real[i] and x.at[k] >= context_mixing.SHARED}
    want, got = counts(rows, context_mixing.Groups({})), {}
    keys = sorted({groups.key(r[0]) for r in rows})
    assert max(sum(groups.key(r[0]) == k for r in rows) for k in keys) <= 12
    for some in (keys[i:i + 3] for i in range(0, len(keys), 3)):  # a chunk has some of the groups
        got |= counts([r for r in rows if groups.key(r[0]) in some], groups)
    assert got == want


def test_split_groups_score_every_text(spark, odd):
    docs = odd.withColumn("held_out", F.coalesce(F.pmod(F.col("doc_id"), F.lit(7)) == 2, F.lit(False)))
    whole, split = ({(r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)): r.score for r in context_mixing.score(docs, group=g).collect()}
                    for g in (120_000, 20))
    assert whole.keys() == split.keys()
    assert all(abs(whole[k] - split[k]) <= 0.02 * abs(whole[k]) for k in whole)  # groups are dealt to other learners


def test_scores_do_not_depend_on_partitions(spark, small_dir, monkeypatch):
    monkeypatch.setattr(context_mixing, "SHARD", 4000)  # several learners
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select(
        "doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2).alias("held_out"))
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r.doc_id: r.score for r in context_mixing.score(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys()
    assert all(abs(got[0][d] - got[1][d]) <= 1e-9 * abs(got[0][d]) for d in got[0])


def test_order_counts_and_repeats_are_cheap(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(400)}" for _ in range(300)]
    shuffled = words + words
    rnd.shuffle(shuffled)
    texts = [" ".join(words), " ".join(words + words), " ".join(shuffled)]
    docs = spark.createDataFrame([(k, t, False) for k, t in enumerate(texts)], "doc_id bigint, text string, held_out boolean")
    once, twice, mixed = (r.score for r in context_mixing.score(docs).orderBy("doc_id").collect())
    assert twice > 1.7 * once and twice > 0.9 * mixed  # scores are negative


def slow_guesses(tokens):
    """One token after the other, with a dictionary of successors."""
    last, guessed, cost, counts = {}, [], 0.0, [[r, w] for r, w in zip(context_mixing._RIGHT, context_mixing._WRONG)]
    right = False
    for i, t in enumerate(tokens):
        guess = last.get(tokens[i - 1]) if i else None
        was, right = right, guess is not None and tokens[guess + 1] == t
        if guess is not None:
            g = 2 * (i >= 2 and guess >= 1 and tokens[guess - 1] == tokens[i - 2]) + (was and i >= 2)
            p = counts[g][0] / sum(counts[g])
            cost += math.log10(p if right else 1 - p)
            counts[g][0 if right else 1] += 1
        guessed.append(right)
        if i:
            last[tokens[i - 1]] = i - 1
    return guessed, cost


def test_guesses_are_those_of_one_pass():
    rnd = random.Random(6)
    for n in (0, 1, 2, 3, 5, 40, 300):
        for kinds in (1, 2, 5, 40):
            tokens = [rnd.randrange(kinds) for _ in range(n)]
            tokens += tokens[: n // 2]
            got, cost = context_mixing.guesses(np.array(tokens, np.int64))
            want, slow = slow_guesses(tokens)
            assert got.tolist() == want and abs(cost - slow) < 1e-9


def slow_class(words):
    """The pair of bytes that most words end in, of equals the smallest."""
    pairs = Counter((b" " + w)[-2:] for w in words)
    best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
    return 0 if best is None else int.from_bytes(best, "big") * 40503 % 65536 >> 12


def test_texts_are_cut_into_tokens_many_at_a_time(monkeypatch):
    """Words, ends, classes and guesses of many texts at once are those of each text alone, from any slice of a batch."""
    rnd = random.Random(9)
    texts = [None, "", " \t", "a", " A\x0bB\x0cC\rd ", "\x1c\x1d x\x85y\xa0z", "\u0130 \u212a K \u00c9", "ab cb db ca da", "x\0y", "\u4e2d\u6587 a " * 9]
    texts += ["".join(rnd.choice("aB \u00e9\n\x1f") for _ in range(rnd.randrange(60))) for _ in range(400)] + [None] * 300
    rnd.shuffle(texts)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["cut off", *texts])}).slice(1)
    monkeypatch.setattr(context_mixing, "_BYTES", 700)
    at = 0
    for piece in context_mixing._pieces(iter([batch])):
        x = context_mixing.Tokens.of(piece.column("text"))
        words, ends = x.words.to_pylist(), [*x.start.tolist(), len(x.ids)]
        assert context_mixing._bytes(x.words) == words and len(set(words)) == len(words)
        guessed, cost = context_mixing.guesses(x.text * len(words) + x.ids, x.start)
        for i in range(piece.num_rows):
            want = (texts[at] or "").encode().lower().split()
            mine = slice(ends[i], ends[i + 1])
            assert [words[k] for k in x.ids[mine]] == [*want, b"\n"] and set(x.text[mine]) == {i}
            assert x.cls[i] == slow_class(want)
            slow, paid = slow_guesses([*want, b"\n"])
            assert guessed[mine].tolist() == slow and abs(cost[i] - paid) < 1e-9
            at += 1
    assert at == len(texts)


def some_types():
    rnd = random.Random(4)
    words = sorted({bytes(rnd.choices(b"ab\xc3", k=rnd.randint(1, 9))) for _ in range(400)} | {b"\n", b"a" * 300},
                   key=context_mixing._spelled)
    rows = [(w, c, rnd.randint(0, 9)) for w in words for c in (0, 3, 15) if rnd.random() < 0.6]
    return [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_a_shared_prefix_is_worked_out_once(monkeypatch):
    """Inputs and probabilities come from one byte for each (prefix, class), and are those of every type alone."""
    words, cls, train = some_types()
    x = context_mixing.Spelled(words, cls, train)
    prefixes = {(s[:j + 1], c) for s, c in zip(x.words, cls.tolist()) for j in range(len(s))}
    first, node = x.tree(True)
    assert len(first) == len(prefixes) < 0.7 * len(x.flat)
    assert all((x.words[x.owner[k]][:x.at[k] + 1], cls[x.owner[k]]) == (x.words[x.owner[f]][:x.at[f] + 1], cls[x.owner[f]])
               for k, f in enumerate(first[node].tolist()))
    places, sizes = context_mixing.Places.of, []
    monkeypatch.setattr(context_mixing.Places, "of", staticmethod(lambda x, of: sizes.append(len(of)) or places(x, of)))
    table = np.random.default_rng(1).integers(0, 50, (context_mixing._BASES[-1], 2)).astype(np.float32)
    mixer = context_mixing.Mixer.new()
    context_mixing.learn(x, table, mixer, x.count > 0)
    looked = context_mixing.Looked(table)
    once = context_mixing.log10_probability(x, looked, mixer)
    assert sizes == [len(prefixes)] * 2
    monkeypatch.setattr(context_mixing.Spelled, "tree", lambda x, by_class, tree=context_mixing.Spelled.tree:
                        tree(x, by_class) if not by_class else (np.arange(len(x.flat)), np.arange(len(x.flat))))
    counts = x.prefixes(True, slice(None), (first, node))
    monkeypatch.setattr(context_mixing.Spelled, "prefixes", lambda x, by_class, of=slice(None), tree=None,
                        prefixes=context_mixing.Spelled.prefixes: counts if by_class else prefixes(x, by_class, of))
    plain = context_mixing.Mixer.new()
    context_mixing.learn(x, table, plain, x.count > 0)
    assert (plain.weights == mixer.weights).all() and (plain.hits == mixer.hits).all()
    assert np.allclose(context_mixing.log10_probability(x, looked, mixer), once, rtol=1e-12)


def test_tables_count_every_bit_of_the_types(monkeypatch):
    words, cls, train = some_types()
    want = Counter()
    for w, c, n in zip(words, cls.tolist(), train.tolist()):
        s = context_mixing._spelled(w)
        for j, byte in enumerate(s):
            before = [s[j - k] if j >= k else 0 for k in (1, 2, 3)]
            c3 = before[0] | before[1] << 8 | before[2] << 16
            for k, context in enumerate((c3 & 0xFF, c3 & 0xFFFF, c3, c3 | c + 1 << 24)):
                for t in range(8):
                    key = context << 8 | 1 << t | byte >> 8 - t
                    bits = context_mixing.SLOTS[k].bit_length() - 1
                    slot = key if k == 0 else int(context_mixing._BASES[k]) + (key * 0x9E3779B97F4A7C15 % 2 ** 64 >> 64 - bits)
                    want[slot, byte >> 7 - t & 1] += n
    order = list(range(len(words)))
    random.Random(5).shuffle(order)
    for chunk in (20_000, 7):  # all at once, and added up in many steps
        monkeypatch.setattr(context_mixing, "_CHUNK", chunk)
        batches = [pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in part], pa.binary()), "cls": pa.array(cls[part]),
                                               "train": pa.array(train[part])}) for part in (order[:100], order[100:])]
        have = Counter({(r["slot"], b): r[f"n{b}"] for got in context_mixing._count(iter(batches)) for r in got.to_pylist() for b in (0, 1)})
        assert +have == +want


def test_mixer_learns_with_true_counts():
    words, table = [b"apple", b"grape"], np.zeros((context_mixing._BASES[-1], 2), np.float32)
    x = context_mixing.Spelled(words, np.zeros(2, int), np.array([1000, 1]))
    mixer = context_mixing.Mixer.new()
    assert context_mixing.learn(x, table, mixer, x.count > 0) == 6 * 1001
    assert mixer.seen.sum() == 8 * 6 * 1001


def test_mixing_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(
        "doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2).alias("held_out"))
    r = context_mixing.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
