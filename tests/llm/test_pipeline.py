"""The pipeline's stages: what they keep, odd rows, extra columns, empty tables."""

import corpus_pipeline
from retailops.llm import quality_rules
from retailops.llm.common import fresh, stored

from .test_operators import PROSE, slow_components, slow_contaminated, slow_counts, slow_fingerprint


def test_stages_on_the_small_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small_dir), name)
        after = {r.doc_id for r in docs.collect()}
        gone = set(before) - after
        if name == "language_id":
            assert all(not any(map(str.isalpha, before[d] or "")) for d in gone)
        elif name == "quality_rules":
            assert gone and not any(c[0] < 10 or 100 * c[4] > 20 * c[0] for c in (slow_counts(before[d]) for d in after))
        elif name == "near_duplicates":
            rows = [(d, slow_fingerprint(t)) for d, t in before.items()]
            assert after == set(slow_components(rows, 4))
        elif name == "decontamination":
            assert gone == {d for d, *_ in slow_contaminated(before.items(), benchmark)}
        else:
            assert not gone and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if name != "bpe":
            assert docs.columns == columns
            before = {d: before[d] for d in after}
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_rows_and_extra_columns(spark, small_dir):
    extra = ["_id", "_fp", "_contaminated", "votes", "held"]
    rows = [(k, t, "en", "s", 1, *["x"] * 5) for k, t in enumerate([PROSE, PROSE, None, "", " \n", "!!! ???", PROSE * 300])]
    rows += [(None, PROSE + " once more with feeling", None, None, None, *[None] * 5), (0, PROSE, "en", "s", 1, *["x"] * 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, small_dir), name)
        assert docs.columns == [f.split()[0].strip("`") for f in schema.split(", ")]
    assert {r.doc_id for r in docs.collect()} <= {0, 6, None}
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, small_dir)
        assert nothing.count() == 0
    assert fresh(docs, "_ID") == ["_ID_1"]


def test_posterior_grows_with_good_votes():
    table = {"+" * len(quality_rules.RULES): 90, "+-" * (len(quality_rules.RULES) // 2): 10}
    model = quality_rules.Model(table)
    assert model.posterior("+" * len(quality_rules.RULES)) > 0.5 > model.posterior("+-" * (len(quality_rules.RULES) // 2))
