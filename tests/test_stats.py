"""Statistics primitives against hand-computed frames and pandas brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from retailops.operators import stats as S


def test_qcut_quartiles_unit(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]], "v double")
    out = S.qcut(df, "v", 4, "lab", ["a", "b", "c", "d"]).orderBy("v").collect()
    assert [r.lab for r in out] == ["a", "a", "b", "c", "d"]


def test_qcut_all_equal_and_single(spark):
    df = spark.createDataFrame([(7.0,), (7.0,), (7.0,)], "v double")
    assert {r.b for r in S.qcut(df, "v", 4, "b").collect()} == {1}
    one = spark.createDataFrame([(3.0,)], "v double")
    assert S.qcut(one, "v", 4, "b").collect()[0].b == 1


def test_qcut_matches_pandas(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(100, 30, 401).round(2)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(vals)], "v double, id int")
    got = S.qcut(df, "v", 4, "b").orderBy("id").toPandas()["b"].to_numpy()
    exp = pd.qcut(vals, 4, labels=False) + 1
    assert (got == exp).all()


def _pandas_rank_score(vals, q=5):
    s = pd.Series(vals)
    return pd.qcut(s.rank(method="first"), q, labels=list(range(1, q + 1))).astype(int).to_numpy()


def test_rank_score_matches_pandas(spark):
    for n in (6, 7, 11, 500):
        rng = np.random.default_rng(n)
        vals = rng.integers(1, 6, n)  # many ties, broken by id order
        ids = [f"{i:05d}" for i in range(n)]
        df = spark.createDataFrame([(int(v), i) for v, i in zip(vals, ids)], "v int, id string")
        got = S.rank_score(df, "v", "id", 5, "score").orderBy("id").toPandas()["score"].to_numpy()
        assert (got == _pandas_rank_score(vals)).all(), n


def test_rank_score_single_row(spark):
    df = spark.createDataFrame([(1, "a")], "v int, id string")
    assert S.rank_score(df, "v", "id", 5, "s").collect()[0].s == 1


def test_global_row_number_is_dense_and_ordered(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 3, 997)  # heavy ties: one value holds a third of the rows
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(vals)], "v int, id int")
    out = S.global_row_number(df, [F.col("v"), F.col("id")], "rn", num_partitions=7).toPandas()
    out = out.sort_values("rn")
    assert out["rn"].tolist() == list(range(1, 998))
    exp = sorted(zip(vals.tolist(), range(997)))
    assert list(zip(out["v"], out["id"])) == exp


def test_ffill_matches_pandas(spark):
    rng = np.random.default_rng(5)
    n = 500
    vals = rng.normal(size=n)
    vals[rng.random(n) < 0.4] = np.nan
    vals[:3] = np.nan  # leading nulls stay null
    rows = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = S.ffill(df, ["x"], ["k"], num_partitions=6).orderBy("k").toPandas()["x"]
    exp = pd.Series(vals).ffill()
    assert np.allclose(got.fillna(-999).to_numpy(), exp.fillna(-999).to_numpy())


def test_quantile_row_matches_numpy(spark):
    rng = np.random.default_rng(9)
    vals = rng.uniform(-10, 10, 333)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = S.quantile_row(df, {"q": ("v", [0.05, 0.25, 0.5, 0.95])}).collect()[0].q
    assert np.allclose(got, np.quantile(vals, [0.05, 0.25, 0.5, 0.95]))


def test_quantiles_by_selection_equal_map(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(50, 10, 700).round(2), np.full(350, 42.0)])  # a third share one value
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    a = S.quantile_row(df, {"q": ("v", probs)}, strategy="map").collect()[0].q
    b = S.quantile_row(df, {"q": ("v", probs)}).collect()[0].q
    assert a == b
    two = S.quantile_row(df.withColumn("w", -df.v).withColumn("e", F.lit(None).cast("double")), {"q": ("v", probs), "w": ("w", [0.5]), "e": ("e", [0.5])})
    r = two.collect()[0]
    assert r.q == b and r.w == [-b[2]] and r.e is None
    assert np.allclose(b, np.quantile(vals, probs))


def test_global_row_number_with_adaptive_coalescing(spark):
    """Without an explicit count AQE merges range partitions; ids must still follow the order."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
            "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rng = np.random.default_rng(11)
        n = 30_000
        pdf = pd.DataFrame({"k": np.arange(n), "v": rng.integers(0, 20, n).astype(float)})
        pdf.loc[rng.choice(n, 100, replace=False), "v"] = np.nan
        df = spark.createDataFrame(pdf)
        order = [F.col("v").asc_nulls_first(), F.col("k").asc()]
        got = S.global_row_number(df, order, "rn").toPandas()
        exp = pdf.sort_values(["v", "k"], na_position="first").reset_index(drop=True)
        exp["rn_e"] = np.arange(1, n + 1)
        m = got.merge(exp[["k", "rn_e"]], on="k")
        assert len(m) == n and (m.rn == m.rn_e).all()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_ordered_bits_sort_like_the_values():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf, 1.0, -1.0]])
    bits = S.ordered_bits(v)
    assert (v[np.argsort(bits, kind="stable")] == np.sort(v)).all()
    assert S.ordered_bits(np.array([0.0]))[0] == S.ordered_bits(np.array([-0.0]))[0]
    assert S.ordered_bits(np.array([np.nan]))[0] > bits.max()


def test_quantiles_need_as_many_passes_as_the_values_are_close(spark, monkeypatch):
    """Values that agree in most bits, of all sizes, and more buckets than a task holds."""
    rng = np.random.default_rng(6)
    close = 1e9 + rng.integers(0, 50, 300) * 1e-6
    wide = rng.normal(0, 1, 300) * 10.0 ** rng.integers(-200, 200, 300)
    df = spark.createDataFrame([(float(a), float(b), k) for k, (a, b) in enumerate(zip(close, wide))], "a double, b double, c int").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.93, 1.0]
    for entries in (1 << 20, 40):
        monkeypatch.setattr(S, "_ENTRIES", entries)
        r = S.quantile_row(df, {"a": ("a", probs), "b": ("b", probs), "c": (F.col("c") % 3, [0.5])}).first()
        for got, v in ((r.a, close), (r.b, wide)):
            v, h = np.sort(v), [(len(v) - 1) * q for q in probs]
            lo, hi = np.floor(h).astype(int), np.ceil(h).astype(int)
            assert got == [v[i] if i == j else (j - x) * v[i] + (x - i) * v[j] for i, j, x in zip(lo, hi, h)]
        assert r.c == [1.0]


def test_forward_fill_over_partitions_and_batches(spark):
    rng = np.random.default_rng(8)
    n = 25_000  # several Arrow batches
    pdf = pd.DataFrame({"k": rng.permutation(n), "v": np.where(rng.random(n) < 0.6, np.nan, rng.integers(0, 99, n)),
                        "w": np.where(rng.random(n) < 0.9995, None, "x")})
    df = spark.createDataFrame(pdf.astype({"v": "float"}), "k long, v double, w string").withColumn("v", F.nanvl("v", F.lit(None)))
    want = pdf.sort_values("k").ffill()
    for parts in (None, 1, 7):
        got = S.ffill(df, ["v", "w"], ["k"], parts).toPandas().sort_values("k")
        assert np.array_equal(got["v"].to_numpy(float), want["v"].to_numpy(float), equal_nan=True)
        assert [x if isinstance(x, str) else None for x in got["w"]] == [x if isinstance(x, str) else None for x in want["w"]]


def test_several_distinct_counts(spark):
    """Null keys and ids, ids of other types, no rows, no keys, no plain aggregate."""
    from retailops.functions import aggs as A
    rows = [("a", 1, "x", 2.0), ("a", 1, "y", 3.0), ("a", None, "y", None), (None, 2, None, 1.0), (None, 2, "z", 1.0), ("b", None, None, None)]
    df = spark.createDataFrame(rows, "g string, i int, s string, v double").repartition(3)
    aggs = (A.Distinct("i", "ni"), F.sum("v").alias("v"), A.Distinct("s", "ns"), F.count(F.lit(1)).alias("n"))
    got = {r.g: (r.ni, r.v, r.ns, r.n) for r in A.group_agg(df, ["g"], *aggs).collect()}
    assert got == {"a": (1, 5.0, 2, 3), None: (1, 2.0, 1, 2), "b": (0, None, 0, 1)}
    out = A.group_agg(df, [], *aggs)
    assert out.columns == ["ni", "v", "ns", "n"] and tuple(out.first()) == (2, 7.0, 3, 6)
    assert tuple(A.group_agg(df.limit(0), [], *aggs).first()) == (0, None, 0, 0)
    assert A.group_agg(df.limit(0), ["g"], *aggs).count() == 0
    only = A.group_agg(df, ["g", "v"], A.Distinct("i", "ni"), A.Distinct("s", "ns"))
    assert {tuple(r) for r in only.collect()} == {("a", 2.0, 1, 1), ("a", 3.0, 1, 1), ("a", None, 0, 1), (None, 1.0, 1, 1), ("b", None, 0, 0)}


def test_labels_at_grain_equal_labels_on_rows(spark, small_dir):
    """Plain rows, whose labels are found at the customers' grain, and labelled rows give the same tables."""
    from retailops.operators import analysis as AN, bi, insights as IN
    from retailops.plans import prepare as P
    rows, full = P.rows(spark, small_dir), P.full(spark, small_dir)
    rows = rows.withColumn("Customer_ID", F.when(F.col("Customer_ID") != "7", F.col("Customer_ID")))
    from retailops.operators.features import attach_customer_stats, attach_product_stats, customer_stats, product_stats
    full = attach_product_stats(attach_customer_stats(rows, customer_stats(rows, "max")), product_stats(rows))
    for op in (bi.top_customers, bi.customer_segment_analysis, AN.segment_distribution, AN.revenue_by_segment, AN.segment_analysis_table,
               AN.segment_counts_ordered, AN.product_performance, AN.performance_distribution, AN.filter_options, AN.rfm_table,
               AN.top_customer_profiles, IN.business_insights):
        a, b = op(rows), op(full)
        assert a.columns == b.columns, op
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), op
