"""Isolation-forest anomalies on the daily frame.

After Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008):
* each tree sees exactly psi = min(256, n) rows, those with the smallest seeded
  hashes of (tree, row): a bounded top-k for each tree, limited in every task
  before the shuffle;
* trees are grown in parallel, one ``applyInPandas`` group per tree (a
  group holds only that tree's psi rows);
* the forest is at most n_trees * (2 psi - 1) nodes - a size fixed by the
  parameters, not by the data - and is broadcast for scoring in
  ``mapInPandas``;
* score = -2^(-E[h(x)] / c(psi)); the lowest ``contamination`` share of
  scores (exact percentile) are anomalies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint
from .anomaly import daily_frame
from .stats import attach_row, quantile_row

FEATURES = ["Sales", "Orders", "Avg_Value"]
NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType())])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    tree_id = int(pdf["tree_id"].iloc[0])
    X = pdf[FEATURES].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree_id])
    limit = max(1, math.ceil(math.log2(max(len(X), 2))))
    nodes = []
    stack = [(np.arange(len(X)), 0, 0)]
    nodes.append(None)
    while stack:
        idx, depth, nid = stack.pop()
        sub = X[idx]
        lo, hi = (sub.min(axis=0), sub.max(axis=0)) if len(idx) else (np.zeros(3), np.zeros(3))
        splittable = np.where(hi > lo)[0]
        if depth >= limit or len(idx) <= 1 or len(splittable) == 0:
            nodes[nid] = (tree_id, nid, -1, 0.0, -1, -1, int(len(idx)), depth)
            continue
        f = int(rng.choice(splittable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left_id, right_id = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[nid] = (tree_id, nid, f, thr, left_id, right_id, int(len(idx)), depth)
        mask = sub[:, f] < thr
        stack.append((idx[mask], depth + 1, left_id))
        stack.append((idx[~mask], depth + 1, right_id))
    return pd.DataFrame(nodes, columns=[f.name for f in NODE_SCHEMA.fields])


def sample_rows(daily: DataFrame, n_trees: int, max_samples: int, seed: int) -> DataFrame:
    """(tree_id, features) of each tree's sample."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))  # int
    drawn = (daily.select("Order_Date", *[F.col(c).cast("double").alias(c) for c in FEATURES], trees.alias("tree_id"))
                  .withColumn("_h", F.xxhash64(F.lit(seed), "tree_id", "Order_Date")))
    nth = F.row_number().over(Window.partitionBy("tree_id").orderBy("_h", "Order_Date"))
    return drawn.withColumn("_nth", nth).filter(F.col("_nth") <= max_samples).select("tree_id", *FEATURES)


def fit_forest(daily: DataFrame, n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Grow the trees on the executors; returns the node table."""
    member = sample_rows(daily, n_trees, max_samples, seed)
    return member.groupBy("tree_id").applyInPandas(lambda pdf: _grow(pdf, seed), NODE_SCHEMA)


def score_forest(daily: DataFrame, nodes: DataFrame, psi: int) -> DataFrame:
    """Anomaly_Score per row (sklearn sign: lower = more anomalous)."""
    spark = daily.sparkSession
    table = nodes.toPandas()  # bounded: n_trees * (2 * max_samples - 1) rows
    forest = {}
    for tid, g in table.groupby("tree_id"):
        g = g.sort_values("node_id")
        forest[int(tid)] = g[["feature", "threshold", "left", "right", "size", "depth"]].to_numpy()
    bc = spark.sparkContext.broadcast(forest)
    cpsi = c_factor(psi)
    out_schema = T.StructType(daily.schema.fields + [T.StructField("Anomaly_Score", T.DoubleType())])

    def run(batches):
        trees = bc.value
        for pdf in batches:
            X = pdf[FEATURES].to_numpy(dtype=float)
            rows = np.arange(len(X))
            total = np.zeros(len(X))
            for arr in trees.values():
                feat, thr = arr[:, 0].astype(int), arr[:, 1]
                left, right = arr[:, 2].astype(int), arr[:, 3].astype(int)
                leaf_len = arr[:, 5] + np.array([c_factor(s) for s in arr[:, 4]])
                nid = np.zeros(len(X), dtype=int)
                active = feat[nid] >= 0
                while active.any():  # one vectorised step per tree level
                    a = rows[active]
                    f = feat[nid[a]]
                    go_left = X[a, f] < thr[nid[a]]
                    nid[a] = np.where(go_left, left[nid[a]], right[nid[a]])
                    active = feat[nid] >= 0
                total += leaf_len[nid]
            eh = total / max(len(trees), 1)
            pdf = pdf.copy()
            pdf["Anomaly_Score"] = -np.power(2.0, -eh / cpsi) if cpsi > 0 else -np.ones(len(X))
            yield pdf

    return daily.mapInPandas(run, out_schema)


def anomalies_isolation_forest(sales: DataFrame, contamination: float = 0.05, n_trees: int = 100,
                               max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Daily rows whose score is below the ``contamination`` quantile of all scores."""
    daily = reliable_checkpoint(daily_frame(sales))  # one row a date; counted, sampled and scored
    n = daily.count()
    nodes = fit_forest(daily, n_trees, max_samples, seed)
    scored = score_forest(daily, nodes, min(max_samples, n))
    cut = quantile_row(scored, {"_cut": ("Anomaly_Score", [contamination])}, strategy="map")  # one per date
    return (attach_row(scored, cut).filter(F.col("Anomaly_Score") < F.col("_cut")[0]).drop("_cut")
            .withColumn("Anomaly_Type", F.lit("Isolation Forest")).orderBy("Order_Date"))
