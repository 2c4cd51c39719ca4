"""Distributed isolation forest.

* features: numeric columns, missing values filled with the exact median,
  constant columns dropped;
* sampling: tree ``t`` takes a row when ``xxhash64(row number, t)`` falls under
  2*sample_size/n, so equal rows are drawn apart and every tree sees an
  independent hash sample of about 2*sample_size rows (whatever n is and however
  often values repeat) and keeps the ``sample_size`` smallest hashes;
* building: ``groupBy(tree).applyInPandas`` grows one tree per group;
* scoring: the forest (n_trees x at most 2*sample_size nodes, bounded by the
  parameters) is broadcast and every partition is scored with numpy in
  ``mapInPandas``; the anomaly threshold is the exact (1-contamination)
  quantile of the scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.stats import melt
from tablelens.functions.summary import column_numbers

TREE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, "
               "leaf boolean")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.RandomState, limit: int):
    nodes = []  # (feature, threshold, left, right, size, leaf)

    def rec(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[me] = (-1, 0.0, -1, -1, len(idx), True)
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.where(hi > lo)[0]
        if len(usable) == 0:
            nodes[me] = (-1, 0.0, -1, -1, len(idx), True)
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < thr
        left = rec(idx[mask], depth + 1)
        right = rec(idx[~mask], depth + 1)
        nodes[me] = (f, thr, left, right, len(idx), False)
        return me

    rec(np.arange(len(x)), 0)
    return nodes


def _build(features, sample_size, seed):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_h").head(sample_size)
        x = pdf[features].to_numpy(dtype=float)
        limit = int(math.ceil(math.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.RandomState(seed + t), limit)
        return pd.DataFrame({
            "tree": t, "node": np.arange(len(nodes), dtype=np.int32),
            "feature": [n[0] for n in nodes], "threshold": [n[1] for n in nodes],
            "left": [n[2] for n in nodes], "right": [n[3] for n in nodes],
            "size": [n[4] for n in nodes], "leaf": [n[5] for n in nodes]})
    return build


def _prepared(trees: pd.DataFrame) -> list:
    """Per tree: each node's feature, threshold and next nodes (right, then left; a leaf's is itself), the path length that ends
    in it, its size's part included, and the depth of the deepest."""
    out = []
    for _, tree in trees.sort_values("node").groupby("tree"):
        feature, threshold, left, right, leaf = (tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "leaf"))
        own = np.arange(len(tree))
        kids = np.column_stack([np.where(leaf, own, right), np.where(leaf, own, left)]).astype(np.intp).ravel()
        depth = np.zeros(len(tree))
        for node in own[~leaf]:  # a node's number is smaller than those below it
            depth[[left[node], right[node]]] = depth[node] + 1
        path = depth + np.array([c_factor(s) for s in tree["size"]])
        out.append((np.where(leaf, 0, feature).astype(np.intp), threshold, kids, path, int(depth.max())))
    return out


def _path_lengths(x: np.ndarray, tree: tuple) -> np.ndarray:
    feature, threshold, kids, path, deepest = tree
    values, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), dtype=np.intp)
    for _ in range(deepest):
        go_left = values.take(row + feature.take(node)) < threshold.take(node)
        node = kids.take(2 * node + go_left)
    return path.take(node)


def isolation_forest_scores(df: DataFrame, cols, n_trees: int = 100, sample_size: int = 256,
                            seed: int = 42) -> DataFrame | None:
    """df + ``if_score`` in (0, 1] (higher = more anomalous); None when no
    feature varies."""
    cols = list(cols)
    long = melt(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    med = {c: own["m"] for c, own in column_numbers(df, cols, {"m": 0.5}).items()}
    sd = {r["column"]: r["s"] for r in long.groupBy("column").agg(F.stddev_samp("value").alias("s")).collect()}
    feats = [c for c in cols if sd.get(c) is not None and sd[c] > 0]
    if not feats:
        return None
    fx = {c: F.coalesce(F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")),
                        F.lit(float(med[c]))) for c in feats}
    names = [f"_f{i}" for i in range(len(feats))]
    x = df.select(*df.columns, *[fx[c].alias(n) for c, n in zip(feats, names)])
    n = x.count()
    p = min(1.0, 2.0 * sample_size / max(n, 1))
    # a row beside every tree, in generated code; only what is drawn leaves the task
    # the forest is drawn and collected once: no other job has to see the same row numbers
    numbered = x.select(*names, F.monotonically_increasing_id().alias("_row"))
    drawn = numbered.select(*names, "_row", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    sample = drawn.select(*names, "tree", F.xxhash64("_row", "tree", F.lit(seed)).alias("_h")).where(F.col("_h") / F.lit(2.0 ** 64) + 0.5 < p)
    forest = sample.groupBy("tree").applyInPandas(_build(names, sample_size, seed), TREE_SCHEMA)
    trees = forest.toPandas()
    if trees["tree"].nunique() < n_trees:
        raise RuntimeError(f"{trees['tree'].nunique()} of {n_trees} trees were drawn")
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(trees)
    c_n = c_factor(min(sample_size, n))
    out_schema = T.StructType(x.schema.fields + [T.StructField("if_score", T.DoubleType())])

    def score(batches):
        grown = _prepared(bc.value)
        for b in batches:
            arr = b[names].to_numpy(dtype=float)
            depth = np.zeros(len(b))
            for tree in grown:
                depth += _path_lengths(arr, tree)
            mean = depth / n_trees
            b["if_score"] = np.power(2.0, -mean / c_n) if c_n > 0 else 0.5
            yield b

    scored = x.mapInPandas(score, out_schema)
    return scored.drop(*names)


def isolation_forest_flags(df: DataFrame, cols, contamination: float = 0.02, n_trees: int = 100,
                           sample_size: int = 256, seed: int = 42) -> DataFrame:
    """df + ``is_anomaly`` (score above the exact (1-contamination) quantile) and
    ``if_score``; falls back to the |z| > 3 rule when no feature varies."""
    s = isolation_forest_scores(df, cols, n_trees, sample_size, seed)
    if s is None:
        from tablelens.operators.anomaly import flag_anomalies
        return flag_anomalies(df, cols, "zscore").select(*df.columns, "is_anomaly",
                                                        F.lit(None).cast("double").alias("if_score"))
    from tablelens.functions.stats import materialize
    s = materialize(s)  # scores are used twice: threshold and flags
    numbers = column_numbers(s, ["if_score"], {"threshold": 1.0 - contamination})
    limit = numbers["if_score"]["threshold"] if numbers else None
    return s.withColumn("is_anomaly", F.col("if_score") > F.lit(limit))
