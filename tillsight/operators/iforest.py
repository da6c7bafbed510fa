"""Isolation forest.

Each tree is grown in a task of its own on ``sample_size`` rows, picked in the
order of a hash of the id (``n_trees`` x ``sample_size`` rows at most, whatever
the data size), so trees do not depend on partitioning.  Rows are scored on the
executors with ``mapInPandas`` (vectorised NumPy tree walks, trees shipped
once as a small broadcast).  Score = 2^(-E[h(x)] / c(sample_size)); the
anomaly flag marks the ``contamination`` share with the highest scores (an
exact quantile of the scores).
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.plans.ranking import exact_quantiles
from tillsight.session import materialize

EULER = 0.5772156649015329


def _c(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Array-encoded tree: feature, threshold, left, right, size (leaf: feature -1)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        k = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))  # noqa: E702
        if depth >= max_depth or len(idx) <= 1:
            return k
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return k
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[k], thr[k] = f, t
        left[k] = node(idx[sub[:, f] < t], depth + 1)
        right[k] = node(idx[sub[:, f] >= t], depth + 1)
        return k

    node(np.arange(len(x)), 0)
    return (np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size))


def _path_lengths(tree, x: np.ndarray) -> np.ndarray:
    feat, thr, left, right, size = tree
    pos = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = feat[pos] >= 0
    while active.any():
        f = feat[pos[active]]
        go_left = x[active, f] < thr[pos[active]]
        pos[active] = np.where(go_left, left[pos[active]], right[pos[active]])
        depth[active] += 1
        active = feat[pos] >= 0
    return depth + np.array([_c(s) for s in size[pos]])


def isolation_forest(df: DataFrame, contamination: float | str = "auto", n_trees: int = 100,
                     sample_size: int = 256, seed: int = 42, id_col: str = "id", cols=None) -> DataFrame:
    """Returns ``(id_col, anomaly_score, anomaly_flag)``."""
    cols = cols or [c for c in df.columns if c.startswith("s_")]
    n = df.count()
    psi = min(sample_size, n)
    # rows for all trees in the order of a hash, so no partition is favoured; a table smaller
    # than that serves several trees with each row.  Every tree is grown in a task of its own.
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    copies = min(n_trees, max(1, -(-n_trees * psi // max(n, 1))))
    picked = (df.select(F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"), *[F.col(c).cast("double").alias(c) for c in cols])
              .orderBy("_h", *cols).limit(n_trees * psi)
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
              .withColumn("_tree", F.pmod(F.xxhash64("_h") + F.col("_copy"), F.lit(n_trees))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        x = pdf.sort_values(["_h", *cols])[cols].to_numpy(float)
        return pd.DataFrame({"tree": [tree], "model": [pickle.dumps(_grow(x, np.random.default_rng([seed, tree]), max_depth))]})

    rows = picked.groupBy("_tree").applyInPandas(grow, "tree long, model binary").collect()
    trees = [pickle.loads(bytes(r["model"])) for r in sorted(rows, key=lambda r: r["tree"])]
    norm = _c(psi)
    b = df.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        ts = b.value
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            h = np.mean([_path_lengths(t, x) for t in ts], axis=0) if len(x) else np.array([])
            yield pd.DataFrame({id_col: pdf[id_col], "anomaly_score": np.power(2.0, -h / norm) if norm else 0.5})

    id_type = df.schema[id_col].dataType.simpleString()
    scored = df.select(id_col, *cols).mapInPandas(score, f"{id_col} {id_type}, anomaly_score double")
    if contamination == "auto":
        threshold = 0.5
    else:
        scored = materialize(scored)   # the forest scores every row once, not again for the output
        threshold = exact_quantiles(scored, {"t": ("anomaly_score", 1.0 - float(contamination))}).first()["t"]
    return scored.select(id_col, F.round("anomaly_score", 3).alias("anomaly_score"),
                         (F.col("anomaly_score") > F.lit(threshold)).cast("int").alias("anomaly_flag"))
