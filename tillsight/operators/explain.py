"""Exact Shapley values of tree models, per row and feature.

The game is the path-dependent one: a feature that is not known sends a row down both
branches in the proportion of the training weight that went each way.  Over one leaf this
is a product game -- every feature on the leaf's path contributes a factor, 1 or 0 if it
is known and its conditions hold or fail, else its share of the weight -- so a leaf's
Shapley values depend on a row only through which of its features' conditions hold.  They
are tabulated once per leaf and pattern; a row looks its patterns up and adds.

The tables are the model's size (leaves x 2^features on the path), whatever the data; rows
are explained where they lie, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.session import ensure_checkpoint_dir

#: A leaf's table has two rows to the power of the features on its path.
MOST_PATH_FEATURES = 16


@dataclass
class Leaf:
    """A leaf's contribution to the raw score: ``value`` where all intervals (low, high] hold."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray  # of the training weight that takes the feature's branches

    def table(self) -> np.ndarray:
        """Shapley values, one row per pattern of satisfied features (bit j: feature j).

        A player's value in a product game is the integral over t of its own difference
        times the others' factors, each drawn in with probability t; the integrand is a
        polynomial, so Gauss-Legendre nodes give it exactly.
        """
        k = len(self.features)
        if k > MOST_PATH_FEATURES:
            raise ValueError(f"a path tests {k} features; at most {MOST_PATH_FEATURES} can be tabulated")
        holds = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(float)
        t, w = np.polynomial.legendre.leggauss(max(1, (k + 1) // 2))
        t, w = (t + 1) / 2, w / 2
        factor = self.share * (1 - t)[:, None, None] + holds * t[:, None, None]  # node, pattern, feature; never 0
        others = factor.prod(axis=2, keepdims=True) / factor
        return self.value * (holds - self.share) * np.einsum("q,qpk->pk", w, others)


def saved_nodes(model) -> dict[int, dict[int, dict]]:
    """The nodes of a tree model by tree and node id, read back from its saved form, which
    holds the training weight of every node.  Bounded by the model's size."""
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillsight-model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        node = r["nodeData"] if "nodeData" in r else r
        trees.setdefault(r["treeID"] if "nodeData" in r else 0, {})[node["id"]] = node
    return trees


def tree_leaves(model) -> tuple[float, list[Leaf]]:
    """``(base, leaves)`` of a fitted Spark tree, forest or boosted model.

    The raw score is the probability of class 1 for a classification tree (mean over a
    forest's trees), the prediction of a regression tree or forest, and the margin (the
    weighted sum, half the log-odds) of boosted trees.  ``base`` is the score with no feature known.
    """
    trees = saved_nodes(model)
    boosted = type(model).__name__.startswith("GBT")
    by_class = hasattr(model, "numClasses") and not boosted
    if by_class and model.numClasses != 2:
        raise ValueError("two classes are needed")
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    base, leaves = 0.0, []
    for tree, nodes in sorted(trees.items()):
        def weight(node) -> float:
            return float(sum(node["impurityStats"]) if by_class else node["impurityStats"][0])

        stack = [(nodes[0], {}, 1.0)]
        while stack:
            node, path, reach = stack.pop()
            if node["leftChild"] < 0:
                value = node["impurityStats"][1] / weight(node) if by_class else node["prediction"]
                value *= weights[tree]
                base += reach * value
                if path:
                    f = sorted(path)
                    leaves.append(Leaf(value, np.array(f), *(np.array([path[i][k] for i in f]) for k in range(3))))
                continue
            if node["split"]["numCategories"] != -1:
                raise ValueError("splits on categories are not supported")
            f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, span in (("leftChild", (low, min(high, cut))), ("rightChild", (max(low, cut), high))):
                part = weight(nodes[node[child]]) / weight(node)
                stack.append((nodes[node[child]], {**path, f: (*span, share * part)}, reach * part))
    return base, leaves


def contributions(leaves: list[tuple[Leaf, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Shapley values of the rows of ``x`` under ``(leaf, its table)`` pairs."""
    out = np.zeros(x.shape)
    for leaf, table in leaves:
        pattern = np.zeros(len(x), np.int64)
        for j, f in enumerate(leaf.features):
            pattern |= ((x[:, f] > leaf.low[j]) & (x[:, f] <= leaf.high[j])).astype(np.int64) << j
        out[:, leaf.features] += table[pattern]
    return out


def tree_explanations(model, data: DataFrame, features: list[str], id_col: str = "customer_id",
                      vector_col: str = "features", top: int | None = None) -> DataFrame:
    """``(id, feature, contribution, rank, base, raw_score)``: per row its features by
    descending absolute contribution (ties by name), at most ``top``.

    ``base`` plus all contributions of a row is ``raw_score``, the model's own (see
    ``tree_leaves``).  ``data`` holds the assembled vector; rows with a null vector are
    left out, an empty table gives no rows.
    """
    from pyspark.ml.functions import vector_to_array

    spark = data.sparkSession
    base, leaves = tree_leaves(model)
    shipped = spark.sparkContext.broadcast([(leaf, leaf.table()) for leaf in leaves])
    names, keep = list(features), top or len(features)
    by_name = np.argsort(np.argsort(names))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = part["x"].flatten().to_numpy().reshape(part.num_rows, -1)
                value = contributions(shipped.value, x)
                order = np.lexsort((np.broadcast_to(by_name, value.shape), -np.abs(value)), axis=1)[:, :keep]
                n, k = order.shape
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(np.repeat(np.arange(n), k))),
                     pa.array(names).take(pa.array(order.ravel())),
                     pa.array(np.take_along_axis(value, order, 1).ravel()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), n)),
                     pa.array(np.full(n * k, base)),
                     pa.array(np.repeat(base + value.sum(axis=1), k))],
                    names=["id", "feature", "contribution", "rank", "base", "raw_score"])

    src = data.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), vector_to_array(vector_col).alias("x"))
    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(explain, f"id {id_type}, feature string, contribution double, rank int, base double, raw_score double"
                          ).withColumnRenamed("id", id_col)


def explanation_summary(explained: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, its share in percent and rank (all rows)."""
    per = explained.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    one = Window.partitionBy(F.lit(0))  # one row per feature
    return per.select("feature", "mean_abs", (F.col("mean_abs") / F.sum("mean_abs").over(one) * 100).alias("share_pct"),
                      F.row_number().over(one.orderBy(F.col("mean_abs").desc(), "feature")).alias("rank"))
