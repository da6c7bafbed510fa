"""Tree explanations against the sum over all feature subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tillsight.operators.explain import explanation_summary, saved_nodes, tree_explanations

NAMES = ["d", "b", "a", "c"]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(300).select("id", *[F.round(F.rand(i), 2).alias(c) for i, c in enumerate(NAMES)])
    df = df.withColumn("label", (F.col("d") + F.col("b") * F.col("a") > 0.7).cast("int"))
    df = df.withColumns({"y": F.col("c") + F.col("label"), "w": F.col("label") * 2 + 0.5})
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def expected(nodes, node, x, known, value, weight):
    """The score with only ``known`` features: other splits go both ways by weight."""
    n = nodes[node]
    if n["leftChild"] < 0:
        return value(n)
    f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return expected(nodes, n["leftChild"] if x[f] <= cut else n["rightChild"], x, known, value, weight)
    return sum(expected(nodes, n[c], x, known, value, weight) * weight(nodes[n[c]]) for c in ("leftChild", "rightChild")) / weight(n)


MODELS = {
    "tree": (lambda: DecisionTreeClassifier(maxDepth=5, weightCol="w", minInstancesPerNode=2),
             lambda m: lambda r: r["probability"][1], lambda m, n: [1.0]),
    "forest": (lambda: RandomForestClassifier(numTrees=6, maxDepth=4, weightCol="w", seed=3),
               lambda m: lambda r: r["probability"][1], lambda m, n: [1 / n] * n),
    "boosted": (lambda: GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.3, seed=3),
                lambda m: lambda r: r["rawPrediction"][1], lambda m, n: m.treeWeights),
    "regression": (lambda: RandomForestRegressor(numTrees=4, maxDepth=4, labelCol="y", seed=3),
                   lambda m: lambda r: r["prediction"], lambda m, n: [1 / n] * n),
}


@pytest.mark.parametrize("kind", MODELS)
def test_contributions_are_shapley_values(data, kind):
    estimator, score, weights = MODELS[kind]
    model = estimator().fit(data)
    out = tree_explanations(model, data, NAMES, id_col="id")
    rows = {}
    for r in out.collect():
        rows.setdefault(r["id"], []).append(r)
    predicted = {r["id"]: r for r in model.transform(data).collect()}
    trees = saved_nodes(model)
    by_class = kind in ("tree", "forest")
    weight = (lambda n: sum(n["impurityStats"])) if by_class else (lambda n: n["impurityStats"][0])
    value = (lambda n: n["impurityStats"][1] / weight(n)) if by_class else (lambda n: n["prediction"])
    factors = weights(model, len(trees))
    assert len(rows) == 300
    for i, mine in rows.items():
        assert mine[0]["raw_score"] == pytest.approx(score(model)(predicted[i]), abs=1e-9)
        assert mine[0]["base"] + sum(r["contribution"] for r in mine) == pytest.approx(mine[0]["raw_score"], abs=1e-9)
        assert [r["rank"] for r in sorted(mine, key=lambda r: (-abs(r["contribution"]), r["feature"]))] == [1, 2, 3, 4]
        if i % 30:
            continue
        x, got = predicted[i]["features"].toArray(), {r["feature"]: r["contribution"] for r in mine}
        v = {s: sum(w * expected(trees[t], 0, x, s, value, weight) for t, w in enumerate(factors))
             for k in range(5) for s in combinations(range(4), k)}
        for j, name in enumerate(NAMES):
            others = [f for f in range(4) if f != j]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (v[tuple(sorted((*s, j)))] - v[s])
                       for k in range(4) for s in combinations(others, k))
            assert got[name] == pytest.approx(want, abs=1e-9)
        assert mine[0]["base"] == pytest.approx(v[()], abs=1e-9)


def test_top_summary_and_odd_tables(data):
    model = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(data)
    assert tree_explanations(model, data, NAMES, id_col="id", top=2).groupBy("id").count().where("count <> 2").count() == 0
    assert tree_explanations(model, data.limit(0), NAMES, id_col="id").count() == 0
    summary = explanation_summary(tree_explanations(model, data, NAMES, id_col="id")).orderBy("rank").collect()
    assert sum(r["share_pct"] for r in summary) == pytest.approx(100)
    assert [r["rank"] for r in summary] == [1, 2, 3, 4] and summary[0]["mean_abs"] >= summary[3]["mean_abs"]
    assert np.isfinite([r["mean_abs"] for r in summary]).all()
    stump = DecisionTreeClassifier(maxDepth=0).fit(data)
    assert {r["contribution"] for r in tree_explanations(stump, data, NAMES, id_col="id").collect()} == {0.0}
