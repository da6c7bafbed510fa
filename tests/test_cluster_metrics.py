"""Cluster figures: the same code for every number of clusters, labels computed once."""

import math

import numpy as np
from pyspark.sql import functions as F

from tillsight.operators import cluster


def _points(spark, k):
    from pyspark.ml.feature import VectorAssembler
    rows = [(f"c{i}", i % k, float(i % k * 10 + i % 3), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id string, cluster int, s_recency_days double, s_frequency double")
    return VectorAssembler(inputCols=["s_recency_days", "s_frequency"], outputCol="features").transform(df), rows


def test_calinski_and_davies_equal_brute_force(spark):
    df, rows = _points(spark, 4)
    met = cluster.cluster_metrics(df)
    x, lab = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    cents = np.array([x[lab == j].mean(axis=0) for j in range(4)])
    wss = sum(((x[lab == j] - cents[j]) ** 2).sum() for j in range(4))
    bss = sum((lab == j).sum() * ((cents[j] - x.mean(axis=0)) ** 2).sum() for j in range(4))
    s = [np.sqrt(((x[lab == j] - cents[j]) ** 2).sum(axis=1)).mean() for j in range(4)]
    db = np.mean([max((s[a] + s[b]) / np.linalg.norm(cents[a] - cents[b]) for b in range(4) if b != a) for a in range(4)])
    assert math.isclose(met["calinski_harabasz"], (bss / 3) / (wss / 56))
    assert math.isclose(met["davies_bouldin"], db)


def test_centroids_are_no_literals_of_the_plan(spark, monkeypatch):
    sizes = {}
    real = type(spark.range(0)).groupBy

    def watched(self, *cols):
        if "_c" in self.columns:
            sizes[k] = len(self._jdf.queryExecution().analyzed().toString())
        return real(self, *cols)

    monkeypatch.setattr(type(spark.range(0)), "groupBy", watched)
    for k in (2, 20):
        cluster.cluster_metrics(_points(spark, k)[0].withColumn("cluster", F.col("cluster")))
    assert sizes and abs(sizes[20] - sizes[2]) < 200
