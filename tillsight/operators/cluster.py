"""Customer segmentation with Spark ML: robust scaling, K-Means model
selection, cluster quality metrics, names and profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.exprs import finite_or_zero
from tillsight.plans.ranking import exact_quantiles
from tillsight.session import materialize

CLUSTER_FEATURES = ["recency_days", "frequency", "monetary_value", "avg_order_value", "purchase_rate",
                    "product_diversity", "return_rate"]
LOG_COLUMNS = 3   # log1p of the first three features (clipped at 0)


def _scaled_names(cols):
    return [f"s_{c}" for c in cols]


def robust_scale(customers: DataFrame, columns=None, log_first: int = LOG_COLUMNS) -> DataFrame:
    """log1p of the first ``log_first`` columns (clipped at 0), then
    (x - median) / IQR with linear quantiles; a zero IQR divides by 1
    (scikit-learn's rule).  Adds ``s_<col>`` columns and a ``features`` vector."""
    from pyspark.ml.feature import VectorAssembler
    columns = [c for c in (columns or CLUSTER_FEATURES) if c in customers.columns]
    x = customers
    for i, c in enumerate(columns):
        v = finite_or_zero(F.col(c))
        if i < log_first:
            v = F.log1p(F.greatest(v, F.lit(0.0)))
        x = x.withColumn(f"_x_{c}", v)
    specs = {}
    for c in columns:
        specs[f"q1_{c}"] = (f"_x_{c}", 0.25)
        specs[f"q2_{c}"] = (f"_x_{c}", 0.5)
        specs[f"q3_{c}"] = (f"_x_{c}", 0.75)
    q = exact_quantiles(x, specs).first()
    for c in columns:
        iqr = (q[f"q3_{c}"] or 0.0) - (q[f"q1_{c}"] or 0.0)
        scale = iqr if iqr != 0 else 1.0
        x = x.withColumn(f"s_{c}", (F.col(f"_x_{c}") - F.lit(q[f"q2_{c}"] or 0.0)) / F.lit(scale))
    x = x.drop(*[f"_x_{c}" for c in columns])
    return VectorAssembler(inputCols=_scaled_names(columns), outputCol="features").transform(x)


def cluster_metrics(scaled: DataFrame, label: str = "cluster", columns=None) -> dict:
    """Silhouette (Spark's evaluator: squared Euclidean), Davies-Bouldin and
    Calinski-Harabasz (Euclidean, exact, from per-cluster aggregates), number of
    clusters and noise share (label -1).  Fewer than 2 clusters: NaN scores."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    cols = _scaled_names([c for c in (columns or CLUSTER_FEATURES) if f"s_{c}" in scaled.columns])
    stats = scaled.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == -1).alias("noise")).first()
    usable = scaled.where(F.col(label) != -1)
    per = usable.groupBy(label).agg(F.count(F.lit(1)).alias("nk"), *[F.avg(c).alias(c) for c in cols]).collect()
    k = len(per)
    out = {"n_clusters": k, "noise_ratio": (stats["noise"] / stats["n"]) if stats["n"] else float("nan"),
           "silhouette": float("nan"), "davies_bouldin": float("nan"), "calinski_harabasz": float("nan")}
    n_used = stats["n"] - stats["noise"]
    if k < 2 or n_used <= k:
        return out
    cents = {r[label]: [r[c] for c in cols] for r in per}
    sizes = {r[label]: r["nk"] for r in per}
    # one pass: mean distance to own centroid (scatter) and within sum of squares
    # the centroids are joined, k rows: as literals they were code of its own for every k, which the driver compiles and keeps
    spots = scaled.sparkSession.createDataFrame([(lab, [float(a) for a in v]) for lab, v in cents.items()],
                                                f"{label} {scaled.schema[label].dataType.simpleString()}, _c array<double>")
    sq = sum(((F.col(c) - F.col("_c")[i]) ** 2 for i, c in enumerate(cols)), F.lit(0.0))
    scat = usable.join(F.broadcast(spots), label).groupBy(label).agg(F.avg(F.sqrt(sq)).alias("s"), F.sum(sq).alias("wss")).collect()
    s = {r[label]: r["s"] for r in scat}
    wss = sum(r["wss"] for r in scat)
    dist = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    labs = sorted(cents)
    db = 0.0
    for a in labs:
        db += max(((s[a] + s[b]) / dist(cents[a], cents[b])) if dist(cents[a], cents[b]) > 0 else float("inf")
                  for b in labs if b != a)
    out["davies_bouldin"] = db / k
    overall = [sum(sizes[lab] * cents[lab][i] for lab in labs) / n_used for i in range(len(cols))]
    bss = sum(sizes[lab] * sum((cents[lab][i] - overall[i]) ** 2 for i in range(len(cols))) for lab in labs)
    out["calinski_harabasz"] = (bss / (k - 1)) / (wss / (n_used - k)) if wss > 0 else float("inf")
    ev = ClusteringEvaluator(featuresCol="features", predictionCol=label)
    out["silhouette"] = ev.evaluate(usable.withColumn(label, F.col(label).cast("int")))
    return out


def select_kmeans(scaled: DataFrame, min_k: int = 2, max_k: int = 8, seed: int = 42, restarts: int = 1):
    """K-Means for k in ``min_k..min(max_k, n-1)``; per k the lowest-cost of
    ``restarts`` seeds; the best k has the highest silhouette, then the lowest
    Davies-Bouldin.  Returns ``(best_model, best_k, evaluation_rows)``."""
    from pyspark.ml.clustering import KMeans
    n = scaled.count()
    if n < 4:
        raise ValueError("At least four customers are required for clustering")
    rows, models = [], {}
    for k in range(min_k, min(max_k, n - 1) + 1):
        best = None
        for r in range(restarts):
            m = KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="cluster").fit(scaled)
            if best is None or m.summary.trainingCost < best.summary.trainingCost:
                best = m
        met = cluster_metrics(best.transform(scaled))
        met.update({"method": "kmeans", "parameter": float(k)})
        rows.append(met)
        models[k] = best
    ranked = sorted(rows, key=lambda r: (-_nan_low(r["silhouette"]), _nan_high(r["davies_bouldin"])))
    best_k = int(ranked[0]["parameter"])
    return models[best_k], best_k, rows


def _nan_low(v):
    return -float("inf") if v is None or (isinstance(v, float) and math.isnan(v)) else v


def _nan_high(v):
    return float("inf") if v is None or (isinstance(v, float) and math.isnan(v)) else v


def evaluation_frame(spark, rows) -> DataFrame:
    schema = ("method string, parameter double, n_clusters int, silhouette double, davies_bouldin double, "
              "calinski_harabasz double, noise_ratio double")
    return spark.createDataFrame([(r["method"], float(r["parameter"]), int(r["n_clusters"]), _f(r["silhouette"]),
                                   _f(r["davies_bouldin"]), _f(r["calinski_harabasz"]), _f(r["noise_ratio"]))
                                  for r in rows], schema)


def _f(v):
    return None if v is None or (isinstance(v, float) and (math.isnan(v) or math.isinf(v))) else float(v)


def name_clusters(assigned: DataFrame, label: str = "cluster", value: str = "monetary_value") -> DataFrame:
    """"Segment n": dense rank of the cluster's mean ``value`` (ascending)."""
    means = assigned.groupBy(label).agg(F.avg(value).alias("_m"))
    names = means.select(label, F.concat(F.lit("Segment "), F.dense_rank().over(Window.orderBy("_m")).cast("string"))
                         .alias("cluster_name"))
    return assigned.join(F.broadcast(names), label)  # one row per cluster: k rows


def bisecting_clusters(scaled: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Top-down hierarchical clustering (stands in for Ward's all-pairs method)."""
    from pyspark.ml.clustering import BisectingKMeans
    return BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled).transform(scaled)


def elbow(scaled: DataFrame, max_k: int = 10, seed: int = 42) -> DataFrame:
    """Within-cluster sum of squares for k = 1..max_k (k = 1 from the column variances)."""
    from pyspark.ml.clustering import KMeans
    cols = [c for c in scaled.columns if c.startswith("s_")]
    tot = scaled.agg(*[(F.var_pop(c) * F.count(F.lit(1))).alias(c) for c in cols]).first()
    rows = [(1, float(sum(tot[c] or 0.0 for c in cols)))]
    n = scaled.count()
    for k in range(2, min(max_k, n) + 1):
        m = KMeans(k=k, seed=seed, featuresCol="features").fit(scaled)
        rows.append((k, float(m.summary.trainingCost)))
    return scaled.sparkSession.createDataFrame(rows, "k int, wcss double")


def cluster_profile(assigned: DataFrame, label: str = "cluster", columns=None) -> DataFrame:
    cols = [c for c in (columns or CLUSTER_FEATURES) if c in assigned.columns]
    return assigned.groupBy(label).agg(F.count(F.lit(1)).alias("customers"), *[F.avg(c).alias(c) for c in cols])


def cluster_customers(customers: DataFrame, min_k: int = 2, max_k: int = 8, seed: int = 42, restarts: int = 1,
                      with_alternatives: bool = True):
    """K-Means selection plus the alternative methods' evaluation rows, cluster
    names, isolation-forest anomaly flag and score.
    Returns ``(customers_with_clusters, evaluation_df, kmeans_model)``."""
    from tillsight.operators.density import dbscan
    from tillsight.operators.iforest import isolation_forest
    spark = customers.sparkSession
    scaled = robust_scale(customers)
    model, best_k, rows = select_kmeans(scaled, min_k, max_k, seed, restarts)
    assigned = model.transform(scaled)
    if with_alternatives:
        h = bisecting_clusters(scaled, best_k, seed)
        met = cluster_metrics(h)
        met.update({"method": "hierarchical", "parameter": float(best_k)})
        rows.append(met)
        n = scaled.count()
        d = dbscan(scaled, eps=1.2, min_samples=max(3, n // 30), id_col="customer_id")
        # written once: every figure would join the labels, all of DBSCAN's last steps, again
        labelled = materialize(scaled.select("customer_id", "features", *[c for c in scaled.columns if c.startswith("s_")])
                               .join(d.withColumnRenamed("label", "cluster"), "customer_id"))
        met = cluster_metrics(labelled)
        met.update({"method": "dbscan", "parameter": 1.2})
        rows.append(met)
    named = name_clusters(assigned.withColumn("cluster", F.col("cluster").cast("int")))
    n = customers.count()
    flags = isolation_forest(named, contamination=min(.10, max(.02, 8 / n)), seed=seed, id_col="customer_id")
    out = named.join(flags, "customer_id").drop("features", *[c for c in named.columns if c.startswith("s_")])
    return out, evaluation_frame(spark, rows), model


def standardized(df: DataFrame, cols: list[str], prefix: str = "s_") -> DataFrame:
    """``df`` with (value - mean) / population deviation of ``cols``; a constant column gives 0."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("dev")).alias(c) for c in cols]).first()
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["dev"] or 1.0)
                           for c in cols})
