"""The notebooks' forecast models on fifteen features, and their five personas.

The features include the current month (growth, rolling windows), as the notebook's do, so
these models are leaky; ``series.strict_forecast_features`` is the table without that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.operators.series import _assemble, rolling_calendar
from tillsight.plans.ranking import global_cumsum
from tillsight.session import materialize

NOTEBOOK_FEATURES = ["Year", "Month", "Quarter", "Day", "Weekday", "Weekend", "GrowthRate", "Lag_1", "Lag_2", "Lag_3", "Lag_6",
                     "RollingMean_3", "RollingStd_3", "RollingMean_6", "RollingStd_6"]
# ---- fixed values that must equal the reference ----
VIP, CHURN_RISK, REGULAR, BUDGET, NEW = ("VIP Customers", "Churn Risk Customers", "Regular Customers", "Budget Buyers",
                                         "New Customers")
# ---- end of fixed values ----


def notebook_forecast_table(month_end: DataFrame, keys=(), date_col: str = "InvoiceDate", value: str = "Sales",
                            train_share: float = 0.8) -> DataFrame:
    """Complete rows of the fifteen features, their ``position`` in their series and ``held_out``:
    the months after the first floor(n x ``train_share``), in order of the date.

    Positions come from a distributed running count per series.  A month after one without
    sales has no growth rate and is left out."""
    t = rolling_calendar(month_end, keys, date_col, value, windows=(3, 6), lags=(1, 2, 3, 6)).dropna(subset=NOTEBOOK_FEATURES)
    placed = global_cumsum(t.select(*keys, date_col, value, *NOTEBOOK_FEATURES), [date_col], list(keys), out_col="position", total_col="_n")
    return placed.withColumn("held_out", F.col("position") > F.floor(F.col("_n") * F.lit(train_share))).drop("_n")


def notebook_forecasts(table: DataFrame, value: str = "Sales", seed: int = 42, trees: int = 300, rounds: int = 300) -> DataFrame:
    """``table``'s held-out rows with ``model`` and ``prediction``: linear on standardised
    features, forest, boosted trees, and the last training value (naive) of each series.
    One fit over all series' training months; no rows where there are none to learn from."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    data = materialize(_assemble(table, NOTEBOOK_FEATURES, "x"))
    keep = [c for c in table.columns if c not in NOTEBOOK_FEATURES and c not in ("position", "held_out")]
    series = [c for c in keep if c not in (value, "InvoiceDate")]
    train, test = data.where(~F.col("held_out")), data.where("held_out")
    last = train.groupBy(*series).agg(F.max_by(value, "position").alias("prediction"))
    naive = (test.join(last, series) if series else test.crossJoin(last)).select(*keep, F.lit("Naive").alias("model"), "prediction")
    if train.isEmpty():
        return naive
    models = {
        "Linear Regression": Pipeline(stages=[
            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
            LinearRegression(featuresCol="z", labelCol=value)]),
        "Random Forest": RandomForestRegressor(featuresCol="x", labelCol=value, numTrees=trees, maxDepth=8, minInstancesPerNode=2, seed=seed),
        "Gradient Boosted Trees": GBTRegressor(featuresCol="x", labelCol=value, maxIter=rounds, maxDepth=4, stepSize=0.05,
                                               subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
    }
    parts = [est.fit(train).transform(test).select(*keep, F.lit(name).alias("model"), "prediction") for name, est in models.items()]
    return reduce(DataFrame.unionByName, parts, naive)


def forecast_report(predictions: DataFrame, value: str = "Sales") -> DataFrame:
    """Per model MAE, MSE, RMSE and R2 (null where the values don't vary), all models in one aggregate."""
    gap = F.col("prediction") - F.col(value)
    per = predictions.groupBy("model").agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.sum(gap * gap).alias("_sse"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("_sst"))
    return per.select("model", "mae", "mse", F.sqrt("mse").alias("rmse"), (F.lit(1.0) - F.try_divide("_sse", "_sst")).alias("r2"))


def notebook_personas(customers: DataFrame, assigned: str = "cluster") -> DataFrame:
    """Adds ``persona`` to customers in up to five clusters.

    A cluster's number says nothing, so names go by the clusters' means, each cluster
    taking one: most money VIP; of the rest longest unseen churn risk; of the rest shortest
    tenure new; of the rest most orders regular; what is left budget.  Ties by number."""
    means = customers.groupBy(assigned).agg(*[F.avg(c).alias(c) for c in ("recency_days", "frequency", "monetary_value", "tenure_days")])
    left = sorted(means.collect(), key=lambda r: r[assigned])   # at most five rows
    if len(left) > 5:
        raise ValueError("the notebook names five clusters")
    names = {}
    for name, col, sign in ((VIP, "monetary_value", 1), (CHURN_RISK, "recency_days", 1), (NEW, "tenure_days", -1),
                            (REGULAR, "frequency", 1), (BUDGET, "monetary_value", -1)):
        if left:
            pick = max(left, key=lambda r: (sign * (r[col] or 0.0), -r[assigned]))
            names[pick[assigned]] = name
            left.remove(pick)
    persona = F.lit(None).cast("string")
    for cluster, name in names.items():
        persona = F.when(F.col(assigned) == F.lit(cluster), F.lit(name)).otherwise(persona)
    return customers.withColumn("persona", persona)


def five_clusters(customers: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Customers with ``cluster`` of a K-Means with ``k`` = 5 on standardised recency, frequency and spend."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from tillsight.operators.cluster import standardized
    cols = ["recency_days", "frequency", "monetary_value"]
    x = VectorAssembler(inputCols=[f"s_{c}" for c in cols], outputCol="features").transform(standardized(customers, cols))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(x).transform(x).drop("features", *[f"s_{c}" for c in cols])
