"""The notebook churn study: label, split, models, and metrics from one confusion cube."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.plans.ranking import exact_quantiles, global_cumsum
from tillsight.session import dealt_for_fits, materialize

# ---- fixed values that must equal the reference ----
CHURN_WEIGHTS = [("Recency", 0.35, False), ("Frequency", 0.25, True), ("Monetary", 0.20, True), ("CustomerScore", 0.20, True)]
NOISE_SCALE = 0.08
CHURN_QUANTILE = 0.60
STUDY_FEATURES = ["Recency", "Frequency", "Monetary", "CustomerScore"]
# ---- end of fixed values ----


def gaussian_noise(key: Column, seed: int = 42) -> Column:
    """A standard normal draw that depends on the key and the seed alone: two uniforms from
    hashes of both, turned by Box-Muller.  The same row gets the same draw in any partition,
    on any retry."""
    def uniform(k: int) -> Column:
        h = F.pmod(F.xxhash64(key.cast("string"), F.lit(seed), F.lit(k)), F.lit(1 << 52))
        return (h.cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(F.lit(-2.0) * F.log(uniform(0))) * F.cos(F.lit(2.0 * math.pi) * uniform(1))


def notebook_churn_label(customers: DataFrame, noise: float = NOISE_SCALE, seed: int = 42,
                         key: str = "CustomerID") -> DataFrame:
    """``customers`` (the notebooks' table) with ``ChurnScore`` in 0..1 and ``Churn``.

    The score weighs each figure's share of its maximum -- recency as it is, the others
    inverted -- plus ``noise`` times a normal draw keyed by the customer, rescaled to its
    range; customers above its 60 % quantile are churned.  A maximum of zero, or one
    score for all, makes the share zero.  An empty table stays empty.
    """
    top = customers.agg(*[F.max(c).cast("double").alias(c) for c, _, _ in CHURN_WEIGHTS]).first()
    score = F.lit(0.0)
    for c, weight, inverted in CHURN_WEIGHTS:
        share = F.col(c).cast("double") / F.lit(top[c]) if top[c] else F.lit(0.0)
        score = score + F.lit(weight) * ((F.lit(1.0) - share) if inverted else share)
    if noise:
        score = score + F.lit(noise) * gaussian_noise(F.col(key), seed)
    scored = materialize(customers.withColumn("_s", score))
    r = scored.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
    span = (r["hi"] - r["lo"]) if r["lo"] is not None else 0.0
    scaled = scored.withColumn("ChurnScore", (F.col("_s") - F.lit(r["lo"])) / F.lit(span) if span else F.lit(0.0)).drop("_s")
    cut = exact_quantiles(scaled, {"q": ("ChurnScore", CHURN_QUANTILE)}).first()
    return scaled.withColumn("Churn", (F.col("ChurnScore") > F.lit(cut["q"] if cut else None)).cast("int"))


def held_out(df: DataFrame, share: float = 0.2, key: str = "CustomerID", out: str = "held_out") -> DataFrame:
    """Marks the rows whose key's checksum falls in the last ``share`` of its range: a plain
    split that needs no count, and that any engine can repeat."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn(out, at >= F.lit(1.0 - share))


def confusion_cube(predictions: DataFrame, by: str = "model", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(by, label, prediction, n)``: all that the metrics need, from one aggregate."""
    return predictions.groupBy(by, F.col(label).cast("int").alias("label"),
                               F.col(prediction).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def weighted_metrics(cube: DataFrame, by: str = "model") -> DataFrame:
    """``(by, support, accuracy, precision, recall, f1)``: per class metrics weighted by the
    class's true rows (zero where undefined), from the confusion cube alone."""
    c = cube.select(by, F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n"),
                 F.lit(0).cast("long").alias("hit")))).alias("x"))
    per = c.groupBy(by, "x.cls").agg(F.sum("x.true_n").alias("t"), F.sum("x.pred_n").alias("p"), F.sum("x.hit").alias("h"))
    prec = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0)
    rec = F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    total = F.sum("t")
    return per.groupBy(by).agg(total.alias("support"), (F.sum("h") / total).alias("accuracy"),
                               (F.sum(prec * F.col("t")) / total).alias("precision"),
                               (F.sum(rec * F.col("t")) / total).alias("recall"), (F.sum(f1 * F.col("t")) / total).alias("f1"))


def areas_under_roc(predictions: DataFrame, by: str = "model", label: str = "label", score: str = "p1") -> DataFrame:
    """``(by, roc_auc)``, exact, ties counted half, for all models in one running sum; null
    for a model whose rows are of one class."""
    g = predictions.groupBy(by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                                             F.count_if(F.col(label) == 0).alias("neg"))
    cum = global_cumsum(g, ["s"], group_cols=[by], weight_col="neg", out_col="neg_le", total_col="neg_tot")
    pairs = F.sum("pos") * F.max("neg_tot")
    return cum.groupBy(by).agg(F.when(pairs > 0, F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") * 0.5)) / pairs).alias("roc_auc"))


def study_table(predictions: DataFrame, by: str = "model") -> DataFrame:
    """Weighted metrics, area under the curve and the dense rank by accuracy, one row per model."""
    m = weighted_metrics(confusion_cube(predictions, by), by).join(areas_under_roc(predictions, by), by, "left")
    one = Window.partitionBy(F.lit(0)).orderBy(F.col("accuracy").desc())  # one row per model
    return m.withColumn("rank", F.dense_rank().over(one))


def churn_study_predictions(labelled: DataFrame, seed: int = 42, boosted: bool = True) -> DataFrame:
    """``(model, CustomerID, label, prediction, p1)`` of the held-out rows, written once.

    Logistic regression (standardised), decision tree, random forest (200 trees) and boosted trees
    on the four figures, fitted on the other rows.
    """
    from functools import reduce

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    from tillsight.operators.supervised import assemble, positive_probability

    data = dealt_for_fits(assemble(held_out(labelled.withColumn("label", F.col("Churn"))), STUDY_FEATURES)
                          .select("CustomerID", "label", "held_out", "features"), labelled.count())
    train, test = data.where(~F.col("held_out")), data.where("held_out")
    models = {
        "Logistic Regression": Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="zfeatures", withMean=True, withStd=True),
            LogisticRegression(featuresCol="zfeatures", maxIter=1000)]),
        "Decision Tree": DecisionTreeClassifier(maxDepth=5, seed=seed),
        "Random Forest": RandomForestClassifier(numTrees=200, maxDepth=10, seed=seed),
    }
    if boosted:
        models["Gradient Boosted Trees"] = GBTClassifier(maxIter=50, maxDepth=5, stepSize=0.05, seed=seed)
    parts = [positive_probability(m.fit(train).transform(test)).select(
        F.lit(name).alias("model"), "CustomerID", "label", F.col("prediction").cast("int").alias("prediction"), "p1")
        for name, m in models.items()]
    return materialize(reduce(DataFrame.unionByName, parts))
