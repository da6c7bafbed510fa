"""Supervised customer models with Spark ML: purchase / next-purchase /
spend models, the churn model comparison, scoring, metrics, importances,
ROC points and per-row explanations.

Labels are columns computed with DataFrame expressions; splits are stratified
by a hash of the customer id within each class (deterministic, no sampling
drift between runs); class balancing uses ``weightCol``.  Metrics are single
aggregates over the prediction frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.exprs import finite_or_zero
from tillsight.plans.ranking import exact_quantiles, global_cumsum

MODEL_FEATURES = ["recency_days", "frequency", "monetary_value", "avg_order_value", "tenure_days",
                  "purchase_rate", "return_rate", "product_diversity"]
CHURN_FEATURES = [f for f in MODEL_FEATURES if f != "recency_days"]
COMPARISON_FEATURES = ["monetary_value", "avg_order_value", "tenure_days", "purchase_rate", "product_diversity"]
MIN_CUSTOMERS = 20
RISK_BANDS = [(-0.01, 0.30, "Low"), (0.30, 0.60, "Medium"), (0.60, 1.01, "High")]


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    clean = df.withColumns({c: finite_or_zero(F.col(c)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(clean)


def stratified_split(df: DataFrame, label: str, test_share: float = 0.25, key: str = "customer_id", seed: int = 42):
    """Within each class, the rows whose hash rank falls in the last
    ``test_share`` go to the test set, so class shares are kept exactly.  The
    per-class rank is a distributed cumulative count (range-partitioned), not a
    one-task window per class."""
    h = df.withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    r = global_cumsum(h, ["_h", key], group_cols=[label], out_col="_pos", total_col="_n")
    is_test = F.col("_pos") > F.ceil(F.col("_n") * (1 - test_share))
    return r.where(~is_test).drop("_pos", "_n", "_h"), r.where(is_test).drop("_pos", "_n", "_h")


def balanced_weights(df: DataFrame, label: str, out: str = "w") -> DataFrame:
    """scikit-learn's ``class_weight="balanced"``: n / (classes x n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    k = counts.count()
    tot = counts.agg(F.sum("_nc")).first()[0]
    return df.join(F.broadcast(counts), label).withColumn(out, F.lit(float(tot)) / (F.lit(float(k)) * F.col("_nc"))).drop("_nc")


def positive_probability(pred: DataFrame, out: str = "p1") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = "p1") -> dict:
    """Accuracy, precision, recall, F1 (zero division -> 0), confusion counts
    and exact ROC AUC (rank-sum over the distinct scores)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    r = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")).first()
    tp, fp, fn, tn = r["tp"], r["fp"], r["fn"], r["tn"]
    n = tp + fp + fn + tn
    prec = tp / (tp + fp) if tp + fp else 0.0
    rec = tp / (tp + fn) if tp + fn else 0.0
    out = {"accuracy": (tp + tn) / n if n else float("nan"), "precision": prec, "recall": rec,
           "f1": 2 * prec * rec / (prec + rec) if prec + rec else 0.0,
           "confusion_matrix": [[tn, fp], [fn, tp]]}
    if score and (tp + fn) and (tn + fp):
        out["roc_auc"] = roc_auc(pred, label, score)
    return out


def roc_auc(pred: DataFrame, label: str = "label", score: str = "p1") -> float:
    """Mann-Whitney AUC with ties counted half: distinct scores ordered, running
    negative counts by a distributed cumulative sum."""
    g = pred.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                                  F.count_if(F.col(label) == 0).alias("neg"))
    cum = global_cumsum(g, ["s"], weight_col="neg", out_col="neg_le", total_col="neg_tot")
    r = cum.agg(F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") * 0.5)).alias("u"),
                F.sum("pos").alias("P"), F.max("neg_tot").alias("N")).first()
    return float(r["u"]) / (r["P"] * r["N"]) if r["P"] and r["N"] else float("nan")


def roc_points(pred: DataFrame, label: str = "label", score: str = "p1") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first."""
    g = pred.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    neg_s = g.withColumn("_neg_s", -F.col("threshold"))
    tp = global_cumsum(neg_s, ["_neg_s"], weight_col="pos", out_col="tp", total_col="P")
    both = global_cumsum(tp, ["_neg_s"], weight_col="neg", out_col="fp", total_col="N")
    return both.select("threshold", (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))


# ------------------------------------------------------------------ M10, M11
@dataclass
class PredictiveBundle:
    models: dict
    metrics: dict
    feature_names: list = field(default_factory=lambda: list(MODEL_FEATURES))


def predictive_labels(customers: DataFrame) -> DataFrame:
    """purchase = recency <= median and frequency >= median; next purchase days =
    max(1, .65 recency + 30 / (rate + .2)); future spend = aov x max(1, rate) x 3."""
    q = exact_quantiles(customers, {"rm": ("recency_days", 0.5), "fm": ("frequency", 0.5)}).first()
    return customers.withColumns({
        "purchase_target": ((F.col("recency_days") <= F.lit(q["rm"])) & (F.col("frequency") >= F.lit(q["fm"]))).cast("int"),
        "next_days": F.greatest(F.lit(1.0), F.col("recency_days") * 0.65 + F.lit(30.0) / (F.col("purchase_rate") + 0.2)),
        "future_spend": F.col("avg_order_value") * F.greatest(F.lit(1.0), F.col("purchase_rate")) * 3,
    })


def train_predictive_models(customers: DataFrame, seed: int = 42, trees: int = 200) -> PredictiveBundle:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    from tillsight.session import dealt_for_fits
    n = customers.count()
    if n < MIN_CUSTOMERS:
        return PredictiveBundle({}, {"status": "Need at least 20 customers for predictive models"})
    data = dealt_for_fits(assemble(predictive_labels(customers), MODEL_FEATURES), n, write_small=False)
    classes = data.select("purchase_target").distinct().count()
    train, test = stratified_split(data, "purchase_target") if classes > 1 else data.randomSplit([0.75, 0.25], seed)
    train = dealt_for_fits(balanced_weights(train, "purchase_target"), n, write_small=False)
    purchase = RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, seed=seed, labelCol="purchase_target",
                                      weightCol="w").fit(train)
    nxt = RandomForestRegressor(numTrees=trees, minInstancesPerNode=2, seed=seed, labelCol="next_days").fit(data)
    spend = RandomForestRegressor(numTrees=trees, minInstancesPerNode=2, seed=seed, labelCol="future_spend").fit(data)
    pred = positive_probability(purchase.transform(test))
    m = classification_metrics(pred, "purchase_target")
    mae = lambda model, lab: model.transform(data).agg(F.avg(F.abs(F.col(lab) - F.col("prediction")))).first()[0]
    metrics = {"purchase_accuracy": round(m["accuracy"], 3),
               "purchase_auc": round(m["roc_auc"], 3) if "roc_auc" in m else float("nan"),
               "next_purchase_mae_in_sample": round(mae(nxt, "next_days"), 3),
               "spending_mae_in_sample": round(mae(spend, "future_spend"), 3)}
    return PredictiveBundle({"purchase": purchase, "next_purchase": nxt, "spending": spend}, metrics)


def score_predictions(customers: DataFrame, bundle: PredictiveBundle) -> DataFrame:
    """Adds purchase probability (3 dp), churn probability = churn risk / 100
    (3 dp, a rescaling, not a model), next purchase days (>= 1, 1 dp) and
    predicted 90-day spend (>= 0, 2 dp)."""
    if not bundle.models:
        return customers
    from pyspark.ml.functions import vector_to_array
    x = assemble(customers, MODEL_FEATURES)
    p = bundle.models["purchase"].transform(x).select(
        "customer_id", F.round(vector_to_array("probability")[1], 3).alias("purchase_probability"))
    nx = bundle.models["next_purchase"].setPredictionCol("_nx").transform(x).select("customer_id", "_nx")
    sp = bundle.models["spending"].setPredictionCol("_sp").transform(x).select("customer_id", "_sp")
    out = customers.join(p, "customer_id").join(nx, "customer_id").join(sp, "customer_id")
    return out.withColumns({
        "predicted_churn_probability": F.round(F.least(F.greatest(F.coalesce("churn_risk", F.lit(0.0)), F.lit(0.0)),
                                                       F.lit(100.0)) / 100, 3),
        "predicted_next_purchase_days": F.round(F.greatest(F.lit(1.0), F.col("_nx")), 1),
        "predicted_90d_spend": F.round(F.greatest(F.lit(0.0), F.col("_sp")), 2),
    }).drop("_nx", "_sp")


def save_bundle(bundle: PredictiveBundle, path: str) -> str:
    """Each model below ``path``, in a folder of its name."""
    from tillsight.sources.files import save_model
    for name, model in bundle.models.items():
        save_model(model, f"{path}/{name}")
    return path


def load_bundle(path: str) -> PredictiveBundle:
    """The three models that ``save_bundle`` stored."""
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.regression import RandomForestRegressionModel
    from tillsight.sources.files import load_model
    kinds = {"purchase": RandomForestClassificationModel, "next_purchase": RandomForestRegressionModel,
             "spending": RandomForestRegressionModel}
    return PredictiveBundle({name: load_model(cls, f"{path}/{name}") for name, cls in kinds.items()}, {})


def score_typical_customer(cohort: DataFrame, bundle: PredictiveBundle, minimum: int = 5) -> DataFrame:
    """The cohort's typical customer (medians, a missing or infinite value counts 0; most
    common persona and tier; size) with the models' scores; no row below ``minimum`` customers."""
    from tillsight.operators.reports import typical_customer
    from tillsight.session import materialize
    cols = [*MODEL_FEATURES, "churn_risk"]
    clean = cohort.withColumns({c: finite_or_zero(F.col(c)) for c in cols})
    typical = typical_customer(clean, cols).where(F.col("customers") >= minimum)
    return score_predictions(materialize(typical.withColumn("customer_id", F.lit("typical"))), bundle).drop("customer_id")


# ------------------------------------------------------------------ M12-M16
def churn_target(customers: DataFrame) -> tuple[DataFrame, str]:
    if "churned" in customers.columns:
        return customers.withColumn("label", F.col("churned").cast("int")), "Provided churned label"
    if "churn" in customers.columns:
        return customers.withColumn("label", F.col("churn").cast("int")), "Provided churn label"
    if "churn_risk" not in customers.columns:
        raise ValueError("A churned/churn label or churn_risk column is required")
    q75 = exact_quantiles(customers, {"q": ("recency_days", 0.75)}).first()["q"]
    lab = ((F.coalesce("churn_risk", F.lit(0.0)) >= 65) | (F.coalesce("recency_days", F.lit(0)) >= F.lit(q75))).cast("int")
    return customers.withColumn("label", lab), "Proxy label derived from churn_risk and upper-quartile recency"


@dataclass
class ChurnResult:
    models: dict
    metrics: DataFrame
    confusion_matrices: dict
    feature_importance: DataFrame
    feature_names: list
    target_definition: str

    def best_model_name(self) -> str:
        return self.metrics.orderBy(F.col("roc_auc").desc(), F.col("f1").desc()).first()["model"]


def _churn_estimators(seed: int, depth_tree: int = 7, min_leaf: int = 2, forest: int = 300, boosted: bool = True):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                           RandomForestClassifier)
    from pyspark.ml.feature import StandardScaler
    ests = {
        "Logistic Regression": Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="zfeatures", withMean=True, withStd=True),
            LogisticRegression(featuresCol="zfeatures", weightCol="w", maxIter=1500)]),
        "Decision Tree": DecisionTreeClassifier(maxDepth=depth_tree, minInstancesPerNode=min_leaf, weightCol="w", seed=seed),
        "Random Forest": RandomForestClassifier(numTrees=forest, minInstancesPerNode=min_leaf, weightCol="w", seed=seed),
    }
    if boosted:
        ests["Gradient Boosted Trees"] = GBTClassifier(maxIter=250, maxDepth=5, stepSize=0.05, subsamplingRate=0.9,
                                                       seed=seed)
    return ests


def _importances(name, model, features):
    core = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(core, "featureImportances"):
        vals = core.featureImportances.toArray()
    elif hasattr(core, "coefficients"):
        vals = [abs(v) for v in core.coefficients.toArray()]
    else:
        return []
    return [(name, f, float(v)) for f, v in zip(features, vals)]


def fit_churn_models(customers: DataFrame, seed: int = 42, boosted: bool = True) -> ChurnResult:
    """Logistic regression (standardised), decision tree (depth 7), random
    forest (300 trees), gradient-boosted trees (250 x depth 5) on the 7 churn
    features; stratified 25% test split; metrics sorted by AUC then F1."""
    from tillsight.session import dealt_for_fits, materialize
    spark = customers.sparkSession
    labelled, definition = churn_target(customers)
    if labelled.select("label").distinct().count() < 2:
        raise ValueError("Churn target must contain both classes")
    data = materialize(assemble(labelled, CHURN_FEATURES).select("customer_id", "label", "features"))
    rows_all = data.count()
    train, test = stratified_split(data, "label")
    train = dealt_for_fits(balanced_weights(train, "label"), rows_all)
    test = dealt_for_fits(test, rows_all)
    models, rows, cms, imps = {}, [], {}, []
    for name, est in _churn_estimators(seed, boosted=boosted).items():
        m = est.fit(train)
        # written once: the counts and the curve would each ask the model for every row again
        pred = materialize(positive_probability(m.transform(test)).select("label", "prediction", "p1"))
        met = classification_metrics(pred, "label")
        rows.append((name, round(met["accuracy"], 4), round(met["precision"], 4), round(met["recall"], 4),
                     round(met["f1"], 4), round(met.get("roc_auc", float("nan")), 4)))
        cms[name] = met["confusion_matrix"]
        models[name] = m
        imps += _importances(name, m, CHURN_FEATURES)
    rows.sort(key=lambda r: (-r[5], -r[4]) if r[5] == r[5] else (1.0, -r[4]))
    metrics = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, "
                                          "f1 double, roc_auc double")
    importance = spark.createDataFrame(imps, "model string, feature string, importance double")
    return ChurnResult(models, metrics, cms, importance, list(CHURN_FEATURES), definition)


def predict_churn(result: ChurnResult, customers: DataFrame, model_name: str | None = None) -> DataFrame:
    """Probability (4 dp), prediction at 0.5 and risk band for every row."""
    name = model_name or result.best_model_name()
    if name not in result.models:
        raise ValueError(f"Unknown churn model: {name}")
    return score_churn(result.models[name], customers)


def score_churn(model, customers: DataFrame) -> DataFrame:
    """``predict_churn`` with one fitted (or loaded) model."""
    pred = positive_probability(model.transform(assemble(customers, CHURN_FEATURES)), "_p")
    band = F.lit(None).cast("string")
    for lo, hi, lab in reversed(RISK_BANDS):
        band = F.when((F.col("_p") > lo) & (F.col("_p") <= hi), F.lit(lab)).otherwise(band)
    out = pred.withColumns({"churn_probability": F.round("_p", 4), "churn_prediction": (F.col("_p") >= 0.5).cast("int"),
                            "churn_risk_band": band})
    return out.drop("_p", "features", "zfeatures", "rawPrediction", "probability", "prediction")


def save_churn(result: ChurnResult, path: str) -> str:
    """The fitted churn models below ``path``, each in a folder of its name."""
    from tillsight.sources.files import save_model
    for name, model in result.models.items():
        save_model(model, f"{path}/{name.replace(' ', '_')}")
    return path


def load_churn(path: str, names) -> dict:
    """``{name: model}`` of stored churn models, for ``score_churn``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel
    from tillsight.sources.files import load_model
    kinds = {"Logistic Regression": PipelineModel, "Decision Tree": DecisionTreeClassificationModel,
             "Random Forest": RandomForestClassificationModel, "Gradient Boosted Trees": GBTClassificationModel}
    return {n: load_model(kinds[n], f"{path}/{n.replace(' ', '_')}") for n in names}


def importance_report(importance: DataFrame) -> DataFrame:
    """Importance (4 dp), within-model share (%) and rank."""
    from pyspark.sql import Window
    w = Window.partitionBy("model")
    r = Window.partitionBy("model").orderBy(F.col("importance").desc(), F.col("feature"))
    return importance.select("model", "feature", F.round("importance", 4).alias("importance"),
                             F.round(F.col("importance") / F.sum("importance").over(w) * 100, 1).alias("share_pct"),
                             F.row_number().over(r).alias("rank"))


def model_comparison(customers: DataFrame, seed: int = 42) -> DataFrame:
    """Three classifiers on 5 value features, label churn risk >= 60."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler

    from tillsight.session import dealt_for_fits
    spark = customers.sparkSession
    data = assemble(customers.withColumn("label", (F.col("churn_risk") >= 60).cast("int")), COMPARISON_FEATURES)
    if customers.count() < MIN_CUSTOMERS or data.select("label").distinct().count() < 2:
        return spark.createDataFrame([], "model string, accuracy double, precision double, recall double, f1 double")
    train, test = stratified_split(data, "label")
    train = dealt_for_fits(balanced_weights(train, "label"), customers.count(), write_small=False)
    ests = {
        "Logistic Regression": Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="zfeatures", withMean=True, withStd=True),
            LogisticRegression(featuresCol="zfeatures", weightCol="w", maxIter=1000)]),
        "Decision Tree": DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=4, weightCol="w", seed=seed),
        "Random Forest": RandomForestClassifier(numTrees=200, minInstancesPerNode=3, weightCol="w", seed=seed),
    }
    rows = []
    for name, est in ests.items():
        met = classification_metrics(est.fit(train).transform(test), "label", score=None)
        rows.append((name, round(met["accuracy"], 3), round(met["precision"], 3), round(met["recall"], 3),
                     round(met["f1"], 3)))
    return spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double")


def tree_facts(model) -> dict:
    core = model.stages[-1] if hasattr(model, "stages") else model
    return {"depth": core.depth, "leaves": (core.numNodes + 1) // 2, "features": core.numFeatures}


def linear_explanations(result: ChurnResult, customers: DataFrame, top: int | None = None) -> DataFrame:
    """Exact per-row contributions of the logistic model in log-odds:
    coefficient x standardised value (the standardised mean is 0), long form
    ``(customer_id, feature, contribution, rank)`` ranked by absolute value."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import Window
    model = result.models["Logistic Regression"]
    coefs = model.stages[-1].coefficients.toArray()
    z = model.stages[0].transform(assemble(customers, CHURN_FEATURES)).select(
        "customer_id", vector_to_array("zfeatures").alias("z"))
    items = [F.struct(F.lit(f).alias("feature"), (F.col("z")[i] * F.lit(float(coefs[i]))).alias("contribution"))
             for i, f in enumerate(CHURN_FEATURES)]
    long = z.select("customer_id", F.explode(F.array(*items)).alias("c")).select("customer_id", "c.*")
    w = Window.partitionBy("customer_id").orderBy(F.abs("contribution").desc(), F.col("feature"))
    out = long.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top) if top else out
