"""Model plumbing: label formulas, stratified split, metrics against brute force."""

import math

import numpy as np

from tillsight.operators import supervised


def _customers(spark, n=60):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03d}", int(rng.integers(0, 300)), int(rng.integers(1, 20)), float(rng.uniform(10, 900)),
             float(rng.uniform(5, 90)), int(rng.integers(1, 400)), float(rng.uniform(0, 3)), float(rng.uniform(0, .5)),
             int(rng.integers(1, 30)), float(rng.uniform(0, 100))) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, recency_days long, frequency long, monetary_value double, "
                                       "avg_order_value double, tenure_days long, purchase_rate double, return_rate double, "
                                       "product_diversity long, churn_risk double"), rows


def test_predictive_labels(spark):
    df, rows = _customers(spark)
    out = {r["customer_id"]: r for r in supervised.predictive_labels(df).collect()}
    rm = np.quantile([r[1] for r in rows], .5)
    fm = np.quantile([r[2] for r in rows], .5)
    for r in rows:
        o = out[r[0]]
        assert o["purchase_target"] == int(r[1] <= rm and r[2] >= fm)
        assert math.isclose(o["next_days"], max(1, r[1] * .65 + 30 / (r[6] + .2)))
        assert math.isclose(o["future_spend"], r[4] * max(1, r[6]) * 3)


def test_stratified_split_keeps_class_shares(spark):
    df, rows = _customers(spark, 80)
    lab = df.withColumn("label", (df.churn_risk >= 50).cast("int"))
    train, test = supervised.stratified_split(lab, "label", 0.25)
    counts = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}
    tcounts = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    for k, n in counts.items():
        assert tcounts[k] == n - math.ceil(n * 0.75)
    assert train.count() + test.count() == 80
    assert not set(r["customer_id"] for r in train.collect()) & set(r["customer_id"] for r in test.collect())


def test_metrics_and_auc_match_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.uniform(0, 1, 200) * 0.6 + y * 0.3, 2)   # ties on purpose
    p = (s >= 0.5).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, p)], "label int, p1 double, prediction int")
    m = supervised.classification_metrics(df, "label", "prediction", "p1")
    tp = int(((y == 1) & (p == 1)).sum()); fp = int(((y == 0) & (p == 1)).sum())  # noqa: E702
    fn = int(((y == 1) & (p == 0)).sum()); tn = int(((y == 0) & (p == 0)).sum())  # noqa: E702
    assert m["confusion_matrix"] == [[tn, fp], [fn, tp]]
    assert math.isclose(m["accuracy"], (tp + tn) / 200)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert math.isclose(m["roc_auc"], auc)
    pts = supervised.roc_points(df, "label", "p1").orderBy("threshold", ascending=False).collect()
    assert math.isclose(pts[-1]["tpr"], 1.0) and math.isclose(pts[-1]["fpr"], 1.0)
