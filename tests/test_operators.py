"""Operators on small literal inputs, checked against direct computations."""

import datetime
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tillsight.operators import (cleaning, cohorts, density, features, iforest, recommend, reports, scores)


def _tx(spark, rows):
    df = spark.createDataFrame(rows, "invoice_id string, customer_id string, invoice_date timestamp_ntz, "
                                     "stock_code string, product_name string, quantity long, unit_price double, "
                                     "country string")
    return cleaning.clean_transactions(df)


D = datetime.datetime


def sample_rows():
    return [
        ("1", "A", D(2024, 1, 1), "P1", "mug", 2, 10.0, "UK"),
        ("1", "A", D(2024, 1, 1), "P2", "cup", 1, 5.0, "UK"),
        ("2", "A", D(2024, 3, 5), "P1", "mug", 1, 10.0, "UK"),
        ("3", "B", D(2024, 2, 10), "P2", "cup", 4, 5.0, "FR"),
        ("3", "B", D(2024, 2, 10), "P3", "pen", 1, 1.0, "FR"),
        ("4", "B", D(2024, 2, 11), "P3", "pen", -1, 1.0, "FR"),
        ("5", "C", D(2024, 3, 1), "P1", "mug", 1, 12.0, "DE"),
        ("6", "D", D(2024, 3, 9), "P4", "bag", -2, 3.0, "DE"),
    ]


def test_customer_features(spark):
    f = {r["customer_id"]: r for r in features.build_customer_features(_tx(spark, sample_rows())).collect()}
    assert set(f) == {"A", "B", "C"}           # D has only a return line
    a = f["A"]
    assert a["frequency"] == 2 and a["monetary_value"] == 35.0 and a["avg_order_value"] == 17.5
    assert a["recency_days"] == 5               # reference = 2024-03-10
    assert a["tenure_days"] == 69
    assert math.isclose(a["purchase_rate"], 2 / 69 * 30)
    assert math.isclose(f["B"]["return_rate"], 1 / 3)
    assert f["A"]["product_diversity"] == 2


def test_quintile_scores_follow_first_rank(spark):
    rows = [(f"c{i}", i % 3, float(i), i) for i in range(7)]
    df = spark.createDataFrame(rows, "customer_id string, recency_days long, monetary_value double, frequency long")
    out = {r["customer_id"]: r for r in scores.rfm_analysis(df).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    n = len(rows)
    for rank, r in enumerate(order, start=1):
        assert out[r[0]]["m_score"] == min(5, max(1, math.ceil(rank / n * 5)))
    rec_order = sorted(rows, key=lambda r: (r[1], r[0]))
    for rank, r in enumerate(rec_order, start=1):
        assert out[r[0]]["r_score"] == min(5, max(1, math.ceil(((1 - rank / n) + 1 / n) * 5)))


def test_cohort_retention(spark):
    out = {(r["cohort_month"], r["period"]): r for r in cohorts.cohort_retention(_tx(spark, sample_rows())).collect()}
    assert out[("2024-01", 0)]["active_customers"] == 1
    assert out[("2024-01", 2)]["retention_rate"] == 100.0
    assert out[("2024-02", 0)]["active_customers"] == 1


def test_co_purchase_and_recommendations(spark):
    tx = _tx(spark, sample_rows())
    co = {(r["product_a"], r["product_b"]): r["n"] for r in recommend.co_purchase_counts(tx).collect()}
    assert co == {("P1", "P2"): 1, ("P2", "P1"): 1, ("P2", "P3"): 1, ("P3", "P2"): 1}
    recs = recommend.recommend_products(tx, 5).collect()
    a = [r["product_id"] for r in sorted((r for r in recs if r["customer_id"] == "A"), key=lambda r: r["rank"])]
    assert a == ["P3"]
    c = [r["product_id"] for r in sorted((r for r in recs if r["customer_id"] == "C"), key=lambda r: r["rank"])]
    assert c[0] == "P2"


def test_upsell_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        price = float(np.round(rng.uniform(1, 50), 2))
        for j in range(int(rng.integers(1, 4))):
            rows.append((f"i{i}-{j}", f"c{j}", D(2024, 1, 1 + j), f"P{i:02d}", f"name{i}", 1, price, "UK"))
    tx = _tx(spark, rows)
    cat = {r["product_id"]: r for r in recommend.product_catalog(tx).collect()}
    got = {}
    for r in recommend.upsell(tx, 3).collect():
        got.setdefault(r["product_id"], []).append((r["rank"], r["recommended_id"]))
    for pid, p in cat.items():
        band = [q for q in cat.values() if p["price"] < q["price"] <= p["price"] * 1.75]
        band.sort(key=lambda q: (-q["popularity"], q["price"], q["product_id"]))
        want = [q["product_id"] for q in band[:3]]
        assert [x[1] for x in sorted(got.get(pid, []))] == want


def _brute_dbscan(x, eps, min_samples):
    n = len(x)
    nb = [[j for j in range(n) if np.sum((x[i] - x[j]) ** 2) <= eps * eps] for i in range(n)]
    core = [len(a) >= min_samples for a in nb]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            if core[i]:
                for j in nb[i]:
                    if core[j] and label[j] < label[i]:
                        label[i] = label[j]
                        changed = True
    out = []
    for i in range(n):
        if core[i]:
            out.append(label[i])
        else:
            cand = [label[j] for j in nb[i] if core[j]]
            out.append(min(cand) if cand else None)
    ids = sorted({v for v in out if v is not None})
    return [ids.index(v) if v is not None else -1 for v in out]


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(0, .3, (25, 3)), rng.normal(3, .3, (25, 3)), rng.uniform(-4, 7, (10, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, s_a double, s_b double, s_c double")
    got = {r["id"]: r["label"] for r in density.dbscan(df, eps=0.6, min_samples=4, id_col="id").collect()}
    want = _brute_dbscan(pts, 0.6, 4)
    assert [got[i] for i in range(len(pts))] == want


def test_isolation_forest_flags_outliers(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 1, (200, 2)), np.array([[12.0, 12.0], [-11.0, 13.0]])])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, s_a double, s_b double")
    out = {r["id"]: r for r in iforest.isolation_forest(df, contamination=0.02, id_col="id", n_trees=50).collect()}
    assert out[200]["anomaly_flag"] == 1 and out[201]["anomaly_flag"] == 1
    assert sum(r["anomaly_flag"] for r in out.values()) <= 6
    assert all(0 < r["anomaly_score"] < 1 for r in out.values())


def test_histogram_and_value_counts(spark):
    df = spark.createDataFrame([(float(v), "a" if v < 5 else "b") for v in range(10)], "x double, t string")
    h = reports.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 2]
    vc = reports.value_counts(df, "t").collect()
    assert [(r["t"], r["customers"]) for r in vc] == [("a", 5), ("b", 5)]


def test_correlation_is_symmetric(spark):
    df = spark.createDataFrame([(float(i), float(i * 2 + 1), float((i * 7) % 5)) for i in range(20)], "a double, b double, c double")
    c = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in reports.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert math.isclose(c[("a", "b")], 1.0) and math.isclose(c[("a", "c")], c[("c", "a")])


def test_tfidf_similarity_matches_numpy(spark):
    names = ["red mug", "blue mug", "red pen", "small blue pen", "the mug"]
    rows = [(str(i), "A", D(2024, 1, 1), f"P{i}", nm, 1, 1.0, "UK") for i, nm in enumerate(names)]
    got = {(r["description"], r["similar_description"]): r["similarity"]
           for r in recommend.tfidf_similar_descriptions(_tx(spark, rows), 10).collect()}
    # brute force: "the" is an English stop word
    docs = [[t for t in nm.split() if t != "the"] for nm in names]
    vocab = sorted({t for d in docs for t in d})
    n = len(docs)
    dfc = {t: sum(t in d for d in docs) for t in vocab}
    m = np.array([[d.count(t) * (math.log((1 + n) / (1 + dfc[t])) + 1) for t in vocab] for d in docs])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = m @ m.T
    for i, j in itertools.permutations(range(n), 2):
        if sim[i, j] > 0:
            assert math.isclose(got[(names[i], names[j])], round(sim[i, j], 4), abs_tol=1e-4)
        else:
            assert (names[i], names[j]) not in got


def test_features_do_not_depend_on_session_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        f = {r["customer_id"]: r for r in features.build_customer_features(_tx(spark, sample_rows())).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert f["A"]["recency_days"] == 5 and f["A"]["tenure_days"] == 69
    assert f["A"]["last_purchase"] == D(2024, 3, 5)


def test_co_purchase_hot_basket_split_is_exact(spark):
    rows = [("big", "A", D(2024, 1, 1), f"P{i}", "x", 1, 1.0, "UK") for i in range(12)]
    rows += [("small", "B", D(2024, 1, 2), f"P{i}", "x", 1, 1.0, "UK") for i in (0, 1, 20)]
    tx = _tx(spark, rows)
    plain = {(r[0], r[1]): r[2] for r in recommend.co_purchase_counts(tx, block=10**9).collect()}
    split = {(r[0], r[1]): r[2] for r in recommend.co_purchase_counts(tx, block=3).collect()}
    assert plain == split
    assert plain[("P0", "P1")] == 2 and len(plain) == 12 * 11 + 2 * 2


def test_standardized_uses_population_deviation(spark):
    from tillsight.operators.cluster import standardized
    out = standardized(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [(r["s_a"], r["s_b"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]
