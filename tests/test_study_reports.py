"""Churn study, samples and report views against plain recomputation."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.operators import reports, study
from tillsight.operators.supervised import roc_auc


def test_noise_is_normal_and_keyed(spark):
    ids = spark.range(40_000).withColumn("z", study.gaussian_noise(F.col("id"), 7))
    z = np.array([r["z"] for r in ids.orderBy("id").collect()])
    again = np.array([r["z"] for r in spark.range(40_000).repartition(7).withColumn(
        "z", study.gaussian_noise(F.col("id"), 7)).orderBy("id").collect()])
    assert (z == again).all() and np.isfinite(z).all()
    assert abs(z.mean()) < .02 and abs(z.std() - 1) < .02
    assert abs((z ** 3).mean()) < .06 and abs((z ** 4).mean() - 3) < .15
    other = np.array([r["z"] for r in spark.range(40_000).select(study.gaussian_noise(F.col("id"), 8).alias("z")).collect()])
    assert abs(np.corrcoef(z, other)[0, 1]) < .03


def test_churn_label_shares_and_odd_tables(spark):
    schema = "CustomerID string, Recency long, Frequency long, Monetary double, CustomerScore double"
    rows = [(str(i), i % 90, 1 + i % 7, float(i), i / 500) for i in range(500)]
    df = spark.createDataFrame(rows, schema)
    out = study.notebook_churn_label(df)
    assert out.where("Churn = 1").count() == 200  # above the 60 % quantile
    r = out.agg(F.min("ChurnScore").alias("a"), F.max("ChurnScore").alias("b")).first()
    assert (r["a"], r["b"]) == (0.0, 1.0)
    assert study.notebook_churn_label(df.limit(0)).count() == 0
    same = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("b", 0, 0, 0.0, 0.0)], schema)
    assert [tuple(x) for x in study.notebook_churn_label(same, noise=0.0).select("ChurnScore", "Churn").collect()] == [(0.0, 0)] * 2


def test_study_metrics_are_those_of_sql(spark):
    rng = np.random.default_rng(3)
    rows = [(m, str(i), int(y), int(p > .5), float(p)) for m in ("A", "B", "C")
            for i, (y, p) in enumerate(zip(rng.integers(0, 2, 300), np.round(rng.uniform(0, 1, 300), 2)))]
    rows += [("one", "1", 1, 1, .5)] + [("A2", r[1], r[2], r[3], r[4]) for r in rows[:300]]
    pred = spark.createDataFrame(rows, "model string, CustomerID string, label int, prediction int, p1 double")
    got = {r["model"]: r for r in study.study_table(pred).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (model VARCHAR, id VARCHAR, y INT, q INT, s DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute("""
        WITH c AS (SELECT model, unnest([0, 1]) AS k FROM (SELECT DISTINCT model FROM p)),
        m AS (SELECT c.model, k, count(*) FILTER (y = k) AS t, count(*) FILTER (q = k) AS n, count(*) FILTER (y = k AND q = k) AS h
              FROM c JOIN p ON p.model = c.model GROUP BY 1, 2),
        v AS (SELECT *, CASE WHEN n > 0 THEN h / n ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS re FROM m)
        SELECT model, sum(t), sum(h) / sum(t), sum(pr * t) / sum(t), sum(re * t) / sum(t),
               sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * t) / sum(t) FROM v GROUP BY 1""").fetchall()
    for model, support, *figures in want:
        r = got[model]
        assert r["support"] == support
        assert [r[k] for k in ("accuracy", "precision", "recall", "f1")] == pytest.approx(figures)
    assert got["one"]["roc_auc"] is None and got["one"]["rank"] == 1
    assert got["A"]["rank"] == got["A2"]["rank"]
    assert sorted({r["rank"] for r in got.values()}) == list(range(1, 1 + len({r["accuracy"] for r in got.values()})))
    assert got["B"]["roc_auc"] == pytest.approx(roc_auc(pred.where("model = 'B'")))


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_hash_sample_has_its_size(spark, n):
    df = spark.range(1000).selectExpr("cast(id as string) as customer_id", "id as v")
    got = reports.hash_sample(df, n).collect()
    assert len(got) == min(n, 1000) == len({r["customer_id"] for r in got})
    assert {tuple(r) for r in got} == {tuple(r) for r in reports.hash_sample(df.repartition(7), n).collect()}
    if n == 37:
        assert {tuple(r) for r in got} <= {tuple(r) for r in reports.hash_sample(df, 999).collect()}


def test_percent_view_and_quartiles(spark):
    df = spark.createDataFrame([("a", .25, 50.0, None), ("b", -1.0, 12.34, None), ("c", None, 99.96, None)],
                               "id string, share double, rate double, none double")
    got = {r["id"]: tuple(r)[1:] for r in reports.percent_view(df, ["share", "rate", "none"]).collect()}
    assert got == {"a": ("25.0%", "50.0%", "—"), "b": ("-100.0%", "12.3%", "—"), "c": ("—", "100.0%", "—")}
    r = {x["column"]: x for x in reports.describe_with_quartiles(df, ["share", "rate"]).collect()}
    assert (r["share"]["q25"], r["share"]["q50"], r["share"]["count"]) == (-.6875, -.375, 2)
    assert r["rate"]["q50"] == 50.0


def test_reports_break_ties_by_id(spark):
    df = spark.createDataFrame([(i, "p", "t", 5.0, 50.0, float(c)) for i, c in (("b", 1), ("a", 1), ("c", 2))],
                               "customer_id string, persona string, customer_tier string, health_score double, churn_risk double, clv_estimate double")
    assert [r["customer_id"] for r in reports.priority_report(df).orderBy("place").collect()] == ["c", "a", "b"]
    assert [r["customer_id"] for r in reports.scoring_report(df, 2).collect()] == ["a", "b"]
