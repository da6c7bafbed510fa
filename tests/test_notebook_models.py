"""Notebook forecast models, five personas, scoring by stored models, replayed stream batches."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tillsight.operators import notebook_models as nb
from tillsight.operators import supervised
from tillsight.streaming import ingest


def months(n, start=(2020, 1)):
    out, (y, m) = [], start
    for _ in range(n):
        nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
        out.append(nxt - dt.timedelta(days=1))
        y, m = nxt.year, nxt.month
    return out


def panel(spark):
    rows = [(k, d, 100.0 * (1 + i) + 37 * ((i * 7 + len(k)) % 5)) for k in ("a", "bb") for i, d in enumerate(months(30))]
    rows += [("gap", d, 0.0 if i == 8 else 10.0 + i) for i, d in enumerate(months(16))]
    return spark.createDataFrame(rows, "shop string, InvoiceDate date, Sales double")


def test_table_per_series(spark):
    t = nb.notebook_forecast_table(panel(spark), ["shop"]).toPandas()
    a = t[t["shop"] == "a"].sort_values("InvoiceDate")
    assert len(a) == 24 and list(a["position"]) == list(range(1, 25)) and list(a["held_out"]) == [False] * 19 + [True] * 5
    # months 7 to 16, but not the one after the month without sales
    assert sorted(t[t["shop"] == "gap"]["position"]) == list(range(1, 10))
    r = a.iloc[0]
    sales = [100.0 * (1 + i) + 37 * ((i * 7 + 1) % 5) for i in range(7)]
    assert (r["Lag_6"], r["Lag_1"], r["RollingMean_3"]) == (sales[0], sales[5], pytest.approx(sum(sales[4:]) / 3))


def test_forecasts_and_report(spark):
    pred = nb.notebook_forecasts(nb.notebook_forecast_table(panel(spark), ["shop"]), trees=5, rounds=5)
    con = duckdb.connect()
    con.register("p", pred.toPandas())
    want = con.execute("""SELECT model, avg(abs(prediction - Sales)), avg((prediction - Sales) ** 2), sqrt(avg((prediction - Sales) ** 2)),
        1 - sum((prediction - Sales) ** 2) / (var_pop(Sales) * count(*)) FROM p GROUP BY 1 ORDER BY 1""").fetchall()
    got = sorted(tuple(r) for r in nb.forecast_report(pred).collect())
    assert [g[0] for g in got] == ["Gradient Boosted Trees", "Linear Regression", "Naive", "Random Forest"]
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], rel=1e-9)
    naive = con.execute("SELECT DISTINCT shop, prediction FROM p WHERE model = 'Naive'").fetchall()
    last = {r["shop"]: r["Sales"] for r in panel(spark).where(F.col("InvoiceDate") == F.lit(months(25)[-1])).collect()}
    assert {k: v for k, v in naive if k != "gap"} == last


def test_forecasts_of_nothing(spark):
    empty = nb.notebook_forecast_table(panel(spark).limit(0), ["shop"])
    assert nb.notebook_forecasts(empty).count() == 0 and nb.forecast_report(nb.notebook_forecasts(empty)).count() == 0


def people(spark, n=60):
    rows = [(f"c{i}", float(i % 40), float(1 + i % 9), 50.0 * (1 + i % 13), 20.0 + i % 7, 100.0 + i, 0.1 * (i % 10), 0.0,
             1 + i % 5, float(i % 100), ["x", "y"][i % 3 == 0], "Gold", i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, recency_days double, frequency double, monetary_value double, "
                                       "avg_order_value double, tenure_days double, purchase_rate double, return_rate double, "
                                       "product_diversity int, churn_risk double, persona string, customer_tier string, cluster int")


def test_personas_by_means(spark):
    means = {0: (5, 9, 10, 300), 1: (2, 3, 99, 300), 2: (90, 2, 20, 300), 3: (3, 1, 9, 10), 4: (4, 5, 30, 300)}
    rows = [(k, *map(float, v)) for k, v in means.items() for _ in range(2)]
    d = spark.createDataFrame(rows, "cluster int, recency_days double, frequency double, monetary_value double, tenure_days double")
    got = {r["cluster"]: r["persona"] for r in nb.notebook_personas(d).collect()}
    assert got == {1: nb.VIP, 2: nb.CHURN_RISK, 3: nb.NEW, 0: nb.REGULAR, 4: nb.BUDGET}
    assert nb.notebook_personas(d.where("cluster < 2")).select("persona").distinct().count() == 2
    assert nb.five_clusters(people(spark).drop("cluster")).select("cluster").distinct().count() == 5


def test_scoring_by_stored_models(spark, tmpdir_path):
    bundle = supervised.train_predictive_models(people(spark), trees=5)
    stored = supervised.load_bundle(supervised.save_bundle(bundle, os.path.join(tmpdir_path, "models")))
    cohort = people(spark).where("frequency >= 4")
    kept = supervised.score_typical_customer(cohort, bundle).collect()
    assert kept == supervised.score_typical_customer(cohort, stored).collect()
    assert len(kept) == 1 and kept[0]["customers"] == cohort.count() and 0 <= kept[0]["purchase_probability"] <= 1
    assert supervised.score_typical_customer(cohort.limit(4), stored).count() == 0
    # a missing value counts as 0, not as absent: the median of (0, 0, 0, 4, 5)
    five = people(spark).limit(5).withColumn("frequency", F.when(F.col("cluster") >= 3, F.col("cluster") + 1.0))
    assert supervised.score_typical_customer(five, stored).first()["frequency"] == 0.0


def test_replayed_stream_batch(spark, tmpdir_path):
    store = os.path.join(tmpdir_path, "monthly")
    write = ingest.monthly_revenue_sink(store)
    batch = spark.createDataFrame([(dt.datetime(2024, 1, 5), 20.0), (dt.datetime(2024, 2, 1), 5.0)],
                                  "invoice_date timestamp, revenue double")
    write(batch, 0)
    write(batch, 1)
    write(batch, 1)
    assert {str(r["month"]): r["revenue"] for r in ingest.monthly_revenue(spark, store).collect()} == {
        "2024-01-01": 40.0, "2024-02-01": 10.0}
