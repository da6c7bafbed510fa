"""Registered queries of the churn study, explanations, samples and report views, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.operators import campaigns as _camp
from tillsight.operators import cleaning, explain, scores, series, study, supervised
from tillsight.operators import reports as _rep
from tillsight.plans import catalog as c
from tillsight.plans.oracle import FEATURES, SCORES, TX, _campaign_sql, _dbl, _r, _rx, _STRICT, ORACLE as _ORACLE
from tillsight.sources import tables

NOISELESS = 0.0


def _notebook_customers(spark, sf_dir):
    clean = cleaning.strict_clean(tables.strict_raw_transactions(spark, sf_dir))
    return c._hub(spark, sf_dir, "notebook_customers", lambda: scores.notebook_customer_table(clean))


def q_notebook_churn_label(spark, sf_dir):
    """The label's formula; the study adds the keyed noise."""
    return c._out(study.notebook_churn_label(_notebook_customers(spark, sf_dir), noise=NOISELESS)
                  .select("CustomerID", "ChurnScore", "Churn"))


def q_notebook_churn_split(spark, sf_dir):
    labelled = study.held_out(study.notebook_churn_label(_notebook_customers(spark, sf_dir), noise=NOISELESS))
    return labelled.groupBy("Churn", "held_out").agg(F.count(F.lit(1)).alias("customers"))


def q_notebook_churn_study(spark, sf_dir):
    labelled = study.notebook_churn_label(_notebook_customers(spark, sf_dir))
    return c._out(study.study_table(study.churn_study_predictions(labelled)))


def q_predictive_labels(spark, sf_dir):
    return c._out(supervised.predictive_labels(c.customers(spark, sf_dir)).select(
        "customer_id", "purchase_target", "next_days", "future_spend"))


def q_churn_labels(spark, sf_dir):
    return supervised.churn_target(c.customers(spark, sf_dir))[0].select("customer_id", F.col("label").alias("churn_label"))


def q_churn_split_sizes(spark, sf_dir):
    labelled, _ = supervised.churn_target(c.customers(spark, sf_dir))
    train, test = supervised.stratified_split(labelled.select("customer_id", "label"), "label")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("label", "part").agg(F.count(F.lit(1)).alias("customers"))


def q_churn_tree_explanations(spark, sf_dir):
    """Every customer's seven contributions under each of the three tree models."""
    models = c._churn(spark, sf_dir).models
    data = supervised.assemble(c.customers(spark, sf_dir), supervised.CHURN_FEATURES)
    parts = [explain.tree_explanations(models[m], data, supervised.CHURN_FEATURES).withColumn("model", F.lit(m))
             for m in ("Decision Tree", "Random Forest", "Gradient Boosted Trees")]
    return reduce(DataFrame.unionByName, parts)


def q_describe_quartiles(spark, sf_dir):
    return c._out(_rep.describe_with_quartiles(c.customer_features(spark, sf_dir), c.CORR_COLUMNS))


def q_customer_sample(spark, sf_dir):
    return _rep.hash_sample(c.customer_features(spark, sf_dir), 10).select("customer_id", "recency_days", "frequency")


def q_priority_report(spark, sf_dir):
    return c._out(_rep.priority_report(c.customers(spark, sf_dir)))


def q_scoring_report(spark, sf_dir):
    return c._out(_rep.scoring_report(c.customers(spark, sf_dir)))


PERCENTS = ["churn_risk", "return_rate", "purchase_rate"]


def q_percent_view(spark, sf_dir):
    return _rep.percent_view(c.customers(spark, sf_dir).select("customer_id", *PERCENTS), PERCENTS)


def q_executive_report(spark, sf_dir):
    customers = c.customers(spark, sf_dir)
    return c._out(_rep.executive_report(c.transactions(spark, sf_dir), customers, _camp.campaign_recommendations(customers)))


def q_customer_action(spark, sf_dir):
    return _rep.campaign_of_customer(_camp.campaign_recommendations(c.customers(spark, sf_dir)), "1234")


def q_rolling_calendar(spark, sf_dir):
    return c._out(series.rolling_calendar(c.strict_month_end(spark, sf_dir)))


def q_high_value_low_risk(spark, sf_dir):
    """Customers per risk band of their assessed risk."""
    banded = _rep.risk_bands(c.customers(spark, sf_dir).withColumn("p", F.col("churn_risk") / 100), "p")
    return banded.groupBy("risk_band").agg(F.count(F.lit(1)).alias("customers"))


QUERIES = {
    "notebook_churn_label": q_notebook_churn_label,
    "notebook_churn_split": q_notebook_churn_split,
    "notebook_churn_study": q_notebook_churn_study,
    "predictive_labels": q_predictive_labels,
    "churn_labels": q_churn_labels,
    "churn_split_sizes": q_churn_split_sizes,
    "churn_tree_explanations": q_churn_tree_explanations,
    "describe_quartiles": q_describe_quartiles,
    "customer_sample": q_customer_sample,
    "priority_report": q_priority_report,
    "scoring_report": q_scoring_report,
    "percent_view": q_percent_view,
    "executive_report": q_executive_report,
    "customer_action": q_customer_action,
    "rolling_calendar": q_rolling_calendar,
    "risk_band_counts": q_high_value_low_risk,
}

_TIERS = _ORACLE["notebook_customer_tiers"]
_NOTEBOOK = _TIERS[:_TIERS.rindex("SELECT \"CustomerID\"")].rstrip()
_CHURN = _NOTEBOOK + """,
nm AS (SELECT max(rec) AS a, max(tt) AS b, max(ts) AS c, max(score) AS d FROM s2),
cs AS (SELECT "CustomerID", 0.0 + 0.35 * (CAST(rec AS DOUBLE) / a) + 0.25 * (1.0 - CAST(tt AS DOUBLE) / b)
              + 0.20 * (1.0 - ts / c) + 0.20 * (1.0 - score / d) AS s FROM s2, nm),
cn AS (SELECT "CustomerID", (s - (SELECT min(s) FROM cs)) / ((SELECT max(s) FROM cs) - (SELECT min(s) FROM cs)) AS x FROM cs),
lab AS (SELECT "CustomerID", x AS "ChurnScore", CAST(x > (SELECT quantile_cont(x, 0.6) FROM cn) AS INTEGER) AS "Churn" FROM cn)
"""
_LABELS = SCORES + """,
med AS (SELECT quantile_cont(recency_days, 0.5) AS rm, quantile_cont(frequency, 0.5) AS fm, quantile_cont(recency_days, 0.75) AS r75 FROM customers)
"""
_CHURNED = "CAST(coalesce(churn_risk, 0) >= 65 OR coalesce(recency_days, 0) >= r75 AS INTEGER)"


def _frame(k: int) -> str:
    return f"(w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _rolling_sql() -> str:
    cols = ['"InvoiceDate"', f'{_rx(chr(34) + "Sales" + chr(34))} AS "Sales"']
    inner = ['"InvoiceDate"', '"Sales"', '("Sales" - lag("Sales", 1) OVER w) / lag("Sales", 1) OVER w * 100 AS "GrowthRate"']
    inner += [f'lag("Sales", {k}) OVER w AS "Lag_{k}"' for k in (1, 2, 3, 6, 12)]
    for k in (3, 6, 12):
        for f, name in (("avg", "RollingMean"), ("stddev_samp", "RollingStd")):
            inner.append(f'CASE WHEN count("Sales") OVER {_frame(k)} = {k} THEN {f}("Sales") OVER {_frame(k)} END AS "{name}_{k}"')
    rounded = ["GrowthRate", *[f"Lag_{k}" for k in (1, 2, 3, 6, 12)],
               *[f"{n}_{k}" for k in (3, 6, 12) for n in ("RollingMean", "RollingStd")]]
    quoted = {n: f'"{n}"' for n in rounded}
    cols += [f'{_rx(q)} AS {q}' for q in quoted.values()]
    parts = {"Year": "year", "Quarter": "quarter", "Month": "month", "Day": "day"}
    cols += [f'CAST({f}("InvoiceDate") AS INTEGER) AS "{n}"' for n, f in parts.items()]
    cols += ['CAST(isodow("InvoiceDate") - 1 AS INTEGER) AS "Weekday"', 'CAST(isodow("InvoiceDate") >= 6 AS INTEGER) AS "Weekend"']
    return "WITH " + _STRICT + f", gr AS (SELECT {', '.join(inner)} FROM monthend WINDOW w AS (ORDER BY \"InvoiceDate\")) " \
        f"SELECT {', '.join(cols)} FROM gr"


def _percent(col: str) -> str:
    scaled = f"CAST({col} AS DOUBLE) * (SELECT CASE WHEN max(abs({col})) <= 1 THEN 100.0 ELSE 1.0 END FROM customers)"
    return f"coalesce(printf('%.1f%%', {_rx(scaled, 1)}), '—') AS {col}"


_RAW = {
    "notebook_churn_label": _CHURN + f'SELECT "CustomerID", {_rx(chr(34) + "ChurnScore" + chr(34))} AS "ChurnScore", "Churn" FROM lab',
    "notebook_churn_split": _CHURN + """
SELECT "Churn", CAST('0x' || substr(md5(CAST("CustomerID" AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 >= 0.8 AS held_out,
       count(*) AS customers FROM lab GROUP BY 1, 2""",
    "predictive_labels": "WITH " + _LABELS + f"""
SELECT customer_id, CAST(recency_days <= rm AND frequency >= fm AS INTEGER) AS purchase_target,
       {_rx('greatest(1.0, recency_days * 0.65 + 30.0 / (purchase_rate + 0.2))')} AS next_days,
       {_rx('avg_order_value * greatest(1.0, purchase_rate) * 3')} AS future_spend FROM customers, med""",
    "churn_labels": "WITH " + _LABELS + f" SELECT customer_id, {_CHURNED} AS churn_label FROM customers, med",
    "churn_split_sizes": "WITH " + _LABELS + f""",
l AS (SELECT {_CHURNED} AS label, count(*) AS n FROM customers, med GROUP BY 1)
SELECT label, 'train' AS part, CAST(ceil(n * 0.75) AS BIGINT) AS customers FROM l
UNION ALL SELECT label, 'test', CAST(n - ceil(n * 0.75) AS BIGINT) FROM l""",
    "describe_quartiles": "WITH " + FEATURES + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{x}' AS \"column\", count({x}) AS count, {_rx(f'avg(CAST({x} AS DOUBLE))')} AS mean, "
        f"{_rx(f'stddev_samp(CAST({x} AS DOUBLE))')} AS std, {_rx(f'min(CAST({x} AS DOUBLE))')} AS min, "
        f"{_rx(f'max(CAST({x} AS DOUBLE))')} AS max, " + ", ".join(
            f"{_rx(f'quantile_cont(CAST({x} AS DOUBLE), 0.{q})')} AS q{q}" for q in ("25", "50", "75")) + " FROM features"
        for x in c.CORR_COLUMNS),
    "customer_sample": "WITH " + FEATURES + """
SELECT customer_id, recency_days, frequency FROM features ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id LIMIT 10""",
    "priority_report": "WITH " + SCORES + f"""
SELECT customer_id, persona, customer_tier, {_r('health_score')}, {_r('churn_risk')}, {_r('clv_estimate')},
       row_number() OVER (ORDER BY {_rx('churn_risk')} DESC, {_rx('clv_estimate')} DESC, customer_id) AS place FROM customers""",
    "scoring_report": "WITH " + SCORES + f"""
SELECT customer_id, {_r('health_score')}, {_r('churn_risk')}, customer_tier, persona FROM customers
ORDER BY {_rx('health_score')}, customer_id LIMIT 100""",
    "percent_view": "WITH " + SCORES + " SELECT customer_id, " + ", ".join(_percent(x) for x in PERCENTS) + " FROM customers",
    "executive_report": "WITH " + _campaign_sql() + f"""
SELECT (SELECT count(*) FROM campaigns WHERE priority = 'Critical') AS critical_actions,
       (SELECT {_rx('sum(revenue) / greatest(count(DISTINCT invoice_id), 1)')} FROM tx) AS average_order,
       (SELECT customer_tier FROM customers GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_tier,
       (SELECT persona FROM customers GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_persona,
       (SELECT country FROM tx GROUP BY 1 ORDER BY round(sum(revenue), 6) DESC, 1 LIMIT 1) AS top_country""",
    "customer_action": "WITH " + _campaign_sql() + """
SELECT customer_id, recommended_action, suggested_offer, priority,
       CASE WHEN priority IN ('Critical', 'High') THEN 'High' ELSE 'Normal' END AS action_priority
FROM campaigns WHERE customer_id = '1234'""",
    "rolling_calendar": _rolling_sql(),
    "risk_band_counts": "WITH " + SCORES + """
SELECT CASE WHEN churn_risk / 100 >= 0.65 THEN 'High' WHEN churn_risk / 100 >= 0.35 THEN 'Medium' ELSE 'Low' END AS risk_band,
       count(*) AS customers FROM customers GROUP BY 1""",
}
ORACLE = {k: _dbl(v) for k, v in _RAW.items()}
