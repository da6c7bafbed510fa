"""Registered queries of the notebook models and of scoring by stored models, with SQL where the rows are not fitted."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillsight.operators import notebook_models as nb
from tillsight.operators import reports as _rep
from tillsight.operators import series, supervised
from tillsight.plans import catalog as c
from tillsight.plans.oracle import _STRICT, _dbl, _rx
from tillsight.session import ensure_checkpoint_dir, materialize

COHORT = {"frequency": (5, 12), "recency_days": (0, 365)}


def _stored(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillsight-{kind}-{uuid.uuid4().hex}"


def q_notebook_forecast_table(spark, sf_dir):
    """The fifteen features and the ordered split."""
    return c._out(nb.notebook_forecast_table(c.strict_month_end(spark, sf_dir)))


def _forecasts(spark, sf_dir):
    # a memo, no hub: the months are few, and their models are fitted under the session's settings
    return c._memo(spark, sf_dir, "notebook_forecasts",
                   lambda: materialize(nb.notebook_forecasts(nb.notebook_forecast_table(c.strict_month_end(spark, sf_dir)))))


def q_notebook_forecasts(spark, sf_dir):
    """Held-out months by model."""
    return c._out(_forecasts(spark, sf_dir))


def q_notebook_forecast_report(spark, sf_dir):
    """The models' errors and their ranking."""
    return c._out(series.rank_models(nb.forecast_report(_forecasts(spark, sf_dir))))


def q_notebook_naive(spark, sf_dir):
    """T9 on T10's split: the part of the report that nothing is fitted for."""
    return c._out(_forecasts(spark, sf_dir).where(F.col("model") == "Naive").select("InvoiceDate", "Sales", "prediction"))


def q_five_personas(spark, sf_dir):
    """M8: five clusters, named by their means."""
    named = nb.notebook_personas(nb.five_clusters(c.customers(spark, sf_dir).drop("persona")))
    return named.select("customer_id", "cluster", "persona")


def q_typical_customer_scores(spark, sf_dir):
    """the typical customer of a cohort, scored by models saved and loaded again."""
    bundle = supervised.load_bundle(supervised.save_bundle(c._bundle(spark, sf_dir), _stored(spark, "models")))
    return c._out(supervised.score_typical_customer(_rep.profile_cohort(c.customers(spark, sf_dir), COHORT), bundle))


def q_stored_churn_scores(spark, sf_dir):
    """All customers scored by the best churn model, saved once and loaded again."""
    result = c._churn(spark, sf_dir)
    name = result.best_model_name()
    model = supervised.load_churn(supervised.save_churn(result, _stored(spark, "churn")), [name])[name]
    return supervised.score_churn(model, c.customers(spark, sf_dir)).select(
        "customer_id", "churn_probability", "churn_prediction", "churn_risk_band")


QUERIES = {
    "notebook_forecast_table": q_notebook_forecast_table, "notebook_forecasts": q_notebook_forecasts,
    "notebook_forecast_report": q_notebook_forecast_report, "notebook_naive_forecast": q_notebook_naive,
    "five_personas": q_five_personas, "typical_customer_scores": q_typical_customer_scores,
    "stored_churn_scores": q_stored_churn_scores,
}


def _table_sql() -> str:
    cols = ['"InvoiceDate"', '"Sales"', '("Sales" - lag("Sales", 1) OVER w) / nullif(lag("Sales", 1) OVER w, 0) * 100 AS "GrowthRate"']
    cols += [f'lag("Sales", {k}) OVER w AS "Lag_{k}"' for k in (1, 2, 3, 6)]
    for k in (3, 6):
        frame = f"(w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        cols += [f'{f}("Sales") OVER {frame} AS "{name}_{k}"' for f, name in (("avg", "RollingMean"), ("stddev_samp", "RollingStd"))]
    calendar = [f'CAST({f}("InvoiceDate") AS INTEGER) AS "{n}"' for n, f in
                (("Year", "year"), ("Quarter", "quarter"), ("Month", "month"), ("Day", "day"))]
    calendar += ['CAST(isodow("InvoiceDate") - 1 AS INTEGER) AS "Weekday"', 'CAST(isodow("InvoiceDate") >= 6 AS INTEGER) AS "Weekend"']
    return "WITH " + _STRICT + f""",
roll AS (SELECT {', '.join(cols)} FROM monthend WINDOW w AS (ORDER BY "InvoiceDate")),
full_rows AS (SELECT *, {', '.join(calendar)}, row_number() OVER (ORDER BY "InvoiceDate") AS position, count(*) OVER () AS n
         FROM roll WHERE "Lag_6" IS NOT NULL AND "GrowthRate" IS NOT NULL),
tab AS (SELECT *, position > floor(n * 0.8) AS held_out FROM full_rows)
"""


def _features_out() -> str:
    exact = {"Year", "Month", "Quarter", "Day", "Weekday", "Weekend"}
    out = []
    for name in ["Sales", *nb.NOTEBOOK_FEATURES]:
        quoted = f'"{name}"'
        out.append(quoted if name in exact else f"{_rx(quoted)} AS {quoted}")
    return ", ".join(out)


_SALES = '"Sales"'
_RAW = {
    "notebook_forecast_table": _table_sql() + f'SELECT "InvoiceDate", {_features_out()}, position, held_out FROM tab',
    "notebook_naive_forecast": _table_sql() + f"""
SELECT "InvoiceDate", {_rx(_SALES)} AS "Sales", (SELECT {_rx(f'max_by({_SALES}, position)')} FROM tab WHERE NOT held_out) AS prediction
FROM tab WHERE held_out""",
}
ORACLE = {k: _dbl(v) for k, v in _RAW.items()}
