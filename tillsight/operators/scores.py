"""RFM quintiles, value / risk / health scores, personas and tiers.

All thresholds are exact linear quantiles computed once per frame (one
distributed aggregate, see ``plans.ranking.exact_quantiles``) and read back as
a scalar subquery: no join, nothing collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.exprs import clip
from tillsight.plans.ranking import exact_quantiles, ranks_by
from tillsight.session import materialize

# ---- fixed values that must equal the reference ----
CLV_MARGIN = 0.35
CHURN_WEIGHTS = (0.62, 0.25, 0.13)           # recency, (1 - frequency), returns
HEALTH_WEIGHTS = (0.35, 0.25, 0.25, 0.15)    # r, f, m, (1 - return rate)
TIER_WEIGHTS = (0.45, 0.30, 0.25)            # m, f, r
TIER_BINS = [(-1, 40, "Bronze"), (40, 60, "Silver"), (60, 80, "Gold"), (80, 101, "Platinum")]
PERSONAS = ["Premium customers", "Loyal customers", "At-risk customers", "New customers",
            "Big spenders", "Bargain shoppers"]
DEFAULT_PERSONA = "Regular customers"
RFM_SEGMENT_CUTS = [(13, "Champions"), (10, "Loyal"), (7, "Potential"), (5, "At Risk")]
DEFAULT_RFM_SEGMENT = "Needs Attention"
# ---- end of fixed values ----


class _Thresholds(dict):
    """Quantile values as literal columns: ``q["m80"]`` is a ``Column``."""

    def __getitem__(self, key):
        v = dict.__getitem__(self, key)
        return F.lit(v).cast("double")

    def value(self, key):
        return dict.__getitem__(self, key)


def quantile_values(df: DataFrame, specs: dict) -> _Thresholds:
    """Exact linear quantiles of ``df`` (one distributed job, one row back).

    The result has a fixed size (one value per spec), so reading it on the
    driver is safe at any data size; using literals keeps the downstream plans
    free of repeated subqueries.
    """
    row = exact_quantiles(df, specs).first()
    return _Thresholds({k: (None if row is None else row[k]) for k in specs})


def quintile_scores(df: DataFrame, specs: dict, tie_col: str = "customer_id") -> DataFrame:
    """``specs``: output column -> (value column, ascending_good).

    Rank = ``rank(method="first")`` (ties by ``tie_col``); pct = rank / n;
    score = clip(ceil(5 * pct), 1, 5), or for the inverse score
    ceil(5 * (1 - pct + 1/n)) with the double operations in that order.
    All ranks come from one range shuffle (``ranks_by``).
    """
    ranks = ranks_by(df, tie_col, {name: col for name, (col, _) in specs.items()})
    cols = [tie_col]
    for name, (_, ascending_good) in specs.items():
        n = F.col(f"{name}_n").cast("double")
        pct = F.col(name).cast("double") / n
        x = pct if ascending_good else ((F.lit(1.0) - pct) + (F.lit(1.0) / n))
        cols.append(F.least(F.greatest(F.ceil(x * 5), F.lit(1)), F.lit(5)).cast("int").alias(name))
    return df.join(ranks.select(*cols), tie_col, "inner")


def rfm_analysis(features: DataFrame) -> DataFrame:
    out = quintile_scores(
        features.select("customer_id", "recency_days", "frequency", "monetary_value"),
        {"r_score": ("recency_days", False), "f_score": ("frequency", True), "m_score": ("monetary_value", True)})
    return out.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


SCORE_QUANTILES = {"rec90": ("recency_days", 0.9), "freq90": ("frequency", 0.9), "ret90": ("return_rate", 0.9)}
PERSONA_QUANTILES = {
    "m80": ("monetary_value", 0.8), "f80": ("frequency", 0.8), "aov80": ("avg_order_value", 0.8),
    "r75": ("recency_days", 0.75), "t25": ("tenure_days", 0.25), "d75": ("product_diversity", 0.75),
    "r40": ("recency_days", 0.4)}


def add_customer_scores(features: DataFrame, thresholds=None) -> DataFrame:
    """RFM quintiles, CLV, churn risk and health score."""
    scored = quintile_scores(
        features,
        {"r_score": ("recency_days", False), "f_score": ("frequency", True), "m_score": ("monetary_value", True)})
    scored = scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
    q = thresholds if thresholds is not None else quantile_values(features, SCORE_QUANTILES)
    months = clip(F.lit(18) - F.col("recency_days") / 12 + F.col("purchase_rate"), 1, 36)
    clv = F.greatest(F.col("avg_order_value") * F.col("purchase_rate") * months * CLV_MARGIN, F.lit(0.0))
    rn = F.col("recency_days") / F.greatest(F.lit(1.0), q["rec90"])
    fn = F.col("frequency") / F.greatest(F.lit(1.0), q["freq90"])
    tn = F.col("return_rate") / F.greatest(F.lit(0.01), q["ret90"])
    wr, wf, wt = CHURN_WEIGHTS
    churn = 100 * (wr * clip(rn, 0, 1) + wf * (1 - clip(fn, 0, 1)) + wt * clip(tn, 0, 1))
    hr, hf, hm, hret = HEALTH_WEIGHTS
    health = 100 * (hr * F.col("r_score") / 5 + hf * F.col("f_score") / 5 + hm * F.col("m_score") / 5
                    + hret * (1 - clip(F.col("return_rate"), 0, 1)))
    return scored.withColumns({
        "clv_estimate": clv,
        "churn_risk": F.round(churn, 1),
        "health_score": F.round(clip(health, 0, 100), 1),
    })


def assign_personas(customers: DataFrame, thresholds=None) -> DataFrame:
    """First matching of six ordered rules, else "Regular customers"."""
    q = thresholds if thresholds is not None else quantile_values(customers, PERSONA_QUANTILES)
    m, f, aov = F.col("monetary_value"), F.col("frequency"), F.col("avg_order_value")
    r, t, d = F.col("recency_days"), F.col("tenure_days"), F.col("product_diversity")
    conds = [
        (m >= q["m80"]) & (f >= q["f80"]),
        (f >= q["f80"]) & (r <= q["r40"]),
        (F.col("churn_risk") >= 65) | (r >= q["r75"]),
        (t <= q["t25"]) & (f <= 2),
        aov >= q["aov80"],
        (d >= q["d75"]) & (aov < q["aov80"]),
    ]
    expr = F.lit(DEFAULT_PERSONA)
    for cond, label in reversed(list(zip(conds, PERSONAS))):
        expr = F.when(F.coalesce(cond, F.lit(False)), F.lit(label)).otherwise(expr)
    return customers.withColumn("persona", expr)


def assign_customer_tiers(customers: DataFrame) -> DataFrame:
    wm, wf, wr = TIER_WEIGHTS
    score = (wm * F.col("m_score") + wf * F.col("f_score") + wr * F.col("r_score")) * 20
    tier = F.lit(None).cast("string")
    for lo, hi, label in reversed(TIER_BINS):
        tier = F.when((score > lo) & (score <= hi), F.lit(label)).otherwise(tier)
    return customers.withColumns({
        "customer_intelligence_score": F.round(score, 1),
        "customer_tier": F.coalesce(tier, F.lit("nan")),
    })


def rfm_segments(customers: DataFrame) -> DataFrame:
    """``qcut`` of first-ranks into five equal-frequency buckets.

    With rank r in 1..n, pandas' bucket edges are 1 + (n-1) k/5 (right-closed,
    lowest edge included), i.e. bucket = max(1, ceil(5 (r-1) / (n-1))).
    Recency is inverted (bucket 1 -> score 5).
    """
    base = customers.select("customer_id", "recency_days", "frequency", "monetary_value")
    ranks = ranks_by(base, "customer_id", {"r_score": "recency_days", "f_score": "frequency",
                                           "m_score": "monetary_value"})
    cols = ["customer_id"]
    for name, invert in (("r_score", True), ("f_score", False), ("m_score", False)):
        n = F.col(f"{name}_n")
        bucket = F.when(n == 1, F.lit(1)).otherwise(F.greatest(
            F.lit(1), F.ceil(F.lit(5.0) * (F.col(name) - 1).cast("double") / (n - 1).cast("double"))))
        bucket = F.least(bucket, F.lit(5))
        cols.append(((F.lit(6) - bucket) if invert else bucket).cast("int").alias(name))
    out = base.join(ranks.select(*cols), "customer_id")
    out = out.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
    seg = F.lit(DEFAULT_RFM_SEGMENT)
    for cut, label in reversed(RFM_SEGMENT_CUTS):
        seg = F.when(F.col("rfm_score") >= cut, F.lit(label)).otherwise(seg)
    return out.withColumn("rfm_segment", seg)


def customer_table(features: DataFrame) -> DataFrame:
    """Scores, personas and tiers in the reference's order.  All ten thresholds
    are quantiles of feature columns, so they come from one quantile job."""
    q = quantile_values(features, {**SCORE_QUANTILES, **PERSONA_QUANTILES})
    return assign_customer_tiers(assign_personas(add_customer_scores(features, q), q))


# ---- fixed values that must equal the reference (notebook scoring) ----
NOTEBOOK_SCORE_WEIGHTS = [("TotalSpent", 0.30), ("Monetary", 0.25), ("Frequency", 0.20),
                          ("TotalTransactions", 0.15), ("TotalQuantity", 0.05)]
NOTEBOOK_RECENCY_WEIGHT = 0.05
NOTEBOOK_TIER_CUTS = [(0.90, "Platinum"), (0.70, "Gold"), (0.40, "Silver")]
# ---- end of fixed values ----


def notebook_customer_table(clean: DataFrame, customer: str = "Customer ID", invoice: str = "Invoice",
                            qty: str = "Quantity", sales: str = "Sales", date: str = "InvoiceDate") -> DataFrame:
    """The notebooks' customer table on strictly cleaned lines: transactions,
    quantity, spend, last purchase; recency in whole days from the latest
    purchase (no +1 day); min-max scaled weighted score rescaled to 0..1;
    tiers at the score's 40/70/90% quantiles."""
    from tillsight.functions.exprs import ntz_literal, whole_days
    base = clean.groupBy(F.col(customer).alias("CustomerID")).agg(
        F.count_distinct(invoice).alias("TotalTransactions"), F.sum(qty).alias("TotalQuantity"),
        F.sum(sales).alias("TotalSpent"), F.max(date).alias("LastPurchaseDate"))
    base = materialize(base)   # read for every figure below: the lines are joined and cleaned once
    ref = base.agg(F.max("LastPurchaseDate")).first()[0]
    base = base.withColumns({
        "Recency": whole_days(ntz_literal(ref), F.col("LastPurchaseDate")),
        "Frequency": F.col("TotalTransactions"), "Monetary": F.col("TotalSpent")})
    feats = ["TotalSpent", "Monetary", "Frequency", "TotalTransactions", "TotalQuantity", "Recency"]
    mm = base.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in feats],
                  *[F.max(c).cast("double").alias(f"hi_{c}") for c in feats]).first()

    def scaled(c):
        lo, hi = mm[f"lo_{c}"], mm[f"hi_{c}"]
        return (F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) if hi != lo else F.lit(0.0)

    raw = None
    for c, wgt in NOTEBOOK_SCORE_WEIGHTS:
        term = scaled(c) * F.lit(wgt)
        raw = term if raw is None else raw + term
    raw = raw + (F.lit(1.0) - scaled("Recency")) * F.lit(NOTEBOOK_RECENCY_WEIGHT)
    s = base.withColumn("_raw", raw)
    r = s.agg(F.min("_raw").alias("a"), F.max("_raw").alias("b")).first()
    span = (r["b"] - r["a"]) if r["a"] is not None else 0.0
    s = s.withColumn("CustomerScore", (F.col("_raw") - F.lit(r["a"])) / F.lit(span) if span else F.lit(0.0))
    q = exact_quantiles(s, {f"c{i}": ("CustomerScore", p) for i, (p, _) in enumerate(NOTEBOOK_TIER_CUTS)}).first()
    tier = F.lit("Bronze")
    for i in reversed(range(len(NOTEBOOK_TIER_CUTS))):
        tier = F.when(F.col("CustomerScore") >= F.lit(q[f"c{i}"]), F.lit(NOTEBOOK_TIER_CUTS[i][1])).otherwise(tier)
    return s.drop("_raw").withColumn("Tier", tier)
