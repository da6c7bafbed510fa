"""Campaign treatment per customer: 13 ordered rules, first match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.exprs import clip
from tillsight.operators.scores import quantile_values

# ---- fixed values that must equal the reference (rule texts, in rule order) ----
# (strategy, action, offer, channel, incentive level, reason)
RULES = [
    ("VIP rescue",
     "Personal outreach and premium retention treatment",
     "VIP outreach + exclusive benefit; discount only if needed",
     "Personal outreach", "High-touch",
     "High predicted value and severe churn risk make this customer worth protecting with a high-touch intervention."),
    ("High-value retention",
     "Protect the account with a personalized retention intervention",
     "Personalized incentive up to 15%",
     "Email + personal outreach", "Medium-high",
     "The customer has substantial future value and elevated churn risk; protect value before relying on broad discounts."),
    ("Premium protection",
     "Protect premium relationship before offering a discount",
     "Early access + priority support",
     "VIP email / account manager", "Non-discount",
     "Premium status plus elevated risk calls for relationship protection rather than an automatic price cut."),
    ("VIP relationship retention",
     "Offer VIP access, service benefits, and personalized recommendations",
     "VIP access + exclusive service benefit",
     "VIP email / account manager", "Non-discount",
     "Premium customers showing risk should receive differentiated service and access benefits."),
    ("Big-spender protection",
     "Use high-value product bundles and personal recommendations",
     "Premium bundle / complementary product offer",
     "Email + personalized product recommendation", "Medium",
     "A valuable spender is slipping; use relevant products and bundles before a blanket discount."),
    ("Loyalty recovery",
     "Restore purchase cadence with loyalty incentives",
     "Double loyalty points or milestone reward",
     "Loyalty app / email", "Low",
     "Previously loyal behavior is weakening, so restore purchase cadence with a loyalty treatment."),
    ("New-customer activation",
     "Convert the first purchase into a repeat purchase",
     "Second-order offer + free shipping",
     "Email / SMS", "Medium",
     "Early-stage customers need a second successful purchase more than a generic win-back campaign."),
    ("Bargain recovery",
     "Use price-sensitive bundles or targeted coupons",
     "Bundle deal or 5–10% targeted coupon",
     "Email / SMS", "Medium",
     "Behavior suggests price sensitivity; targeted bundles are more appropriate than a broad discount."),
    ("Deep win-back",
     "Run a stronger win-back treatment for long-inactive customers",
     "15–20% win-back or strong bundle incentive",
     "Email + SMS", "High",
     "Long inactivity plus severe risk justifies a stronger reactivation treatment."),
    ("Gentle reactivation",
     "Send a low-cost reminder or reactivation treatment",
     "Free shipping or 5% reactivation incentive",
     "Email / push", "Low",
     "The customer is showing early disengagement, so use a lower-cost intervention first."),
    ("Targeted re-engagement",
     "Run a targeted re-engagement campaign",
     "Personalized product + limited-time incentive",
     "Email / push", "Medium",
     "Elevated risk is present, but the customer does not qualify for a more specialized treatment."),
    ("High-value growth",
     "Grow future value through cross-sell or premium recommendations",
     "Cross-sell / premium upgrade; no automatic discount",
     "Personalized email / onsite", "Non-discount",
     "Healthy/high-value customers should be grown rather than unnecessarily discounted."),
    ("Always-on engagement",
     "Maintain engagement without a costly incentive",
     "Personalized recommendation / loyalty content",
     "Email / onsite", "Non-discount",
     "Healthy customers are better served through engagement and recommendations than retention discounts."),
]
DEFAULT_RULE = ("Monitor / no incentive",
                "Monitor behavior and revisit when risk changes",
                "No discount; personalized content only",
                "Email / onsite", "None",
                "Current health and risk do not justify an incentive-led campaign.")
TEXT_COLUMNS = ["campaign_strategy", "recommended_action", "suggested_offer", "recommended_channel",
                "incentive_level", "campaign_reason"]
OPPORTUNITY_WEIGHTS = (0.45, 0.40, 0.15)   # value, risk, deterioration
# ---- end of fixed values ----

OUTPUT_COLUMNS = [
    "customer_id", "persona", "customer_tier", "priority", "campaign_strategy",
    "recommended_action", "suggested_offer", "recommended_channel", "incentive_level",
    "campaign_reason", "campaign_opportunity_score", "churn_risk", "health_score",
    "clv_estimate", "predicted_90d_spend", "recency_days", "frequency",
]


def campaign_recommendations(customers: DataFrame) -> DataFrame:
    """Rule number by a ``when`` chain; the six texts are looked up in literal
    arrays by that number (no join).  Thresholds: q80 of CLV, predicted
    spend and frequency, median and q85 of recency, q90 of CLV."""
    has_spend = "predicted_90d_spend" in customers.columns
    has_tier = "customer_tier" in customers.columns
    base = customers.withColumns({
        "_churn": F.coalesce(F.col("churn_risk"), F.lit(0.0)),
        "_health": F.coalesce(F.col("health_score"), F.lit(50.0)),
        "_clv": F.coalesce(F.col("clv_estimate"), F.lit(0.0)),
        "_spend": F.coalesce(F.col("predicted_90d_spend"), F.lit(0.0)) if has_spend else F.lit(0.0),
        "_rec": F.coalesce(F.col("recency_days"), F.lit(0)),
        "_freq": F.coalesce(F.col("frequency"), F.lit(0)),
        "_persona": F.coalesce(F.col("persona"), F.lit("Regular customers")),
        "_tier": F.coalesce(F.col("customer_tier"), F.lit("Standard")) if has_tier else F.lit("Standard"),
    })
    q = quantile_values(base, {
        "clv80": ("_clv", 0.8), "spend80": ("_spend", 0.8), "freq80": ("_freq", 0.8),
        "rec50": ("_rec", 0.5), "rec85": ("recency_days", 0.85), "clv90": ("_clv", 0.9)})
    churn, health, clv, spend = F.col("_churn"), F.col("_health"), F.col("_clv"), F.col("_spend")
    rec, freq, persona, tier = F.col("_rec"), F.col("_freq"), F.col("_persona"), F.col("_tier")

    high_value = (clv >= q["clv80"]) | (spend >= q["spend80"])
    severe = churn >= 80
    high = churn >= 65
    moderate = (churn >= 45) & (churn <= 64.999)
    inactive = rec > q["rec50"]
    very_inactive = F.col("recency_days") >= q["rec85"]
    conds = [
        high_value & severe,
        high_value & high & (health < 50),
        (tier == "Platinum") & high,
        (persona == "Premium customers") & high,
        (persona == "Big spenders") & high,
        (persona == "Loyal customers") & moderate,
        (persona == "New customers") & high,
        (persona == "Bargain shoppers") & high,
        severe & very_inactive,
        high & inactive,
        high,
        high_value & ~high,
        (persona == "Regular customers") & (health >= 65),
    ]
    rule = F.lit(len(RULES) + 1)
    for i in range(len(conds), 0, -1):
        rule = F.when(F.coalesce(conds[i - 1], F.lit(False)), F.lit(i)).otherwise(rule)
    texts = {}
    for j, name in enumerate(TEXT_COLUMNS):
        arr = F.array(*[F.lit(r[j]) for r in RULES], F.lit(DEFAULT_RULE[j]))
        texts[name] = F.element_at(arr, F.col("_rule"))
    prio = (F.when(F.coalesce(high_value & severe, F.lit(False)), "Critical")
            .when(F.coalesce(severe, F.lit(False)), "Critical")
            .when(F.coalesce(high, F.lit(False)), "High")
            .when(F.coalesce(high_value, F.lit(False)), "High")
            .when(F.coalesce(health < 45, F.lit(False)), "High")
            .otherwise("Normal"))
    wv, wr, wd = OPPORTUNITY_WEIGHTS
    clv90 = q.value("clv90")
    value_c = clip(clv / F.lit(max(float(clv90 if clv90 is not None else 0.0), 1.0)), 0, 1)
    score = F.round(100 * (wv * value_c + wr * clip(churn / 100, 0, 1) + wd * clip(1 - health / 100, 0, 1)), 1)
    out = base.withColumn("_rule", rule).withColumns(texts).withColumns({
        "priority": prio, "campaign_opportunity_score": score})
    return out.select(*[c for c in OUTPUT_COLUMNS if c in out.columns])


def sort_campaigns(campaigns: DataFrame) -> DataFrame:
    """Report order: priority (alphabetical = urgency), opportunity desc, customer."""
    return campaigns.orderBy(F.col("priority"), F.col("campaign_opportunity_score").desc(), F.col("customer_id"))
