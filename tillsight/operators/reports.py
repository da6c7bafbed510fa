"""Portfolio reports, EDA tables, lookups and filters over the customer and
transaction tables.  Top-n outputs always carry a key tie-break so that the
rows returned are deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.exprs import combine_rows

from tillsight.functions.exprs import month_start, round_half_up
from tillsight.plans.ranking import exact_quantiles, global_rank


# ------------------------------------------------------------------ counts & KPIs
def value_counts(df: DataFrame, col: str, name: str = "customers") -> DataFrame:
    """Rows per value, largest first (value as tie-break)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(col))


def run_summary_kpis(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue, customers, orders, mean health, at-risk customers (one row)."""
    t = tx.agg(F.sum("revenue").alias("revenue"), F.count_distinct("invoice_id").alias("orders"))
    c = customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("health_score").alias("average_health"),
        F.count_if(F.col("persona") == "At-risk customers").alias("at_risk_customers"))
    return combine_rows(t, c).select(
        F.round("revenue", 2).alias("revenue"), "customers", "orders",
        F.round("average_health", 1).alias("average_health"), "at_risk_customers")


def customer_kpis(customers: DataFrame) -> DataFrame:
    """The analytics figures over the customer table in one aggregate."""
    return customers.agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("monetary_value").alias("total_revenue"),
        F.avg("monetary_value").alias("average_spent"),
        F.avg("frequency").alias("average_frequency"),
        F.avg("recency_days").alias("average_recency"),
        F.min("recency_days").cast("double").alias("minimum_recency"),
        F.max("recency_days").cast("double").alias("maximum_recency"),
    )


def median_recency(customers: DataFrame) -> DataFrame:
    return exact_quantiles(customers, {"median_recency": ("recency_days", 0.5)})


def revenue_by_group(customers: DataFrame, by: str = "customer_tier") -> DataFrame:
    """Customers, revenue, mean revenue, mean health and mean CLV per group."""
    return customers.groupBy(by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary_value").alias("revenue"),
        F.avg("monetary_value").alias("average_revenue"),
        F.avg("health_score").alias("average_health"),
        F.avg("clv_estimate").alias("average_clv"),
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise-complete), long form
    ``(feature_a, feature_b, correlation)``; one aggregate for all pairs."""
    aggs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}"))
    row = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            pairs.append((a, b))
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    long = row.selectExpr(f"stack({len(pairs)}, {stack}) AS (feature_a, feature_b, correlation)")
    mirrored = long.where("feature_a <> feature_b").select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    out = long.unionByName(mirrored)
    # all-null rows/columns are dropped (a constant column has no correlation)
    return out.where(F.col("correlation").isNotNull())


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), like numpy."""
    stats = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    lo, hi = stats["lo"], stats["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles per group and Tukey whiskers (most extreme values within 1.5 IQR)."""
    q = exact_quantiles(df, {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)}, by=[by])
    j = df.select(by, F.col(value).cast("double").alias("_v")).join(q, by)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("_v") >= F.col("q1") - 1.5 * iqr) & (F.col("_v") <= F.col("q3") + 1.5 * iqr)
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"))


def campaign_allocation(campaigns: DataFrame) -> DataFrame:
    """Customers per strategy and share of the plan (%), plus incentive counts."""
    counts = campaigns.groupBy("campaign_strategy").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("incentive_level") != "None").alias("with_incentive"))
    total = F.sum("customers").over(Window.partitionBy())
    return counts.withColumn("share", F.round(F.col("customers") / F.greatest(total, F.lit(1)) * 100, 1))


def market_report(country_performance: DataFrame) -> DataFrame:
    total = F.sum("revenue").over(Window.partitionBy())
    return country_performance.select(
        "country", F.round("revenue", 2).alias("revenue"), "orders",
        F.round(F.col("revenue") / total * 100, 1).alias("revenue_share"))


# ------------------------------------------------------------------ EDA
def month_spine(monthly: DataFrame, month_col: str = "month") -> DataFrame:
    """All months between the first and last month present (inclusive)."""
    bounds = monthly.agg(F.min(month_col).alias("a"), F.max(month_col).alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias(month_col))


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Purchase revenue per calendar month, empty months as 0."""
    m = (tx.where(F.col("revenue") > 0)
         .groupBy(month_start(F.col("invoice_date")).alias("month"))
         .agg(F.sum("revenue").alias("revenue")))
    return month_spine(m).join(m, "month", "left").select(
        "month", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def top_products(tx: DataFrame, n: int = 15) -> DataFrame:
    p = (tx.where(F.col("revenue") > 0).groupBy(F.col("product_name").alias("product"))
         .agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units")))
    return p.orderBy(F.col("revenue").desc(), F.col("product")).limit(n)


def country_performance(tx: DataFrame, n: int | None = 15) -> DataFrame:
    c = (tx.where(F.col("revenue") > 0).groupBy("country")
         .agg(F.sum("revenue").alias("revenue"), F.count_distinct("invoice_id").alias("orders")))
    c = c.orderBy(F.col("revenue").desc(), F.col("country"))
    return c.limit(n) if n else c


def top_countries_by_lines(tx: DataFrame, n: int = 10) -> DataFrame:
    return (tx.groupBy("country").agg(F.count(F.lit(1)).alias("lines"))
            .orderBy(F.col("lines").desc(), F.col("country")).limit(n))


def popular_products_by_quantity(tx: DataFrame) -> DataFrame:
    return (tx.where(F.col("quantity") > 0).groupBy("stock_code", "product_name")
            .agg(F.sum("quantity").alias("total_quantity")))


def month_of_year_totals(tx: DataFrame) -> DataFrame:
    """Mean monthly purchase revenue by calendar month name, and its month count."""
    m = monthly_revenue(tx)
    return m.groupBy(F.month("month").alias("month_number"), F.date_format("month", "MMMM").alias("month_name")) \
        .agg(F.avg("revenue").alias("average_revenue"), F.count(F.lit(1)).alias("months"))


def year_totals(tx: DataFrame) -> DataFrame:
    return (tx.where(F.col("revenue") > 0).groupBy(F.year("invoice_date").alias("year"))
            .agg(F.sum("revenue").alias("revenue"), F.count_distinct("invoice_id").alias("orders")))


# ------------------------------------------------------------------ lookups & filters
def customers_filtered(customers: DataFrame, persona: str | None = None, cluster=None,
                       limit: int | None = None) -> DataFrame:
    """All matching customers; the first ``limit`` by id only where it is given."""
    out = customers
    if persona:
        out = out.where(F.col("persona") == persona)
    if cluster is not None and "cluster" in customers.columns:
        out = out.where(F.col("cluster") == int(cluster))
    return out if limit is None else out.orderBy("customer_id").limit(int(limit))


def customer_by_id(customers: DataFrame, customer_id: str) -> DataFrame:
    """Searches all rows (not only the first 1000)."""
    return customers.where(F.col("customer_id") == str(customer_id))


def campaigns_by_priority(campaigns: DataFrame, priority: str) -> DataFrame:
    return campaigns.where(F.lower("priority") == priority.lower())


def filter_customers(customers: DataFrame, personas=None, tiers=None, min_health: float = 0.0) -> DataFrame:
    """Empty choices give an empty result, like the multiselect filters."""
    out = customers.where(F.col("health_score") >= F.lit(min_health))
    out = out.where(F.col("persona").isin(list(personas or [])))
    return out.where(F.col("customer_tier").isin(list(tiers or [])))


PROFILE_FEATURES = ["recency_days", "frequency", "monetary_value", "avg_order_value", "tenure_days",
                    "purchase_rate", "return_rate", "product_diversity"]


def profile_cohort(customers: DataFrame, ranges: dict) -> DataFrame:
    """Customers within inclusive ranges ``{col: (lo, hi)}``."""
    out = customers
    for c, (lo, hi) in ranges.items():
        out = out.where(F.col(c).between(lo, hi))
    return out


def typical_customer(cohort: DataFrame, features: list[str] = PROFILE_FEATURES) -> DataFrame:
    """Median of each feature, most common persona and tier, cohort size."""
    med = exact_quantiles(cohort, {f: (f, 0.5) for f in features})
    modes = cohort.agg(F.mode("persona", deterministic=True).alias("persona"),
                       F.mode("customer_tier", deterministic=True).alias("customer_tier"),
                       F.count(F.lit(1)).alias("customers"))
    return combine_rows(med, modes)


def top_n(df: DataFrame, col: str, n: int = 10, key: str = "customer_id", ascending: bool = False) -> DataFrame:
    o = F.col(col).asc() if ascending else F.col(col).desc()
    return df.orderBy(o, F.col(key)).limit(n)


def risk_bands(df: DataFrame, prob: str = "churn_probability", out: str = "risk_band") -> DataFrame:
    p = F.col(prob)
    return df.withColumn(out, F.when(p >= 0.65, "High").when(p >= 0.35, "Medium").otherwise("Low"))


def forecast_head(forecast: DataFrame, n: int = 1) -> DataFrame:
    """The next ``n`` forecast months (the first rows, not the last)."""
    return forecast.orderBy("month").limit(n)


def forecast_totals(forecast: DataFrame, col: str = "forecast_revenue") -> DataFrame:
    return forecast.agg(F.sum(col).alias("total"), F.avg(col).alias("average"),
                        F.max(col).alias("peak"), F.max_by("month", col).alias("peak_month"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, max per numeric column (long form), one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                      F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
             for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*items)).alias("d")).select("d.*")


# ------------------------------------------------------------------ quartiles and an exact-size sample
def describe_with_quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``describe`` with the exact 25, 50 and 75 % quantiles (linear), long form; all columns'
    quantiles come from one counted value table."""
    names = {f"q{i}_{k}": (c, q) for i, c in enumerate(columns) for k, q in (("25", .25), ("50", .5), ("75", .75))}
    q = exact_quantiles(df, names)
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"q{i}_{k}").alias(f"q{k}") for k in ("25", "50", "75")])
             for i, c in enumerate(columns)]
    return describe(df, columns).join(q.select(F.explode(F.array(*items)).alias("d")).select("d.*"), "column")


def hash_sample(df: DataFrame, n: int, key: str = "customer_id") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those whose key has the smallest hash.

    The same rows whatever the partitions.  Rows above a threshold that about ``n`` of
    them are expected to pass are dropped where they lie, so only about ``n`` are ordered;
    should too few pass, the threshold doubles.  Of equal keys any may be taken.
    """
    total = df.count()
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    at = F.conv(F.substring("_h", 1, 12), 16, 10).cast("long")
    share = min(1.0, (n + 6 * n ** 0.5 + 10) / max(total, 1))
    while True:
        passed = hashed.where(at < F.lit(int(share * (1 << 48)))) if share < 1 else hashed
        if share >= 1 or passed.count() >= n:
            return passed.orderBy("_h", key).limit(n).drop("_h")
        share = min(1.0, 2 * share)


# ------------------------------------------------------------------ report orders, percent view, headline figures
def priority_report(customers: DataFrame) -> DataFrame:
    """Customers by descending churn risk, then CLV (to 6 decimals; ties by id), with their place."""
    r = customers.select("customer_id", "persona", "customer_tier", "health_score", "churn_risk", "clv_estimate",
                         round_half_up(F.col("churn_risk"), 6).alias("_risk"), round_half_up(F.col("clv_estimate"), 6).alias("_clv"))
    return global_rank(r, [("_risk", False), ("_clv", False)], ["customer_id"], rank_col="place", n_col=None).drop("_risk", "_clv")


def scoring_report(customers: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` customers of lowest health (to 6 decimals; ties by id)."""
    h = customers.withColumn("_h", round_half_up(F.col("health_score"), 6))
    return top_n(h, "_h", n, ascending=True).select("customer_id", "health_score", "churn_risk", "customer_tier", "persona")


def percent_view(df: DataFrame, columns: list[str], decimals: int = 1) -> DataFrame:
    """Rates as text: a column whose values all lie within -1..1 is a share and is shown
    times 100, others as they are; null is a dash.  One aggregate finds all columns' ranges."""
    top = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in columns]).first()
    shown = {c: round_half_up(F.col(c).cast("double") * F.lit(100.0 if top[c] is None or top[c] <= 1 else 1.0), decimals)
             for c in columns}
    return df.withColumns({c: F.when(v.isNotNull(), F.format_string(f"%.{decimals}f%%", v)).otherwise(F.lit("—"))
                           for c, v in shown.items()})


def executive_report(tx: DataFrame, customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Critical actions, revenue per order, the most common tier and persona (ties by
    name) and the country with most revenue (ties by name), one row."""
    t = tx.agg((F.sum("revenue") / F.greatest(F.count_distinct("invoice_id"), F.lit(1))).alias("average_order"))
    c = campaigns.agg(F.count_if(F.col("priority") == "Critical").alias("critical_actions"))

    def most(df: DataFrame, by: str, value, out: str) -> DataFrame:
        return df.groupBy(by).agg(value.alias("_v")).agg(F.min(F.struct(-F.col("_v"), F.col(by).alias("k"))).alias("m")
                                                         ).select(F.col("m.k").alias(out))

    one = F.count(F.lit(1))
    return combine_rows(c, t, most(customers, "customer_tier", one, "top_tier"), most(customers, "persona", one, "top_persona"),
                        most(tx, "country", F.round(F.sum("revenue"), 6), "top_country"))


def campaign_of_customer(campaigns: DataFrame, customer_id: str) -> DataFrame:
    """The action shown for one customer; Critical and High count as high priority."""
    return customer_by_id(campaigns, customer_id).select(
        "customer_id", "recommended_action", "suggested_offer", "priority",
        F.when(F.col("priority").isin("Critical", "High"), "High").otherwise("Normal").alias("action_priority"))
