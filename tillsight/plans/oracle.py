"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the operator semantics, not from the Spark plans: e.g. the
average order value here is the mean of per-invoice sums, the return rate a
separate aggregate joined back, ranks are plain window functions.
Doubles are rounded to 6 places like the Spark outputs.
"""

from __future__ import annotations

import re

TX = """
raw AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS invoice_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         o.o_orderdate AS invoice_date,
         CAST(l.l_partkey AS VARCHAR) AS stock_code,
         p.p_name AS product_name,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS BIGINT) AS quantity,
         CASE WHEN l.l_quantity = 0 THEN NULL ELSE l.l_extendedprice / l.l_quantity END AS unit_price,
         n.n_name AS country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
dedup AS (SELECT DISTINCT * FROM raw),
tx AS (
  SELECT invoice_id, trim(customer_id) AS customer_id, invoice_date,
         trim(coalesce(stock_code, 'Unknown')) AS stock_code,
         trim(coalesce(product_name, 'Unknown')) AS product_name,
         quantity, unit_price,
         trim(coalesce(country, 'Unknown')) AS country,
         CAST(quantity * unit_price AS DOUBLE) AS revenue,
         CAST(quantity < 0 AS INTEGER) AS is_return
  FROM dedup
  WHERE invoice_id IS NOT NULL AND customer_id IS NOT NULL AND invoice_date IS NOT NULL
    AND quantity IS NOT NULL AND unit_price IS NOT NULL AND quantity <> 0 AND unit_price >= 0
)"""

FEATURES = TX + """,
refdate AS (SELECT max(invoice_date) + INTERVAL 1 DAY AS ref, bool_or(revenue > 0) AS anyp FROM tx),
purchases AS (SELECT tx.* FROM tx, refdate WHERE revenue > 0 OR NOT anyp),
per_invoice AS (SELECT customer_id, invoice_id, sum(revenue) AS inv_rev FROM purchases GROUP BY 1, 2),
aov AS (SELECT customer_id, avg(inv_rev) AS avg_order_value FROM per_invoice GROUP BY 1),
ret AS (SELECT customer_id, avg(is_return) AS return_rate FROM tx GROUP BY 1),
base AS (
  SELECT customer_id, max(invoice_date) AS last_purchase, min(invoice_date) AS first_purchase,
         count(DISTINCT invoice_id) AS frequency, sum(revenue) AS monetary_value,
         CAST(sum(quantity) AS BIGINT) AS total_items, count(DISTINCT stock_code) AS product_diversity
  FROM purchases GROUP BY customer_id
),
feat AS (
  SELECT b.customer_id,
         greatest((epoch_us(r.ref) - epoch_us(b.last_purchase)) // 86400000000, 0) AS recency_days,
         b.frequency, b.monetary_value, a.avg_order_value, b.total_items,
         b.first_purchase, b.last_purchase,
         greatest((epoch_us(r.ref) - epoch_us(b.first_purchase)) // 86400000000, 1) AS tenure_days,
         coalesce(t.return_rate, 0.0) AS return_rate, b.product_diversity
  FROM base b JOIN aov a USING (customer_id) LEFT JOIN ret t USING (customer_id), refdate r
),
features AS (
  SELECT customer_id, recency_days, frequency, monetary_value, avg_order_value, total_items,
         first_purchase, last_purchase, tenure_days,
         CAST(frequency AS DOUBLE) / tenure_days * 30 AS purchase_rate,
         tenure_days AS customer_age_days, return_rate, product_diversity
  FROM feat
)"""

SCORES = FEATURES + """,
ranked AS (
  SELECT *,
    row_number() OVER (ORDER BY recency_days, customer_id) AS rr,
    row_number() OVER (ORDER BY frequency, customer_id) AS fr,
    row_number() OVER (ORDER BY monetary_value, customer_id) AS mr,
    count(*) OVER () AS n
  FROM features
),
rfm AS (
  SELECT *,
    CAST(least(greatest(ceil(((1.0 - CAST(rr AS DOUBLE) / n) + 1.0 / n) * 5), 1), 5) AS INTEGER) AS r_score,
    CAST(least(greatest(ceil(CAST(fr AS DOUBLE) / n * 5), 1), 5) AS INTEGER) AS f_score,
    CAST(least(greatest(ceil(CAST(mr AS DOUBLE) / n * 5), 1), 5) AS INTEGER) AS m_score
  FROM ranked
),
q90 AS (
  SELECT quantile_cont(recency_days, 0.9) AS rec90, quantile_cont(frequency, 0.9) AS freq90,
         quantile_cont(return_rate, 0.9) AS ret90 FROM features
),
scored AS (
  SELECT rfm.*, r_score + f_score + m_score AS rfm_score,
    greatest(avg_order_value * purchase_rate
             * least(greatest(18 - recency_days / 12.0 + purchase_rate, 1), 36) * 0.35, 0.0) AS clv_estimate,
    round(100 * (0.62 * least(greatest(recency_days / greatest(1.0, rec90), 0), 1)
               + 0.25 * (1 - least(greatest(frequency / greatest(1.0, freq90), 0), 1))
               + 0.13 * least(greatest(return_rate / greatest(0.01, ret90), 0), 1)), 1) AS churn_risk,
    round(least(greatest(100 * (0.35 * r_score / 5 + 0.25 * f_score / 5 + 0.25 * m_score / 5
                              + 0.15 * (1 - least(greatest(return_rate, 0), 1))), 0), 100), 1) AS health_score
  FROM rfm, q90
),
pq AS (
  SELECT quantile_cont(monetary_value, 0.8) AS m80, quantile_cont(frequency, 0.8) AS f80,
         quantile_cont(avg_order_value, 0.8) AS aov80, quantile_cont(recency_days, 0.75) AS r75,
         quantile_cont(tenure_days, 0.25) AS t25, quantile_cont(product_diversity, 0.75) AS d75,
         quantile_cont(recency_days, 0.4) AS r40
  FROM features
),
personas AS (
  SELECT scored.*,
    CASE WHEN monetary_value >= m80 AND frequency >= f80 THEN 'Premium customers'
         WHEN frequency >= f80 AND recency_days <= r40 THEN 'Loyal customers'
         WHEN churn_risk >= 65 OR recency_days >= r75 THEN 'At-risk customers'
         WHEN tenure_days <= t25 AND frequency <= 2 THEN 'New customers'
         WHEN avg_order_value >= aov80 THEN 'Big spenders'
         WHEN product_diversity >= d75 AND avg_order_value < aov80 THEN 'Bargain shoppers'
         ELSE 'Regular customers' END AS persona
  FROM scored, pq
),
customers AS (
  SELECT personas.*,
    round((0.45 * m_score + 0.30 * f_score + 0.25 * r_score) * 20, 1) AS customer_intelligence_score,
    CASE WHEN (0.45 * m_score + 0.30 * f_score + 0.25 * r_score) * 20 <= 40 THEN 'Bronze'
         WHEN (0.45 * m_score + 0.30 * f_score + 0.25 * r_score) * 20 <= 60 THEN 'Silver'
         WHEN (0.45 * m_score + 0.30 * f_score + 0.25 * r_score) * 20 <= 80 THEN 'Gold'
         ELSE 'Platinum' END AS customer_tier
  FROM personas
)"""


def _dbl(sql: str) -> str:
    """Decimal literals are DECIMAL in DuckDB; make them DOUBLE like Spark's Python floats."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1::DOUBLE", sql)


def _rx(expr: str, d: int = 6, significant: int = 12) -> str:
    whens = " ".join(
        f"WHEN abs({expr}) < {10 ** (significant - k)}.0 THEN floor(({expr}) * {10 ** k}.0 + 0.5) / {10 ** k}.0"
        for k in range(d, -1, -1))
    return f"CASE {whens} ELSE ({expr}) END"


def _r(col: str, d: int = 6) -> str:
    return f"{_rx(col, d)} AS {col}"


_RAW = {
    "transactions_clean": "WITH " + TX + """
SELECT invoice_id, customer_id, invoice_date, stock_code, product_name, quantity,
       """ + _r("unit_price") + ", country, " + _r("revenue") + """, is_return FROM tx""",
    "customer_features": "WITH " + FEATURES + f"""
SELECT customer_id, recency_days, frequency, {_r('monetary_value')}, {_r('avg_order_value')}, total_items,
       first_purchase, last_purchase, tenure_days, {_r('purchase_rate')}, customer_age_days,
       {_r('return_rate')}, product_diversity FROM features""",
    "rfm_scores": "WITH " + SCORES + """
SELECT customer_id, recency_days, frequency, monetary_value, r_score, f_score, m_score, rfm_score FROM scored""",
    "customer_scores": "WITH " + SCORES + f"""
SELECT customer_id, r_score, f_score, m_score, rfm_score, {_r('clv_estimate')},
       {_r('churn_risk')}, {_r('health_score')} FROM scored""",
    "personas": "WITH " + SCORES + " SELECT customer_id, persona FROM personas",
    "customer_tiers": "WITH " + SCORES + f"""
SELECT customer_id, {_r('customer_intelligence_score')}, customer_tier FROM customers""",
    "tier_counts": "WITH " + SCORES + """
SELECT customer_tier, count(*) AS customers FROM customers GROUP BY customer_tier""",
    "rfm_segments": "WITH " + FEATURES + """,
rk AS (
  SELECT customer_id, recency_days, frequency, monetary_value,
    row_number() OVER (ORDER BY recency_days, customer_id) AS rr,
    row_number() OVER (ORDER BY frequency, customer_id) AS fr,
    row_number() OVER (ORDER BY monetary_value, customer_id) AS mr,
    count(*) OVER () AS n FROM features
),
b AS (
  SELECT *,
    CAST(6 - least(greatest(ceil(5.0 * (rr - 1) / (n - 1)), 1), 5) AS INTEGER) AS r_score,
    CAST(least(greatest(ceil(5.0 * (fr - 1) / (n - 1)), 1), 5) AS INTEGER) AS f_score,
    CAST(least(greatest(ceil(5.0 * (mr - 1) / (n - 1)), 1), 5) AS INTEGER) AS m_score
  FROM rk
)
SELECT customer_id, recency_days, frequency, monetary_value, r_score, f_score, m_score,
       r_score + f_score + m_score AS rfm_score,
       CASE WHEN r_score + f_score + m_score >= 13 THEN 'Champions'
            WHEN r_score + f_score + m_score >= 10 THEN 'Loyal'
            WHEN r_score + f_score + m_score >= 7 THEN 'Potential'
            WHEN r_score + f_score + m_score >= 5 THEN 'At Risk'
            ELSE 'Needs Attention' END AS rfm_segment
FROM b""",
}

ORACLE = {k: _dbl(v) for k, v in _RAW.items()}


# ---------------------------------------------------------------- wave 2
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _campaign_sql() -> str:
    from tillsight.operators.campaigns import DEFAULT_RULE, RULES, TEXT_COLUMNS
    texts = []
    for j, name in enumerate(TEXT_COLUMNS):
        arr = "[" + ", ".join(_q(r[j]) for r in RULES + [DEFAULT_RULE]) + "]"
        texts.append(f"{arr}[rule] AS {name}")
    return SCORES + """,
cb AS (
  SELECT customer_id, persona, customer_tier, churn_risk, health_score, clv_estimate, recency_days, frequency,
         coalesce(churn_risk, 0) AS _churn, coalesce(health_score, 50) AS _health,
         coalesce(clv_estimate, 0) AS _clv, 0.0 AS _spend, coalesce(recency_days, 0) AS _rec,
         coalesce(frequency, 0) AS _freq, coalesce(persona, 'Regular customers') AS _persona,
         coalesce(customer_tier, 'Standard') AS _tier
  FROM customers
),
cq AS (
  SELECT quantile_cont(_clv, 0.8) AS clv80, quantile_cont(_spend, 0.8) AS spend80,
         quantile_cont(_freq, 0.8) AS freq80, quantile_cont(_rec, 0.5) AS rec50,
         quantile_cont(recency_days, 0.85) AS rec85, quantile_cont(_clv, 0.9) AS clv90 FROM cb
),
fl AS (
  SELECT cb.*, (_clv >= clv80 OR _spend >= spend80) AS hv, _churn >= 80 AS severe, _churn >= 65 AS high,
         (_churn >= 45 AND _churn <= 64.999) AS moderate, _rec > rec50 AS inactive,
         recency_days >= rec85 AS very_inactive, clv90
  FROM cb, cq
),
ruled AS (
  SELECT fl.*,
    CASE WHEN hv AND severe THEN 1
         WHEN hv AND high AND _health < 50 THEN 2
         WHEN _tier = 'Platinum' AND high THEN 3
         WHEN _persona = 'Premium customers' AND high THEN 4
         WHEN _persona = 'Big spenders' AND high THEN 5
         WHEN _persona = 'Loyal customers' AND moderate THEN 6
         WHEN _persona = 'New customers' AND high THEN 7
         WHEN _persona = 'Bargain shoppers' AND high THEN 8
         WHEN severe AND very_inactive THEN 9
         WHEN high AND inactive THEN 10
         WHEN high THEN 11
         WHEN hv AND NOT high THEN 12
         WHEN _persona = 'Regular customers' AND _health >= 65 THEN 13
         ELSE 14 END AS rule,
    CASE WHEN hv AND severe THEN 'Critical' WHEN severe THEN 'Critical' WHEN high THEN 'High'
         WHEN hv THEN 'High' WHEN _health < 45 THEN 'High' ELSE 'Normal' END AS priority,
    round(100 * (0.45 * least(greatest(_clv / greatest(clv90, 1.0), 0), 1)
               + 0.40 * least(greatest(_churn / 100, 0), 1)
               + 0.15 * least(greatest(1 - _health / 100, 0), 1)), 1) AS campaign_opportunity_score
  FROM fl
),
campaigns AS (
  SELECT customer_id, persona, customer_tier, priority, """ + ", ".join(texts) + """,
         campaign_opportunity_score, churn_risk, health_score, clv_estimate, recency_days, frequency
  FROM ruled
)"""


_COHORT = TX + """,
pm AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', invoice_date) AS DATE) AS m FROM tx WHERE revenue > 0),
pc AS (SELECT customer_id, m, min(m) OVER (PARTITION BY customer_id) AS cohort FROM pm),
cr AS (
  SELECT cohort, CAST((year(m) - year(cohort)) * 12 + month(m) - month(cohort) AS INTEGER) AS period,
         count(DISTINCT customer_id) AS active_customers
  FROM pc GROUP BY 1, 2
),
retention AS (
  SELECT strftime(cohort, '%Y-%m') AS cohort_month, period, active_customers,
         round(active_customers / max(CASE WHEN period = 0 THEN active_customers END)
               OVER (PARTITION BY cohort) * 100, 1) AS retention_rate
  FROM cr
)"""

_MONTHLY = TX + """,
mrev AS (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue) AS revenue
         FROM tx WHERE revenue > 0 GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM mrev),
monthly AS (SELECT s.month, coalesce(m.revenue, 0.0) AS revenue FROM spine s LEFT JOIN mrev m USING (month))"""

_COUNTRY = TX + """,
cp AS (SELECT country, sum(revenue) AS revenue, count(DISTINCT invoice_id) AS orders
       FROM tx WHERE revenue > 0 GROUP BY country ORDER BY revenue DESC, country LIMIT 15)"""

_CORR_COLS = ["recency_days", "frequency", "monetary_value", "avg_order_value", "tenure_days",
              "purchase_rate", "return_rate", "product_diversity"]
_TXCOLS = [("invoice_id", "string"), ("customer_id", "string"), ("invoice_date", "timestamp_ntz"),
           ("stock_code", "string"), ("product_name", "string"), ("quantity", "bigint"),
           ("unit_price", "double"), ("country", "string"), ("revenue", "double"), ("is_return", "int")]


def _column_profile_sql() -> str:
    parts = []
    for c, t in _TXCOLS:
        num = t in ("bigint", "double", "int")
        mn = f"round(min({c})::DOUBLE, 2)" if num else "NULL::DOUBLE"
        mx = f"round(max({c})::DOUBLE, 2)" if num else "NULL::DOUBLE"
        if num:
            out = (f"(SELECT count(*) FROM tx, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 "
                   f"FROM tx) q WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))")
        else:
            out = "NULL::BIGINT"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS data_type, count(*) FILTER (WHERE {c} IS NULL) AS missing_values,
  round(count(*) FILTER (WHERE {c} IS NULL) / greatest(count(*), 1) * 100, 2) AS missing_pct,
  count(DISTINCT {c}) AS unique_values, coalesce(substring(min(CAST({c} AS VARCHAR)), 1, 80), '—') AS example,
  {mn} AS min, {mx} AS max, {out} AS outliers_iqr FROM tx""")
    return "WITH " + TX + "\n" + "\nUNION ALL\n".join(parts)


def _audit_sql() -> str:
    return "WITH " + TX + """,
f AS (
  SELECT (SELECT count(*) FROM raw) AS raw_rows,
         (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicates,
         (SELECT count(*) FROM raw WHERE invoice_id IS NULL OR customer_id IS NULL OR invoice_date IS NULL
             OR quantity IS NULL OR unit_price IS NULL) AS missing_required,
         (SELECT count(*) FROM raw WHERE invoice_date IS NULL) AS invalid_dates,
         (SELECT count(*) FROM raw WHERE quantity IS NULL) AS invalid_quantity,
         (SELECT count(*) FROM raw WHERE unit_price IS NULL) AS invalid_price,
         (SELECT count(*) FROM raw WHERE quantity = 0) AS zero_quantity,
         (SELECT count(*) FROM raw WHERE unit_price < 0) AS negative_price,
         (SELECT count(*) FROM tx) AS clean_rows
)
SELECT 'Duplicate rows' AS "check", duplicates AS records_affected, CASE WHEN duplicates > 0 THEN 'Removed' ELSE 'None' END AS action FROM f
UNION ALL SELECT 'Rows with missing required fields', missing_required, CASE WHEN missing_required > 0 THEN 'Removed' ELSE 'None' END FROM f
UNION ALL SELECT 'Invalid transaction dates', invalid_dates, CASE WHEN invalid_dates > 0 THEN 'Removed' ELSE 'None' END FROM f
UNION ALL SELECT 'Non-numeric quantities', invalid_quantity, CASE WHEN invalid_quantity > 0 THEN 'Removed' ELSE 'None' END FROM f
UNION ALL SELECT 'Non-numeric prices', invalid_price, CASE WHEN invalid_price > 0 THEN 'Removed' ELSE 'None' END FROM f
UNION ALL SELECT 'Zero-quantity rows', zero_quantity, CASE WHEN zero_quantity > 0 THEN 'Removed' ELSE 'None' END FROM f
UNION ALL SELECT 'Negative-price rows', negative_price, CASE WHEN negative_price > 0 THEN 'Removed' ELSE 'None' END FROM f
UNION ALL SELECT 'Total rows removed', greatest(raw_rows - clean_rows, 0), 'Cleaning complete' FROM f"""


_RAW.update({
    "campaigns": "WITH " + _campaign_sql() + f"""
SELECT customer_id, persona, customer_tier, priority, campaign_strategy, recommended_action, suggested_offer,
       recommended_channel, incentive_level, campaign_reason, {_r('campaign_opportunity_score')},
       {_r('churn_risk')}, {_r('health_score')}, {_r('clv_estimate')}, recency_days, frequency FROM campaigns""",
    "campaign_allocation": "WITH " + _campaign_sql() + """,
al AS (SELECT campaign_strategy, count(*) AS customers, count(*) FILTER (WHERE incentive_level <> 'None') AS with_incentive
       FROM campaigns GROUP BY 1)
SELECT campaign_strategy, customers, with_incentive,
       round(customers / greatest(sum(customers) OVER (), 1) * 100, 1) AS share FROM al""",
    "campaigns_critical": "WITH " + _campaign_sql() + """
SELECT customer_id, priority, campaign_strategy FROM campaigns WHERE lower(priority) = 'critical'""",
    "cohort_retention": "WITH " + _COHORT + " SELECT * FROM retention",
    "cohort_summary": "WITH " + _COHORT + """
SELECT cohort_month, arg_min(active_customers, period) AS starting_customers,
       arg_max(active_customers, period) AS latest_customers,
       arg_max(retention_rate, period) AS latest_retention, max(period) AS observed_periods
FROM retention GROUP BY cohort_month""",
    "persona_counts": "WITH " + SCORES + " SELECT persona, count(*) AS customers FROM customers GROUP BY persona",
    "run_summary_kpis": "WITH " + SCORES + """
SELECT round((SELECT sum(revenue) FROM tx), 2) AS revenue, (SELECT count(*) FROM customers) AS customers,
       (SELECT count(DISTINCT invoice_id) FROM tx) AS orders,
       round((SELECT avg(health_score) FROM customers), 1) AS average_health,
       (SELECT count(*) FROM customers WHERE persona = 'At-risk customers') AS at_risk_customers""",
    "customer_kpis": "WITH " + FEATURES + f"""
, k AS (SELECT count(*) AS customer_count, sum(monetary_value) AS total_revenue, avg(monetary_value) AS average_spent,
       avg(frequency) AS average_frequency, avg(recency_days) AS average_recency,
       CAST(min(recency_days) AS DOUBLE) AS minimum_recency, CAST(max(recency_days) AS DOUBLE) AS maximum_recency,
       quantile_cont(recency_days, 0.5) AS median_recency FROM features)
SELECT customer_count, {_r('total_revenue')}, {_r('average_spent')}, {_r('average_frequency')},
       {_r('average_recency')}, {_r('minimum_recency')}, {_r('maximum_recency')}, {_r('median_recency')} FROM k""",
    "revenue_by_tier": "WITH " + SCORES + f"""
, g AS (SELECT customer_tier, count(*) AS customers, sum(monetary_value) AS revenue, avg(monetary_value) AS average_revenue,
       avg(health_score) AS average_health, avg(clv_estimate) AS average_clv FROM customers GROUP BY 1)
SELECT customer_tier, customers, {_r('revenue')}, {_r('average_revenue')}, {_r('average_health')}, {_r('average_clv')} FROM g""",
    "feature_correlation": "WITH " + FEATURES + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_rx(f'corr({a}, {b})')} AS correlation FROM features"
        for a in _CORR_COLS for b in _CORR_COLS),
    "monetary_histogram": "WITH " + FEATURES + f"""
, st AS (SELECT min(monetary_value) AS lo, max(monetary_value) AS hi FROM features),
  st2 AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM st),
  w AS (SELECT lo, (hi - lo) / 20 AS width FROM st2),
  b AS (SELECT CAST(least(floor((monetary_value - lo) / width), 19) AS INTEGER) AS bin, count(*) AS n
        FROM features, w GROUP BY 1),
  sp AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT sp.bin, {_rx('lo + sp.bin * width')} AS lower, {_rx('lo + (sp.bin + 1) * width')} AS upper,
       coalesce(b.n, 0) AS count
FROM sp LEFT JOIN b USING (bin), w""",
    "monetary_box_by_tier": "WITH " + SCORES + f"""
, q AS (SELECT customer_tier, quantile_cont(monetary_value, 0.25) AS q1, quantile_cont(monetary_value, 0.5) AS median,
        quantile_cont(monetary_value, 0.75) AS q3 FROM customers GROUP BY 1),
  j AS (SELECT c.customer_tier, c.monetary_value AS v, q1, median, q3,
        (monetary_value >= q1 - 1.5 * (q3 - q1) AND monetary_value <= q3 + 1.5 * (q3 - q1)) AS inside
        FROM customers c JOIN q USING (customer_tier)),
  g AS (SELECT customer_tier, q1, median, q3, min(v) FILTER (WHERE inside) AS lower_whisker,
        max(v) FILTER (WHERE inside) AS upper_whisker, count(*) FILTER (WHERE NOT inside) AS outliers,
        count(*) AS n FROM j GROUP BY 1, 2, 3, 4)
SELECT customer_tier, {_r('q1')}, {_r('median')}, {_r('q3')}, {_r('lower_whisker')}, {_r('upper_whisker')}, outliers, n FROM g""",
    "monthly_revenue": "WITH " + _MONTHLY + f" SELECT month, {_r('revenue')} FROM monthly",
    "top_products": "WITH " + TX + f"""
, tp AS (SELECT product_name AS product, sum(revenue) AS revenue, CAST(sum(quantity) AS BIGINT) AS units
         FROM tx WHERE revenue > 0 GROUP BY 1 ORDER BY revenue DESC, product LIMIT 15)
SELECT product, {_r('revenue')}, units FROM tp""",
    "country_performance": "WITH " + _COUNTRY + f" SELECT country, {_r('revenue')}, orders FROM cp",
    "market_report": "WITH " + _COUNTRY.replace(" LIMIT 15", "") + f"""
SELECT country, {_rx('round(revenue, 2)')} AS revenue, orders,
       {_rx('round(revenue / sum(revenue) OVER () * 100, 1)')} AS revenue_share FROM cp""",
    "top_countries_by_lines": "WITH " + TX + """
SELECT country, count(*) AS lines FROM tx GROUP BY country ORDER BY lines DESC, country LIMIT 10""",
    "popular_products_qty": "WITH " + TX + """
SELECT stock_code, product_name, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM tx WHERE quantity > 0 GROUP BY 1, 2""",
    "month_of_year": "WITH " + _MONTHLY + f"""
, g AS (SELECT CAST(month(month) AS INTEGER) AS month_number, monthname(month) AS month_name,
        avg(revenue) AS average_revenue, count(*) AS months FROM monthly GROUP BY 1, 2)
SELECT month_number, month_name, {_r('average_revenue')}, months FROM g""",
    "year_totals": "WITH " + TX + f"""
, y AS (SELECT CAST(year(invoice_date) AS INTEGER) AS year, sum(revenue) AS revenue, count(DISTINCT invoice_id) AS orders
        FROM tx WHERE revenue > 0 GROUP BY 1)
SELECT year, {_r('revenue')}, orders FROM y""",
    "customers_at_risk": "WITH " + SCORES + """
SELECT customer_id, persona, recency_days, frequency FROM customers WHERE persona = 'At-risk customers'
ORDER BY customer_id LIMIT 100""",
    "customer_lookup": "WITH " + SCORES + f"""
SELECT customer_id, persona, customer_tier, {_r('health_score')}, {_r('monetary_value')} FROM customers
WHERE customer_id = '1234'""",
    "top_customers_by_value": "WITH " + FEATURES + f"""
, t AS (SELECT customer_id, monetary_value, frequency FROM features ORDER BY monetary_value DESC, customer_id LIMIT 10)
SELECT customer_id, {_r('monetary_value')}, frequency FROM t""",
    "validation_report": "WITH " + TX + """
SELECT count(*) AS rows, count(*) FILTER (WHERE customer_id IS NULL) AS null_customers,
       count(*) FILTER (WHERE quantity = 0) AS zero_quantity, count(*) FILTER (WHERE invoice_date IS NULL) AS bad_dates
FROM raw""",
    "raw_profile_overview": "WITH " + TX + """,
o AS (SELECT (SELECT count(*) FROM raw) AS rows,
             (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS dups,
             (SELECT sum((invoice_id IS NULL)::INT + (customer_id IS NULL)::INT + (invoice_date IS NULL)::INT
                  + (stock_code IS NULL)::INT + (product_name IS NULL)::INT + (quantity IS NULL)::INT
                  + (unit_price IS NULL)::INT + (country IS NULL)::INT) FROM raw) AS missing)
SELECT 'Rows' AS metric, CAST(rows AS DOUBLE) AS value FROM o
UNION ALL SELECT 'Columns', 8.0 FROM o
UNION ALL SELECT 'Duplicate rows', CAST(dups AS DOUBLE) FROM o
UNION ALL SELECT 'Missing cells', CAST(coalesce(missing, 0) AS DOUBLE) FROM o""",
    "clean_column_profile": _column_profile_sql(),
    "quality_comparison": "WITH " + TX + """,
b AS (SELECT (SELECT count(*) FROM raw) AS rows_b,
             (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS dup_b,
             (SELECT coalesce(sum((invoice_id IS NULL)::INT + (customer_id IS NULL)::INT + (invoice_date IS NULL)::INT
                  + (stock_code IS NULL)::INT + (product_name IS NULL)::INT + (quantity IS NULL)::INT
                  + (unit_price IS NULL)::INT + (country IS NULL)::INT), 0) FROM raw) AS miss_b,
             (SELECT count(*) FROM tx) AS rows_a,
             (SELECT count(*) FROM tx) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx)) AS dup_a,
             (SELECT coalesce(sum((invoice_id IS NULL)::INT + (customer_id IS NULL)::INT + (invoice_date IS NULL)::INT
                  + (stock_code IS NULL)::INT + (product_name IS NULL)::INT + (quantity IS NULL)::INT
                  + (unit_price IS NULL)::INT + (country IS NULL)::INT + (revenue IS NULL)::INT
                  + (is_return IS NULL)::INT), 0) FROM tx) AS miss_a)
SELECT 'Rows' AS metric, rows_b AS before_cleaning, rows_a AS after_cleaning, rows_a - rows_b AS change FROM b
UNION ALL SELECT 'Duplicate rows', dup_b, dup_a, dup_a - dup_b FROM b
UNION ALL SELECT 'Missing cells', CAST(miss_b AS BIGINT), CAST(miss_a AS BIGINT), CAST(miss_a - miss_b AS BIGINT) FROM b""",
    "cleaning_audit": _audit_sql(),
})
ORACLE.update({k: _dbl(v) for k, v in _RAW.items() if k not in ORACLE})


# ---------------------------------------------------------------- wave 3: recommendations
_REC = TX + """,
pur AS (SELECT *, stock_code AS product_id FROM tx WHERE revenue > 0),
catalog AS (
  SELECT product_id, arg_min(product_name, (invoice_date, product_name)) AS product_name,
         quantile_cont(unit_price, 0.5) AS price, count(DISTINCT invoice_id) AS popularity, sum(revenue) AS revenue
  FROM pur GROUP BY product_id
),
basket AS (SELECT DISTINCT invoice_id, product_id FROM pur),
co AS (
  SELECT a.product_id AS product_a, b.product_id AS product_b, count(*) AS n
  FROM basket a JOIN basket b ON a.invoice_id = b.invoice_id AND a.product_id <> b.product_id
  GROUP BY 1, 2
),
bought AS (SELECT DISTINCT customer_id, product_id FROM pur),
cp AS (SELECT customer_id, product_id, count(*) AS w FROM pur GROUP BY 1, 2),
pop AS (SELECT product_id, count(DISTINCT invoice_id) AS purchases, count(DISTINCT customer_id) AS customers,
               sum(revenue) AS revenue FROM pur GROUP BY 1)"""

_RECPROD = _REC + """,
cand AS (
  SELECT bo.customer_id, co.product_b AS product_id, sum(co.n) AS score
  FROM bought bo JOIN co ON bo.product_id = co.product_a
  WHERE NOT EXISTS (SELECT 1 FROM bought x WHERE x.customer_id = bo.customer_id AND x.product_id = co.product_b)
  GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM cand),
warm AS (SELECT customer_id, product_id, score, rank FROM ranked WHERE rank <= 5),
poprank AS (SELECT product_id, row_number() OVER (ORDER BY popularity DESC, product_id) AS pop_rank FROM catalog),
coldc AS (SELECT DISTINCT customer_id FROM bought WHERE customer_id NOT IN (SELECT customer_id FROM warm)),
coldfill AS (
  SELECT c.customer_id, p.product_id, p.pop_rank FROM coldc c, poprank p
  WHERE NOT EXISTS (SELECT 1 FROM bought x WHERE x.customer_id = c.customer_id AND x.product_id = p.product_id)
),
coldtop AS (
  SELECT customer_id, product_id, CAST(NULL AS BIGINT) AS score,
         row_number() OVER (PARTITION BY customer_id ORDER BY pop_rank) AS rank FROM coldfill
),
recs AS (
  SELECT r.customer_id, CAST(r.rank AS INTEGER) AS rank, r.product_id, c.product_name, {PRICE2} AS price,
         CAST(r.score AS BIGINT) AS score, 'Frequently bought with your purchase history' AS reason
  FROM (SELECT * FROM warm UNION ALL SELECT * FROM coldtop WHERE rank <= 5) r JOIN catalog c USING (product_id)
)"""

_RECPROD = _RECPROD.replace("{PRICE2}", _rx("c.price", 2))

_COS = """
norms_{e} AS (SELECT {e} AS id, sqrt(sum(w * w)) AS norm FROM cp GROUP BY 1),
dots_{e} AS (
  SELECT l.{e} AS a, r.{e} AS b, sum(l.w * r.w) AS dot
  FROM cp l JOIN cp r ON l.{k} = r.{k} AND l.{e} <> r.{e} GROUP BY 1, 2
),
sims_{e} AS (
  SELECT d.a, d.b, d.dot / (na.norm * nb.norm) AS similarity
  FROM dots_{e} d JOIN norms_{e} na ON na.id = d.a JOIN norms_{e} nb ON nb.id = d.b
)"""


def _neighbour_sql(limit: int, neighbours: int, weighted: bool, weight: str) -> str:
    votes = ("SELECT customer_id, product_id, CAST(sum(quantity) AS DOUBLE) AS v FROM pur GROUP BY 1, 2"
             if weight == "quantity" else "SELECT customer_id, product_id, CAST(w AS DOUBLE) AS v FROM cp")
    contrib = "s.similarity * v.v" if weighted else "v.v"
    return "WITH " + _REC + "," + _COS.format(e="customer_id", k="product_id") + f""",
nb AS (
  SELECT a, b, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS nr FROM sims_customer_id
    WHERE similarity > 0) WHERE nr <= {neighbours}
),
votes AS ({votes}),
sc AS (
  SELECT s.a AS customer_id, v.product_id, sum({contrib}) AS score
  FROM nb s JOIN votes v ON v.customer_id = s.b
  WHERE NOT EXISTS (SELECT 1 FROM cp x WHERE x.customer_id = s.a AND x.product_id = v.product_id)
  GROUP BY 1, 2
),
rk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM sc),
warm AS (SELECT customer_id, product_id, score, rank FROM rk WHERE rank <= {limit}),
poprank AS (SELECT product_id, row_number() OVER (ORDER BY customers DESC, purchases DESC, revenue DESC, product_id) AS pop_rank FROM pop),
coldc AS (SELECT DISTINCT customer_id FROM cp WHERE customer_id NOT IN (SELECT customer_id FROM warm)),
cold AS (SELECT c.customer_id, p.product_id, CAST(NULL AS DOUBLE) AS score, p.pop_rank AS rank
         FROM coldc c JOIN poprank p ON p.pop_rank <= {limit}),
allr AS (SELECT * FROM warm UNION ALL SELECT * FROM cold)
SELECT r.customer_id, CAST(r.rank AS INTEGER) AS rank, r.product_id, {_rx('round(r.score, 4)')} AS score,
       coalesce(p.customers, 0) AS customers, {_rx('coalesce(p.revenue, 0.0)', 2)} AS revenue,
       'Customers with similar purchase patterns also bought this product' AS reason
FROM allr r LEFT JOIN pop p USING (product_id)"""


_RAW.update({
    "product_catalog": "WITH " + _REC + f"""
SELECT product_id, product_name, {_r('price')}, popularity, {_r('revenue')} FROM catalog""",
    "co_purchase": "WITH " + _REC + " SELECT product_a, product_b, n FROM co",
    "recommend_products": "WITH " + _RECPROD + f"""
SELECT customer_id, rank, product_id, product_name, {_r('price')}, score, reason FROM recs""",
    "cross_sell": "WITH " + _REC + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY product_a ORDER BY n DESC, product_b) AS rank FROM co)
SELECT t.product_a AS product_id, CAST(t.rank AS INTEGER) AS rank, t.product_b AS recommended_id, c.product_name,
       {_rx('c.price', 2)} AS price, t.n, 'Frequently bought together' AS reason
FROM t JOIN catalog c ON c.product_id = t.product_b WHERE t.rank <= 5""",
    "upsell": "WITH " + _REC + f""",
pr AS (
  SELECT a.product_id AS a_id, b.product_id AS b_id, b.product_name, b.price, b.popularity
  FROM catalog a JOIN catalog b ON b.price > a.price AND b.price <= a.price * 1.75 WHERE a.price > 0
),
t AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY popularity DESC, price, b_id) AS rank FROM pr)
SELECT a_id AS product_id, CAST(rank AS INTEGER) AS rank, b_id AS recommended_id, product_name,
       {_rx('price', 2)} AS price, 'Higher-value alternative' AS reason FROM t WHERE rank <= 3""",
    "product_popularity": "WITH " + _REC + f" SELECT product_id, purchases, customers, {_r('revenue')} FROM pop",
    "similar_products": "WITH " + _REC + "," + _COS.format(e="product_id", k="customer_id") + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM sims_product_id)
SELECT a AS product_id, CAST(rank AS INTEGER) AS rank, b AS similar_id, {_rx('round(similarity, 4)')} AS similarity
FROM t WHERE rank <= 10""",
    "similar_customers": "WITH " + _REC + "," + _COS.format(e="customer_id", k="product_id") + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM sims_customer_id)
SELECT a AS customer_id, CAST(rank AS INTEGER) AS rank, b AS similar_id, {_rx('round(similarity, 4)')} AS similarity
FROM t WHERE rank <= 10""",
    "neighbour_recommendations": _neighbour_sql(10, 20, True, "lines"),
    "hybrid_recommendations": _neighbour_sql(10, 10, False, "quantity"),
    "recommendation_metrics": "WITH " + _RECPROD + f""",
dims AS (SELECT count(DISTINCT customer_id) AS nc, count(DISTINCT product_id) AS np, count(*) AS nnz FROM cp),
per AS (SELECT customer_id, count(DISTINCT product_id) AS k FROM recs GROUP BY 1),
m AS (SELECT (SELECT count(DISTINCT product_id) FROM recs) AS recommended_products,
             (SELECT count(DISTINCT customer_id) FROM recs) AS customers_served,
             (SELECT avg(k) FROM per) AS mean_distinct_per_customer, nc, np, nnz FROM dims)
SELECT recommended_products, customers_served, {_r('mean_distinct_per_customer')},
       {_rx('recommended_products / np * 100')} AS catalog_coverage_pct,
       {_rx('1.0 - nnz / (nc * np)')} AS sparsity FROM m""",
    "top_recommended": "WITH " + _RECPROD + """
SELECT product_id, count(*) AS times_recommended FROM recs GROUP BY 1 ORDER BY times_recommended DESC, product_id LIMIT 10""",
})
ORACLE.update({k: _dbl(v) for k, v in _RAW.items() if k not in ORACLE})


# ---------------------------------------------------------------- wave 4: time series
_STRICT = TX + """,
sraw AS (SELECT invoice_id AS "Invoice", product_name AS "Description", quantity AS "Quantity",
                invoice_date AS "InvoiceDate", unit_price AS "Price", customer_id AS "Customer ID", country AS "Country"
         FROM raw),
sclean AS (
  SELECT *, CAST("Quantity" * "Price" AS DOUBLE) AS "Sales"
  FROM (SELECT DISTINCT * FROM sraw WHERE "Customer ID" IS NOT NULL)
  WHERE "InvoiceDate" IS NOT NULL AND "Quantity" IS NOT NULL AND "Price" IS NOT NULL
    AND NOT starts_with(CAST("Invoice" AS VARCHAR), 'C') AND "Quantity" > 0 AND "Price" > 0
),
me AS (SELECT last_day("InvoiceDate") AS "InvoiceDate", sum("Sales") AS "Sales" FROM sclean GROUP BY 1),
mespine AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min("InvoiceDate")),
                    date_trunc('month', max("InvoiceDate")), INTERVAL 1 MONTH)) AS DATE)) AS "InvoiceDate" FROM me),
monthend AS (SELECT s."InvoiceDate", coalesce(m."Sales", 0.0) AS "Sales" FROM mespine s LEFT JOIN me m USING ("InvoiceDate"))"""

_RAW.update({
    "country_monthly_revenue": "WITH " + TX + f""",
cm AS (SELECT country, CAST(date_trunc('month', invoice_date) AS DATE) AS month, sum(revenue) AS revenue
       FROM tx WHERE revenue > 0 GROUP BY 1, 2),
b AS (SELECT country, min(month) AS a, max(month) AS z FROM cm GROUP BY 1),
sp AS (SELECT country, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS month FROM b)
SELECT sp.country, sp.month, {_rx('coalesce(cm.revenue, 0.0)')} AS revenue
FROM sp LEFT JOIN cm USING (country, month)""",
    "month_end_sales": "WITH " + _STRICT + f""" SELECT "InvoiceDate", {_rx('"Sales"')} AS "Sales" FROM monthend""",
    "forecast_features": "WITH " + _MONTHLY + f""",
ff AS (
  SELECT month AS invoice_date, revenue,
    lag(revenue, 1) OVER w AS lag_1, lag(revenue, 2) OVER w AS lag_2, lag(revenue, 3) OVER w AS lag_3,
    CASE WHEN count(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
         THEN avg(revenue) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS rolling_3,
    CASE WHEN count(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 6
         THEN avg(revenue) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS rolling_6,
    CAST(month(month) AS INTEGER) AS month, CAST(quarter(month) AS INTEGER) AS quarter,
    CAST(row_number() OVER w - 1 AS INTEGER) AS trend
  FROM monthly WINDOW w AS (ORDER BY month)
)
SELECT invoice_date, {_r('revenue')}, {_r('lag_1')}, {_r('lag_2')}, {_r('lag_3')}, {_r('rolling_3')},
       {_r('rolling_6')}, month, quarter, trend FROM ff""",
    "strict_forecast_features": "WITH " + _STRICT + f""",
sf AS (
  SELECT "InvoiceDate", "Sales", CAST(year("InvoiceDate") AS INTEGER) AS "Year",
    CAST(month("InvoiceDate") AS INTEGER) AS "Month", CAST(quarter("InvoiceDate") AS INTEGER) AS "Quarter",
    lag("Sales", 1) OVER w AS "Lag_1", lag("Sales", 2) OVER w AS "Lag_2", lag("Sales", 3) OVER w AS "Lag_3",
    lag("Sales", 6) OVER w AS "Lag_6",
    CASE WHEN count("Sales") OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
         THEN avg("Sales") OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS "RollingMean_3",
    CASE WHEN count("Sales") OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 6
         THEN avg("Sales") OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS "RollingMean_6",
    CASE WHEN count("Sales") OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) = 12
         THEN avg("Sales") OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS "RollingMean_12"
  FROM monthend WINDOW w AS (ORDER BY "InvoiceDate")
)
SELECT "InvoiceDate", {_rx('"Sales"')} AS "Sales", "Year", "Month", "Quarter", {_rx('"Lag_1"')} AS "Lag_1",
       {_rx('"Lag_2"')} AS "Lag_2", {_rx('"Lag_3"')} AS "Lag_3", {_rx('"Lag_6"')} AS "Lag_6",
       {_rx('"RollingMean_3"')} AS "RollingMean_3", {_rx('"RollingMean_6"')} AS "RollingMean_6",
       {_rx('"RollingMean_12"')} AS "RollingMean_12"
FROM sf WHERE "Lag_6" IS NOT NULL AND "RollingMean_12" IS NOT NULL AND "Lag_1" IS NOT NULL""",
    "next_month_features": "WITH " + _STRICT + f""",
l AS (SELECT *, row_number() OVER (ORDER BY "InvoiceDate" DESC) AS k FROM monthend),
g AS (SELECT count(*) FILTER (WHERE k <= 12) AS n, last_day(max("InvoiceDate") + INTERVAL 1 MONTH) AS d,
        max("Sales") FILTER (WHERE k = 1) AS "Lag_1", max("Sales") FILTER (WHERE k = 2) AS "Lag_2",
        max("Sales") FILTER (WHERE k = 3) AS "Lag_3", max("Sales") FILTER (WHERE k = 6) AS "Lag_6",
        avg("Sales") FILTER (WHERE k <= 3) AS "RollingMean_3", avg("Sales") FILTER (WHERE k <= 6) AS "RollingMean_6",
        avg("Sales") FILTER (WHERE k <= 12) AS "RollingMean_12" FROM l)
SELECT d AS "InvoiceDate", CAST(year(d) AS INTEGER) AS "Year", CAST(month(d) AS INTEGER) AS "Month",
       CAST(quarter(d) AS INTEGER) AS "Quarter", {_rx('"Lag_1"')} AS "Lag_1", {_rx('"Lag_2"')} AS "Lag_2",
       {_rx('"Lag_3"')} AS "Lag_3", {_rx('"Lag_6"')} AS "Lag_6", {_rx('"RollingMean_3"')} AS "RollingMean_3",
       {_rx('"RollingMean_6"')} AS "RollingMean_6", {_rx('"RollingMean_12"')} AS "RollingMean_12"
FROM g WHERE n >= 12""",
    "growth_rolling": "WITH " + _STRICT + f""",
gr AS (
  SELECT "InvoiceDate", "Sales",
    ("Sales" - lag("Sales", 1) OVER w) / lag("Sales", 1) OVER w * 100 AS "GrowthRate",
    CASE WHEN count("Sales") OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
         THEN avg("Sales") OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS "RollingMean_3",
    CASE WHEN count("Sales") OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
         THEN stddev_samp("Sales") OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS "RollingStd_3",
    monthname("InvoiceDate") AS "MonthName", CAST(isodow("InvoiceDate") - 1 AS INTEGER) AS "Weekday"
  FROM monthend WINDOW w AS (ORDER BY "InvoiceDate")
)
SELECT "InvoiceDate", {_rx('"Sales"')} AS "Sales", {_rx('"GrowthRate"')} AS "GrowthRate",
       {_rx('"RollingMean_3"')} AS "RollingMean_3", {_rx('"RollingStd_3"')} AS "RollingStd_3", "MonthName", "Weekday"
FROM gr""",
    "naive_baseline": "WITH " + _STRICT + f""",
r AS (SELECT *, row_number() OVER (ORDER BY "InvoiceDate") AS i, count(*) OVER () AS n FROM monthend),
s AS (SELECT max(CAST(floor(n * 0.8) AS BIGINT)) AS split FROM r),
b AS (SELECT r."Sales" AS naive FROM r, s WHERE r.i = s.split)
SELECT r."InvoiceDate", {_rx('r."Sales"')} AS actual, {_rx('b.naive')} AS naive_forecast FROM r, s, b WHERE r.i > s.split""",
})
ORACLE.update({k: _dbl(v) for k, v in _RAW.items() if k not in ORACLE})


# ---------------------------------------------------------------- wave 6
_PROFILE = ["recency_days", "frequency", "monetary_value", "avg_order_value", "tenure_days",
            "purchase_rate", "return_rate", "product_diversity"]

_RAW.update({
    "notebook_customer_tiers": "WITH " + _STRICT + f""",
cb AS (SELECT "Customer ID" AS "CustomerID", count(DISTINCT "Invoice") AS tt, CAST(sum("Quantity") AS BIGINT) AS tq,
              sum("Sales") AS ts, max("InvoiceDate") AS lp FROM sclean GROUP BY 1),
c2 AS (SELECT *, (epoch_us((SELECT max(lp) FROM cb)) - epoch_us(lp)) // 86400000000 AS rec FROM cb),
mm AS (SELECT min(ts) AS ts0, max(ts) AS ts1, min(tt) AS tt0, max(tt) AS tt1, min(tq) AS tq0, max(tq) AS tq1,
              min(rec) AS r0, max(rec) AS r1 FROM c2),
sc AS (
  SELECT c2.*, ((ts - ts0) / (ts1 - ts0)) * 0.30 + ((ts - ts0) / (ts1 - ts0)) * 0.25
       + (CAST(tt - tt0 AS DOUBLE) / (tt1 - tt0)) * 0.20 + (CAST(tt - tt0 AS DOUBLE) / (tt1 - tt0)) * 0.15
       + (CAST(tq - tq0 AS DOUBLE) / (tq1 - tq0)) * 0.05 + (1.0 - CAST(rec - r0 AS DOUBLE) / (r1 - r0)) * 0.05 AS raw
  FROM c2, mm
),
s2 AS (SELECT *, (raw - (SELECT min(raw) FROM sc)) / ((SELECT max(raw) FROM sc) - (SELECT min(raw) FROM sc)) AS score FROM sc),
qt AS (SELECT quantile_cont(score, 0.4) AS q40, quantile_cont(score, 0.7) AS q70, quantile_cont(score, 0.9) AS q90 FROM s2)
SELECT "CustomerID", rec AS "Recency", tt AS "Frequency", {_rx('ts')} AS "Monetary", tq AS "TotalQuantity",
       {_rx('score')} AS "CustomerScore",
       CASE WHEN score >= q90 THEN 'Platinum' WHEN score >= q70 THEN 'Gold' WHEN score >= q40 THEN 'Silver'
            ELSE 'Bronze' END AS "Tier"
FROM s2, qt""",
    "typical_customer": "WITH " + SCORES + """,
coh AS (SELECT * FROM customers WHERE frequency BETWEEN 5 AND 12 AND recency_days BETWEEN 0 AND 365)
SELECT """ + ", ".join(_rx(f"(SELECT quantile_cont({f}, 0.5) FROM coh)") + f" AS {f}" for f in _PROFILE) + """,
  (SELECT persona FROM coh GROUP BY persona ORDER BY count(*) DESC, persona LIMIT 1) AS persona,
  (SELECT customer_tier FROM coh GROUP BY customer_tier ORDER BY count(*) DESC, customer_tier LIMIT 1) AS customer_tier,
  (SELECT count(*) FROM coh) AS customers""",
})
ORACLE.update({k: _dbl(v) for k, v in _RAW.items() if k not in ORACLE})


_RAW["describe_features"] = "WITH " + FEATURES + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {_rx(f'avg(CAST({c} AS DOUBLE))')} AS mean, "
    f"{_rx(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {_rx(f'min(CAST({c} AS DOUBLE))')} AS min, "
    f"{_rx(f'max(CAST({c} AS DOUBLE))')} AS max FROM features" for c in _CORR_COLS)
ORACLE.update({k: _dbl(v) for k, v in _RAW.items() if k not in ORACLE})
