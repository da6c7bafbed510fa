"""Registered queries of the sources, column mapping and strict checks, with their SQL.

Files and stored tables are written from the given tables to the shared folder and read
again; the SQL computes the same figures from the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillsight.operators import cleaning, mapping, series
from tillsight.operators import reports as _rep
from tillsight.plans import catalog as c
from tillsight.plans.oracle import SCORES, TX, _dbl, _rx, _STRICT
from tillsight.session import ensure_checkpoint_dir
from tillsight.sources import files, tables

EXPORT_NAMES = {"invoice_id": "InvoiceNo", "customer_id": "CustomerID", "invoice_date": "InvoiceDate", "stock_code": "StockCode",
                "product_name": "Description", "quantity": "Qty", "unit_price": "Price", "country": "Country"}
FOREIGN_NAMES = {"invoice_id": "Invoice Ref", "customer_id": "Client Number", "invoice_date": "Purchase Day", "stock_code": "SKU",
                 "product_name": "Item Name", "quantity": "Units Sold", "unit_price": "Selling Price", "country": "Country"}
STRICT_FOREIGN = {"Invoice": "Invoice No", "Description": "Product Name", "Quantity": "QTY", "InvoiceDate": "Sale Date",
                  "Price": "Unit Price", "Customer ID": "Customer Number", "Country": "Market"}
TIERS, PERSONAS = ["Gold", "Silver"], ["Loyal customers", "At-risk customers"]


def _renamed(df, names):
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def _fresh(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillsight-{kind}-{uuid.uuid4().hex}"


def _figures(tx, by: str):
    return c._out(tx.groupBy(by).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("units"), F.sum("revenue").alias("revenue"),
        F.min("invoice_date").cast("date").alias("first_day"), F.max("invoice_date").cast("date").alias("last_day")))


def _figures_sql(by: str) -> str:
    return "WITH " + TX + f"""
SELECT {by}, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units, {_rx('sum(revenue)')} AS revenue,
       CAST(min(invoice_date) AS DATE) AS first_day, CAST(max(invoice_date) AS DATE) AS last_day FROM tx GROUP BY 1"""


def q_csv_import(spark, sf_dir):
    """All transactions exported under other headers, read as text, cleaned."""
    path = files.write_csv(_renamed(tables.raw_transactions(spark, sf_dir), EXPORT_NAMES), _fresh(spark, "csv"))
    return _figures(cleaning.clean_transactions(files.read_csv(spark, path)), "customer_id")


def q_json_import(spark, sf_dir):
    """The same through JSON lines."""
    path = _fresh(spark, "json")
    _renamed(tables.raw_transactions(spark, sf_dir), EXPORT_NAMES).write.json(path)
    return _figures(cleaning.clean_transactions(files.read_json(spark, path, multi_line=False)), "stock_code")


def q_stored_tables(spark, sf_dir):
    """Tables saved (one replaced), listed and loaded."""
    store = files.TableStore(spark, _fresh(spark, "store"))
    tx = c.transactions(spark, sf_dir)
    store.save("transactions", tx.where("is_return = 1"))
    store.save("transactions", tx, partition_by=["country"])
    store.save("returns", store.load("transactions").where("is_return = 1"))
    out = None
    for name in store.list():
        t = store.load(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("lines"),
                                 F.count_distinct("country").alias("countries"))
        out = t if out is None else out.unionByName(t)
    return out


def q_mapped_import(spark, sf_dir):
    """Foreign headers, by alias and by likeness, one of them by the caller's override."""
    mapped, _, missing = mapping.auto_map_transaction_schema(
        _renamed(tables.raw_transactions(spark, sf_dir), FOREIGN_NAMES), overrides={"Selling Price": "unit_price"})
    if missing:
        raise ValueError(f"not mapped: {missing}")
    return _figures(cleaning.clean_transactions(mapped), "country")


def q_merged_columns(spark, sf_dir):
    """Of two columns that map to one name the first non-null value counts."""
    raw = tables.raw_transactions(spark, sf_dir)
    two = raw.select(F.when(F.col("quantity") > 25, F.col("quantity")).alias("Qty"), F.lit(-1).cast("long").alias("units"),
                     F.col("country").alias("Country"))
    return mapping.normalize_columns(two).groupBy("country").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


def q_strict_report(spark, sf_dir):
    """Foreign headers renamed to the title-case contract, then its counts."""
    return cleaning.strict_validation(_renamed(tables.strict_raw_transactions(spark, sf_dir), STRICT_FOREIGN))[0]


def q_strict_numbers(spark, sf_dir):
    """Required columns in order, numbers checked."""
    kept = mapping.require_columns(tables.strict_raw_transactions(spark, sf_dir), ["Customer ID", "Quantity", "Price"])
    return c._out(cleaning.strict_numeric(kept, ["Quantity", "Price"]).groupBy("Customer ID").agg(
        F.sum("Quantity").alias("units"), F.max("Price").alias("highest_price")))


def q_sanitized_features(spark, sf_dir):
    """C11: the model features, nothing missing or infinite."""
    return c._out(cleaning.sanitize_features(c.customers(spark, sf_dir), _rep.PROFILE_FEATURES))


def q_date_parts(spark, sf_dir):
    """Lines per year, month, day, hour and weekday."""
    parts = ["year", "month", "day", "hour", "weekday"]
    return cleaning.date_parts(c.transactions(spark, sf_dir)).groupBy(*parts).agg(F.count(F.lit(1)).alias("lines"))


def q_filtered_customers(spark, sf_dir):
    """customers of the chosen personas and tiers, from a least health on."""
    return c._out(_rep.filter_customers(c.customers(spark, sf_dir), PERSONAS, TIERS, 40.0).select(
        "customer_id", "persona", "customer_tier", "health_score"))


def q_backfilled_deviation(spark, sf_dir):
    """The 3-month deviation, its first months filled from the next."""
    rolled = series.rolling_calendar(c.strict_month_end(spark, sf_dir)).select("InvoiceDate", "RollingStd_3")
    return c._out(series.backfill(rolled, "RollingStd_3", "InvoiceDate"))


QUERIES = {
    "csv_import": q_csv_import, "json_import": q_json_import, "stored_tables": q_stored_tables,
    "mapped_import": q_mapped_import, "merged_columns": q_merged_columns, "strict_report": q_strict_report,
    "strict_numbers": q_strict_numbers, "sanitized_features": q_sanitized_features, "date_part_counts": q_date_parts,
    "filtered_customers": q_filtered_customers, "backfilled_deviation": q_backfilled_deviation,
}

_STRICT_RAW = "WITH " + _STRICT


def _chosen(names: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in names)


_RAW = {
    "csv_import": _figures_sql("customer_id"),
    "json_import": _figures_sql("stock_code"),
    "mapped_import": _figures_sql("country"),
    "stored_tables": "WITH " + TX + """
SELECT 'transactions' AS name, count(*) AS lines, count(DISTINCT country) AS countries FROM tx
UNION ALL SELECT 'returns', count(*), count(DISTINCT country) FROM tx WHERE is_return = 1""",
    "merged_columns": "WITH " + TX + """
SELECT country, count(*) AS lines, CAST(sum(CASE WHEN quantity > 25 THEN quantity ELSE -1 END) AS BIGINT) AS units FROM raw GROUP BY 1""",
    "strict_report": _STRICT_RAW + """
SELECT count(*) AS rows, count(*) FILTER ("InvoiceDate" IS NULL) AS bad_dates, count(*) FILTER ("Quantity" IS NULL) AS bad_quantity,
       count(*) FILTER ("Quantity" <= 0) AS nonpositive_quantity, count(*) FILTER ("Price" IS NULL) AS bad_price,
       count(*) FILTER ("Price" <= 0) AS nonpositive_price, count(*) FILTER ("Customer ID" IS NULL) AS null_customer,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sraw)) AS duplicates FROM sraw""",
    "strict_numbers": _STRICT_RAW + f"""
SELECT "Customer ID", {_rx('sum(CAST("Quantity" AS DOUBLE))')} AS units, {_rx('max(CAST("Price" AS DOUBLE))')} AS highest_price
FROM sraw GROUP BY 1""",
    "sanitized_features": "WITH " + SCORES + " SELECT " + ", ".join(
        f"{_rx(f'coalesce(CAST({x} AS DOUBLE), 0.0)')} AS {x}" for x in _rep.PROFILE_FEATURES) + " FROM customers",
    "date_part_counts": "WITH " + TX + """
SELECT CAST(year(invoice_date) AS INTEGER) AS year, CAST(month(invoice_date) AS INTEGER) AS month,
       CAST(day(invoice_date) AS INTEGER) AS day, CAST(hour(invoice_date) AS INTEGER) AS hour,
       CAST(isodow(invoice_date) - 1 AS INTEGER) AS weekday, count(*) AS lines FROM tx GROUP BY ALL""",
    "filtered_customers": "WITH " + SCORES + f"""
SELECT customer_id, persona, customer_tier, {_rx('health_score')} AS health_score FROM customers
WHERE persona IN ({_chosen(PERSONAS)}) AND customer_tier IN ({_chosen(TIERS)}) AND health_score >= 40""",
    "backfilled_deviation": _STRICT_RAW + f""",
sd AS (SELECT "InvoiceDate", CASE WHEN count("Sales") OVER w = 3 THEN stddev_samp("Sales") OVER w END AS s FROM monthend
       WINDOW w AS (ORDER BY "InvoiceDate" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
bf AS (SELECT "InvoiceDate", first_value(s IGNORE NULLS) OVER (ORDER BY "InvoiceDate" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM sd)
SELECT "InvoiceDate", {_rx('s')} AS "RollingStd_3" FROM bf""",
}
ORACLE = {k: _dbl(v) for k, v in _RAW.items()}
