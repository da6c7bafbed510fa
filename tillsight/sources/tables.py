"""Readers for the benchmark parquet tables and their mapping to transactions.

The retail operators work on one canonical transaction schema:
``invoice_id, customer_id, invoice_date, stock_code, product_name, quantity,
unit_price, country``.  The star-schema tables map onto it as

* invoice_id   = order key as text
* customer_id  = order's customer key as text
* invoice_date = order date (TIMESTAMP_NTZ)
* stock_code / product_name = part key as text / part name
* quantity     = line quantity, negated for returned lines (flag ``R``)
* unit_price   = extended price / quantity
* country      = customer's nation name
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level transactions in the canonical (pre-cleaning) schema.

    Join order: orders are enriched with the customer's nation first (orders
    are far smaller than lines), then lines join orders on the order key and
    parts on the part key.  ``nation`` has a fixed 25 rows, so it is the only
    explicit broadcast; the other joins are left to AQE, which switches to a
    broadcast only when the runtime size is under the threshold.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    cust_nation = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey)
    orders_x = orders.join(cust_nation, orders.o_custkey == cust_nation.c_custkey)
    lines = li.join(orders_x, li.l_orderkey == orders_x.o_orderkey).join(
        part, li.l_partkey == part.p_partkey)
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("invoice_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("product_name"),
        qty.cast("long").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("n_name").alias("country"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` stream as transactions (user = customer, one event = one line)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("invoice_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("invoice_date"),
        F.col("event_type").alias("stock_code"),
        F.col("event_type").alias("product_name"),
        F.lit(1).cast("long").alias("quantity"),
        F.col("value").alias("unit_price"),
        F.lit("Unknown").alias("country"),
    )


STRICT_NAMES = {"invoice_id": "Invoice", "product_name": "Description", "quantity": "Quantity",
                "invoice_date": "InvoiceDate", "unit_price": "Price", "customer_id": "Customer ID",
                "country": "Country"}


def strict_raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines under the title-case contract (Invoice, Description, ...)."""
    raw = raw_transactions(spark, sf_dir)
    return raw.select(*[F.col(c).alias(STRICT_NAMES[c]) for c in raw.columns if c in STRICT_NAMES])
