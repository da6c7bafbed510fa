"""Customer feature table (one row per customer with a purchase)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.exprs import finite_or_zero, ntz_literal, whole_days

FEATURE_COLUMNS = [
    "customer_id", "recency_days", "frequency", "monetary_value", "avg_order_value",
    "total_items", "first_purchase", "last_purchase", "tenure_days", "purchase_rate",
    "customer_age_days", "return_rate", "product_diversity",
]


def reference_point(tx: DataFrame, as_of=None):
    """``(reference timestamp, any line with revenue > 0)``: one aggregate row.

    The reference is ``as_of`` or the latest line date + 1 day.  A fixed-size
    result, read once on the driver and used as literals downstream.
    """
    row = tx.agg(F.max("invoice_date").alias("mx"), F.max(F.col("revenue") > 0).alias("anyp")).first()
    anyp = bool(row["anyp"]) if row["anyp"] is not None else False
    if as_of is not None:
        return datetime.datetime.fromisoformat(str(as_of)), anyp
    if row["mx"] is None:
        return None, anyp
    return row["mx"] + datetime.timedelta(days=1), anyp


def build_customer_features(tx: DataFrame, as_of=None) -> DataFrame:
    """Behaviour features per customer, in one aggregation over all lines.

    * reference date: ``as_of`` or the latest line date + 1 day (scalar subquery)
    * purchases: lines with revenue > 0 (all lines if the data has none)
    * recency: whole days from the last purchase, >= 0
    * frequency: distinct purchase invoices; monetary: purchase revenue
    * average order value: mean over purchase invoices of their revenue
    * tenure: whole days since the first purchase, >= 1; rate = frequency / tenure x 30
    * return rate: mean of ``is_return`` over all of the customer's lines
    * product diversity: distinct stock codes among purchases (0 without the column)

    Customers with only non-purchase lines do not appear.  The return rate is
    computed in the same aggregate as the rest (conditional aggregates), so the
    line table is shuffled once, by customer, after map-side partial aggregation.
    """
    ref, any_purchase = reference_point(tx, as_of)
    is_p = (F.col("revenue") > 0) | F.lit(not any_purchase)
    p = lambda c: F.when(is_p, c)
    has_stock = "stock_code" in tx.columns
    agg = tx.groupBy("customer_id").agg(
        F.count(p(F.lit(1))).alias("_lines"),
        F.max(p(F.col("invoice_date"))).alias("last_purchase"),
        F.min(p(F.col("invoice_date"))).alias("first_purchase"),
        F.count_distinct(p(F.col("invoice_id"))).alias("frequency"),
        F.sum(p(F.col("revenue"))).alias("monetary_value"),
        F.sum(p(F.col("quantity"))).alias("total_items"),
        F.avg(F.col("is_return").cast("double")).alias("return_rate"),
        (F.count_distinct(p(F.col("stock_code"))) if has_stock else F.lit(0).cast("long")).alias("product_diversity"),
    ).where(F.col("_lines") > 0)
    ref_c = ntz_literal(ref)
    rec = whole_days(ref_c, F.col("last_purchase"))
    ten = whole_days(ref_c, F.col("first_purchase"))
    out = agg.select(
        "customer_id",
        F.greatest(rec, F.lit(0)).alias("recency_days"),
        "frequency",
        "monetary_value",
        F.try_divide(F.col("monetary_value"), F.col("frequency").cast("double")).alias("avg_order_value"),
        "total_items",
        "first_purchase",
        "last_purchase",
        F.greatest(ten, F.lit(1)).alias("tenure_days"),
        "return_rate",
        "product_diversity",
    )
    out = out.withColumn("purchase_rate", F.col("frequency") / F.col("tenure_days") * 30)
    out = out.withColumn("customer_age_days", F.col("tenure_days"))
    doubles = ["monetary_value", "avg_order_value", "purchase_rate", "return_rate"]
    out = out.withColumns({c: finite_or_zero(F.col(c)) for c in doubles})
    return out.select(*FEATURE_COLUMNS)
