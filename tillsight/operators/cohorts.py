"""Monthly cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions.exprs import month_start


def cohort_retention(tx: DataFrame) -> DataFrame:
    """Cohort = month of a customer's first purchase; period = months since.

    One shuffle by customer collects the customer's distinct purchase months
    (bounded by the number of months in the data, whatever the customer's
    line count), then the small (cohort, period) table is counted.
    """
    months = (tx.where(F.col("revenue") > 0)
              .select("customer_id", month_start(F.col("invoice_date")).alias("m"))
              .groupBy("customer_id")
              .agg(F.array_distinct(F.collect_set("m")).alias("ms")))
    per = months.select(
        "customer_id", F.array_min("ms").alias("cohort"), F.explode("ms").alias("m"))
    per = per.withColumn("period", F.months_between("m", "cohort").cast("int"))
    counts = per.groupBy("cohort", "period").agg(F.count(F.lit(1)).alias("active_customers"))
    base = F.max(F.when(F.col("period") == 0, F.col("active_customers"))).over(Window.partitionBy("cohort"))
    return counts.select(
        F.date_format("cohort", "yyyy-MM").alias("cohort_month"),
        "period",
        "active_customers",
        F.round(F.col("active_customers") / base * 100, 1).alias("retention_rate"),
    )


def cohort_summary(retention: DataFrame) -> DataFrame:
    """Per cohort: customers at period 0, customers and rate at the last observed
    period, and that period."""
    return retention.groupBy("cohort_month").agg(
        F.min_by("active_customers", "period").alias("starting_customers"),
        F.max_by("active_customers", "period").alias("latest_customers"),
        F.max_by("retention_rate", "period").alias("latest_retention"),
        F.max("period").alias("observed_periods"),
    )
