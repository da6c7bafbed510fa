"""Incremental ingestion with Structured Streaming.

The batch cleaning rules applied to a stream of transaction files: the same
casts and filters per micro-batch, exact-duplicate lines dropped within a
watermark (``dropDuplicatesWithinWatermark``), and the monthly revenue table
kept current with ``foreachBatch`` (calendar months are not fixed-length
event-time windows, so each batch writes its monthly totals, added up on reading).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.exprs import month_start
from tillsight.operators.cleaning import clean_transactions

RAW_SCHEMA = T.StructType([
    T.StructField("invoice_id", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("invoice_date", T.TimestampNTZType()), T.StructField("stock_code", T.StringType()),
    T.StructField("product_name", T.StringType()), T.StructField("quantity", T.LongType()),
    T.StructField("unit_price", T.DoubleType()), T.StructField("country", T.StringType()),
])


def stream_transactions(spark: SparkSession, path: str, fmt: str = "parquet", schema=RAW_SCHEMA,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def clean_stream(raw: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Cleaned lines; duplicates are exact repeats seen within the watermark."""
    # watermarks need a zone-aware TIMESTAMP: derive the event time from the line date
    timed = raw.withColumn("_event_time", F.col("invoice_date").cast("timestamp"))
    deduped = timed.withWatermark("_event_time", watermark).dropDuplicatesWithinWatermark(
        [c for c in raw.columns])
    return clean_transactions(deduped.drop("_event_time"), dedupe=False)


def monthly_revenue_sink(store_path: str):
    """``foreachBatch`` function that writes each batch's monthly purchase revenue to a folder
    of its own, ``batch_id=N``.  A replayed batch replaces what it had written, so no batch
    counts twice, and nothing of the others is read or rewritten."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.where(F.col("revenue") > 0).groupBy(month_start(F.col("invoice_date")).alias("month"))
         .agg(F.sum("revenue").alias("revenue")).write.mode("overwrite").parquet(f"{store_path}/batch_id={batch_id}"))

    return write


def monthly_revenue(spark: SparkSession, store_path: str) -> DataFrame:
    """The totals of all batches: (month, revenue)."""
    return spark.read.parquet(store_path).groupBy("month").agg(F.sum("revenue").alias("revenue"))
