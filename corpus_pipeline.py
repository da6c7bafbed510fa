"""From raw documents to packed training sequences.

Five stages, each on all that the one before it kept.  A stage takes (spark, docs, sf_dir)
and returns a DataFrame; all but the last return the columns of ``documents``.  What a
stage returns is written as Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillsight.llm.decontaminate import without_contaminated
from tillsight.llm.line_dedup import without_shared_lines
from tillsight.llm.packing import pack
from tillsight.llm.quality_classifier import without_rejected
from tillsight.llm.simhash import one_per_group
from tillsight.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 9) predicts as 0 go."""
    return without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go (op 1); every document stays."""
    return without_shared_lines(docs, min_docs=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (op 6) the document with the smallest id stays."""
    return one_per_group(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item (op 3) go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 (op 7), one row per piece, with its ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1,
                slice_bytes=2 << 20)  # the workers still hold the classifier's caches


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: Classifier, SimHash and tokenizer have no SQL form: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
