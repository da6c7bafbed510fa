"""Line dedup: lines that many documents share are dropped everywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import LOWER, SPACE, UPPER, portions, salted_join
from tillsight.session import materialize


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hashable(kind: T.DataType) -> bool:
    """No map or variant anywhere in it."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _hashes(key: Column) -> list[Column]:
    """128 bits in two columns: at 10^11 lines 64 would let a few unlike lines meet."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _drop(batches):
    for batch in portions(batches):
        n_lines, n_dropped, kept = [], [], []
        for text, dropped in zip(batch["text"].to_pylist(), batch["dropped"].to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = set(dropped or ())
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
        yield pa.RecordBatch.from_arrays(
            [batch["row"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])


def _dedup(docs: DataFrame, row: Column, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """``(row, n_lines, n_dropped, kept_text)``; ``row`` is a struct carried along."""
    src = docs.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    keys = src.select(F.explode(F.array_distinct(F.transform(lines, _key))).alias("key"))
    shared = materialize(
        keys.where(F.char_length("key") >= min_chars).select(*_hashes(F.col("key")))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))

    # equal texts drop the same lines, so rows with equal hashes may share one list of
    # positions; the other columns only spread copies (maps have no hash)
    others = [F.col("row")[f.name] for f in src.schema["row"].dataType.fields if _hashable(f.dataType)]
    src = src.withColumns({"text_hash": F.xxhash64("text"), "row_hash": F.xxhash64(F.lit(1), "text", *others)})
    placed = (src.select("row_hash", "text_hash", F.posexplode(lines).alias("pos", "line"))
              .select("row_hash", "text_hash", "pos", _key(F.col("line")).alias("key"))
              .where(F.char_length("key") >= min_chars).select("row_hash", "text_hash", "pos", *_hashes(F.col("key"))))
    dropped = (salted_join(placed, shared, ["h1", "h2"], "n", [F.col("row_hash"), F.col("pos")])
               .groupBy("row_hash", "text_hash").agg(F.collect_set("pos").alias("dropped")))
    joined = (src.withColumn("text", F.col("text").cast("binary"))
              .join(dropped, ["row_hash", "text_hash"], "left").select("row", "text", "dropped"))
    kept = T.StructType([joined.schema["row"], T.StructField("n_lines", T.LongType()),
                         T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_drop, kept)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)``, one row per input row.

    Lines are split at ``\\n`` and keyed by their text without white space at both ends,
    A-Z lower-cased.  A key of at least ``min_chars`` characters found in at least
    ``min_docs`` documents loses all its lines; the rest is joined again in order.

    Two passes over the text: the first counts documents per key hash (each document
    names a key once, partial sums before the shuffle); the second joins hashes and
    positions, not the text, with the frequent hashes -- the hottest ones salted --
    and gathers the positions to drop per document.  The text crosses one shuffle.

    Every input row is a document of its own, repeated rows too.  A null text counts as
    empty: one empty line, kept.  A null id is kept.  An empty table gives no rows.
    """
    out = _dedup(docs, F.struct(F.col(id_col).alias("doc_id")), text_col, min_docs, min_chars)
    return out.select("row.doc_id", "n_lines", "n_dropped", "kept_text")


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs``, same columns and rows, with the shared lines gone from ``text``;
    ``n_chars`` is counted anew where lines went.  A document all of whose lines are
    shared stays with an empty text."""
    others = [c for c in docs.columns if c != "text"]
    held = {c: f"c{i}" for i, c in enumerate(others)}  # names may hold dots
    row = F.struct(*[F.col(f"`{c}`").alias(k) for c, k in held.items()]) if others else F.struct(F.lit(0).alias("c0"))
    out = _dedup(docs, row, "text", min_docs, min_chars)
    made = {c: F.col(f"row.{k}").alias(c) for c, k in held.items()}
    made["text"] = F.col("kept_text").alias("text")
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text")).otherwise(
            F.col(f"row.{held['n_chars']}")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[made[c] for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
shared AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, shared.key IS NOT NULL AS gone FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
