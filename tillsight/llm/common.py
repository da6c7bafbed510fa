"""Helpers shared by the text operators: skew-safe joins, dense numbering, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.session import materialize

#: A key with more than 1/HEAVY_SHARE of all rows is split; so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 4096

#: ASCII white space, the word separators of all contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def select_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with the text as UTF-8 bytes, null texts as empty.

    Other columns are left behind, so no name of theirs can clash.
    """
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a decision on a row is known by: its id, which may be null or shared, and 128
    bits of its text.  No field is null.  Rows equal in both get equal decisions."""
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    return F.struct(number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"),
                    F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def select_rows(docs: DataFrame) -> DataFrame:
    """``(row, text)``: row keys, and the text as UTF-8 bytes, null texts as empty."""
    return select_text(docs.select(row_key().alias("doc_id"), F.col("text"))).withColumnRenamed("doc_id", "row")


def row_id(row: str = "row") -> Column:
    """The id in a row key, null where the row has none."""
    return F.when(~F.col(f"{row}.no_id"), F.col(f"{row}.id"))


def join_rows(docs: DataFrame, rows: DataFrame, how: str, once: bool = False) -> DataFrame:
    """``docs``, same columns, less the rows whose key is in ``rows.row`` (``left_anti``) or
    is not (``left_semi``); with ``once``, one of the rows with equal key."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, row_key())
    if once:  # before the join: repeated rows meet in the tasks that read them, then in the one shuffle
        keyed = keyed.dropDuplicates([key])
    return keyed.join(rows.select(F.col("row").alias(key)), key, how).select(*[F.col(f"`{c}`") for c in docs.columns])


def portions(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices: what a task holds as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of the Arrow batches of ``df``; ``fn`` may return ``None``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1024):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], count_col: str,
                spread: Sequence[Column], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table`` (unique per ``keys``, ``count_col`` = rows of that key).

    Keys with more than 1/HEAVY_SHARE of all rows -- at most HEAVY_SHARE of them, so
    their list is a broadcast of bounded size -- are cut into salts of that share by a
    hash of ``spread``; ``table`` holds one copy per salt.  All other keys have salt 0.
    ``table`` should be materialized, as it is read three times.
    """
    total = table.agg(F.sum(count_col)).first()[0] or 0
    share = max(1, total // HEAVY_SHARE)
    salts = F.ceil(F.col(count_col) / F.lit(share)).cast("int")
    heavy = table.where(F.col(count_col) > share).select(*keys, salts.alias("__salts"))
    salted = rows.join(F.broadcast(heavy), list(keys), "left").withColumn(
        "__salt", F.when(F.col("__salts").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(*spread), F.col("__salts")).cast("int"))).drop("__salts")
    n = F.when(F.col(count_col) > share, salts).otherwise(F.lit(1))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def dense_ordinals(df: DataFrame, groups: Sequence[str], order: Sequence[str], total: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... without gaps within each ``groups`` value.

    Rows are dealt by (group, hash bucket of ``order``), with about sqrt(total) buckets;
    a bucket's first number is the count of the buckets before it, so no task holds a
    whole group.  ``order`` must tell rows apart; rows equal in it are interchangeable.
    """
    buckets = max(1, int(np.ceil(np.sqrt(max(total, 1)))))
    dealt = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    cell = [*groups, "__b"]
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
              .select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    within = Window.partitionBy(*cell).orderBy(*order)
    numbered = dealt.withColumn("__r", F.row_number().over(within) - 1)
    return numbered.join(starts, cell).withColumn(out, F.col("__start") + F.col("__r")).drop("__b", "__r", "__start")


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges ``(node, smallest node of its component)`` of the links a-b held in one task."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = codes[:len(a)], codes[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``, both long: one row ``(node, root)`` per
    node that has an edge, ``root`` its component's smallest node.

    Alternates two star steps: every node first links its larger neighbours, then its
    smaller ones, to the smallest node it knows.  Each step is an aggregate and a join;
    each round is written to the shared folder.  It ends when a round changes nothing
    (after about log n rounds), never by a round limit.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        """e (u, v): v's neighbour set is grouped by u."""
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = e.join(low, "u")
        if large:
            joined = joined.where(F.col("v") > F.col("u"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def digest(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    pairs = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = digest(pairs)
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = star(both, True)
        down = up.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        pairs = materialize(star(down, False))
        now = digest(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
