"""Sharding: groups of equal texts go whole into shards of near-equal bytes."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import dense_ordinals, map_rows, salted_join, select_text
from tillsight.llm.trees import BalancedTree
from tillsight.session import materialize

#: Groups of at least 1/(UNITS * shards) of all bytes are placed one by one; smaller ones
#: are first packed into parcels of that size.
UNITS = 256
#: Groups packed by one task, at first; and the most tasks, which bounds the parcels.
TASK_GROUPS, MOST_TASKS = 20_000, 4096

GROUP = ["size", "text_crc32", "text_hash"]


def best_fit_decreasing(sizes, capacity: int) -> list[int]:
    """A bin for each size: largest first, each into the fullest bin that has room.

    Open bins lie in a balanced tree by (room, bin).  A size over ``capacity`` gets a bin
    of its own.  Equal sizes keep their order.
    """
    bins, room = [0] * len(sizes), BalancedTree()
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = room.ceiling((sizes[i], -1))
        if fit is None:
            left, bins[i] = capacity - sizes[i], n
            n += 1
        else:
            room.delete(fit)
            left, bins[i] = fit[0] - sizes[i], fit[1]
        if left > 0:
            room.insert((left, bins[i]))
    return bins


def equal_shards(sizes, n_shards: int) -> list[int]:
    """Best-fit decreasing into ``n_shards`` bins of the least capacity that holds all.

    A size over the mean of what is left takes a shard alone; the capacity for the rest
    is the mean plus the least tried slack that needs no further bin.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    shards, rest, free = [0] * len(sizes), sum(sizes), n_shards
    while order and free > 1 and sizes[order[0]] * free > rest:
        i = order.pop(0)
        free -= 1
        shards[i] = free
        rest -= sizes[i]
    mine = [sizes[i] for i in order]
    mean = -(-rest // free)
    low, high, best = 0, 1, None
    step = 0
    while True:  # widen the slack until all fits, then halve the range it lies in
        capacity = mean + step
        got = best_fit_decreasing(mine, capacity)
        if not got or max(got) < free:
            best, high = got, step
            break
        low, step = step, max(1, step * 4, mean // 100_000)
    for _ in range(8):
        if high - low <= max(1, mean // 100_000):
            break
        step = (low + high) // 2
        got = best_fit_decreasing(mine, mean + step)
        if max(got) < free:
            best, high = got, step
        else:
            low = step
    for i, b in zip(order, best, strict=True):
        shards[i] = b
    return shards


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: a row's size is its text's UTF-8 bytes
    plus 1, rows of equal texts share a shard, shards are near equal in bytes, and slots
    number a shard's rows from 0 without gaps.

    Best-fit decreasing runs in two levels, so that no task sees all groups.  Groups are
    dealt by hash to tasks; each task packs its groups into parcels of total/(UNITS *
    n_shards) bytes.  The driver then packs parcels and the few larger groups: at most
    3 * UNITS * n_shards + MOST_TASKS sizes, however large the input.  Equal texts are
    told by size, CRC-32 and XXH64; should two texts agree in all three, they only share
    a shard.  A group that alone exceeds the mean keeps its shard to itself; it can't be cut.

    Null text: size 1, grouped with empty ones.  Null ids and repeated rows are rows like
    others.  An empty table gives no rows.
    """
    def measure(batch):
        text = batch["text"].to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(x) + 1 for x in text], pa.int64()),
             pa.array([zlib.crc32(x) for x in text], pa.int64()), batch["text_hash"]],
            names=["doc_id", *GROUP])

    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows = materialize(map_rows(src.withColumn("text_hash", F.xxhash64("text")), measure,
                                "doc_id long, size long, text_crc32 long, text_hash long"))
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    stats = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, n_rows = stats[0] or 0, stats[1]
    unit = max(1, total // (UNITS * n_shards))
    tasks = min(MOST_TASKS, max(64, -(-n_rows // TASK_GROUPS)))
    groups = materialize(groups.withColumn("task", F.when(F.col("bytes") < unit, F.pmod(
        F.xxhash64(*GROUP), F.lit(tasks)).cast("int")).otherwise(-1)))

    def parcels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(GROUP).reset_index(drop=True)
        return pdf.assign(parcel=best_fit_decreasing(pdf["bytes"].tolist(), unit))

    small = groups.where("task >= 0").groupBy("task").applyInPandas(
        parcels, groups.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", parcel long")
    large = groups.where("task < 0").withColumn("parcel", F.xxhash64(*GROUP))
    packed = materialize(small.union(large))
    items = packed.groupBy("task", "parcel").agg(F.sum("bytes").alias("bytes")).orderBy("task", "parcel").toPandas()
    items["shard"] = equal_shards(items["bytes"].tolist(), n_shards)
    spark = docs.sparkSession
    to_shard = spark.createDataFrame(items[["task", "parcel", "shard"]].astype("int64"),
                                     "task long, parcel long, shard long") if len(items) else \
        spark.createDataFrame([], "task long, parcel long, shard long")
    placed = materialize(packed.join(F.broadcast(to_shard), ["task", "parcel"]).select(
        *GROUP, "n", F.col("shard").cast("int").alias("shard")))
    dealt = salted_join(rows, placed, GROUP, "n", [F.col("doc_id")]).drop("n")
    return dense_ordinals(dealt, ["shard"], ["doc_id", *GROUP], n_rows, "slot")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
