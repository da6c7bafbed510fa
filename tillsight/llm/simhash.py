"""SimHash near-dedup by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import (
    HEAVY_SHARE, components, join_rows, local_components, map_rows, row_id, salted_join, select_rows, select_text)
from tillsight.session import materialize, shuffle_partitions

BITS, XX_SEED = 64, 42
#: Rows and pairs that a comparing task handles at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 2_000_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the XXH64 of word shingles, repeats included; 0 for no words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(joined, XX_SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a:b], XX_SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


class Covering:
    """A code of anchors over ``width`` bits, each value within one bit of an anchor.

    The anchors are a perfect Hamming code on the low 2^m - 1 bits (the largest that
    fits), with the remaining bits free: covering radius 1.  A value's syndrome tells
    which flips lead to anchors, so neither anchors nor neighbours are searched.
    """

    def __init__(self, width: int, threshold: int):
        self.width = width
        self.coded = (1 << (width + 1).bit_length() - 1) - 1
        masks = [sum(1 << b for b in flips) for r in range(threshold + 2) for flips in combinations(range(width), r)]
        syndromes = [self._syndrome(m) for m in masks]
        self.reach = [np.array([m for m, s in zip(masks, syndromes, strict=True) if s == k], "u8")
                      for k in range(self.coded + 1)]  # masks come in order of their bits

    def _syndrome(self, value: int) -> int:
        s = 0
        for b in range(self.coded):
            if value >> b & 1:
                s ^= b + 1
        return s

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        s = np.zeros(len(values), "i8")
        for b in range(self.coded):
            s ^= np.where(values >> np.uint64(b) & np.uint64(1), b + 1, 0)
        return s

    def anchors(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(rows, anchors, home)``: every anchor within 1 + threshold bits of a value,
        and whether it is the value's home, the anchor at most 1 bit away."""
        s = self.syndromes(values)
        for k, masks in enumerate(self.reach):
            rows = np.flatnonzero(s == k)
            if len(rows):
                found = values[rows][:, None] ^ masks[None, :]
                home = np.zeros(found.shape, bool)
                home[:, 0] = True  # the lightest mask of syndrome k: none, or the one bit k
                yield np.repeat(rows, len(masks)), found.ravel(), home.ravel()


def compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links found at anchors; rows are sorted by ``key``.

    At each anchor its home fingerprints meet all that were sent there.  Pairs are made
    in blocks, and links of a block are reduced to one edge per fingerprint at once.
    """
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    group = np.repeat(np.arange(len(first)), size)
    homes = np.flatnonzero(home & (size[group] > 1))
    n = size[group[homes]]
    begin = first[group[homes]]
    found_a, found_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    upto = np.cumsum(n)
    at = 0
    while at < len(homes):
        base = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, "right")))
        m = n[at:end]
        left = np.repeat(fp[homes[at:end]], m)
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        right = fp[np.repeat(begin[at:end], m) + within]
        near = (np.bitwise_count((left ^ right).view("u8")) <= max_bits) & (left != right)
        if near.any():
            a, b = local_components(left[near], right[near])
            found_a.append(a)
            found_b.append(b)
        at = end
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return local_components(a, b) if len(a) else (a, b)


def linked_fingerprints(nodes: DataFrame, max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """``(a, b)``: links that join all fingerprints ``nodes.fp`` (distinct) at most
    ``max_bits`` apart into the right components; exact, and without all pairs.

    The bits are cut into ``blocks``.  Two fingerprints at most ``max_bits`` apart differ
    in at most t = max_bits // blocks bits of some block.  On each block a covering code
    of radius 1 gives the anchors; a fingerprint is sent to every anchor within 1 + t of
    its block, and the home fingerprints of an anchor are compared with all sent there:
    that meets every such pair.  Fewer, wider blocks make smaller groups at the price of
    more copies: three suit 10^5 to 10^8 fingerprints (about 44 copies each), two more
    (312 copies, 2^27 anchors).

    Anchors that are home to over 1/HEAVY_SHARE of the fingerprints -- HEAVY_SHARE a block
    at most, a bounded list -- have their home side split and the others sent to each part.
    """
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    shifts = [sum(widths[:i]) for i in range(blocks)]
    codes = [Covering(w, max_bits // blocks) for w in widths]

    def part(fp: np.ndarray, i: int) -> np.ndarray:
        return fp >> np.uint64(shifts[i]) & np.uint64((1 << widths[i]) - 1)

    def home_keys(batch):
        fp = batch["fp"].to_numpy().view("u8")
        keys = []
        for i, code in enumerate(codes):
            for _, found, home in code.anchors(part(fp, i)):
                keys.append(found[home].view("i8") | i << 48)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    total = nodes.count()
    share = max(1, total // HEAVY_SHARE)
    heavy = (map_rows(nodes.select("fp"), home_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > max(share, 1000)).orderBy("key").toPandas())
    heavy_key = heavy["key"].to_numpy("i8")
    heavy_parts = -(-heavy["n"].to_numpy("i8") // max(share, 1000))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 2000):
                fp = batch["fp"].to_numpy()[cut:cut + 2000].view("u8")
                for i, code in enumerate(codes):
                    for rows, found, home in code.anchors(part(fp, i)):
                        key, own = found.view("i8") | i << 48, fp[rows]
                        salt = np.zeros(len(key), "i4")
                        if len(heavy_key):
                            at = np.minimum(np.searchsorted(heavy_key, key), len(heavy_key) - 1)
                            parts = np.where(heavy_key[at] == key, heavy_parts[at], 1)
                            mine = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).view("i8") % parts
                            rows_of = np.repeat(np.arange(len(key)), parts)
                            salt = (np.arange(len(rows_of)) - np.repeat(np.cumsum(parts) - parts, parts)).astype("i4")
                            key, own = key[rows_of], own[rows_of]
                            home = home[rows_of] & (salt == mine[rows_of])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(salt), pa.array(own.view("i8")), pa.array(home)],
                            names=["key", "salt", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(cols):
            a, b = compare(cols[0] * 1_000_003 + cols[1], cols[2], cols[3], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append([batch[c].to_numpy(zero_copy_only=False) for c in ("key", "salt", "fp", "home")])
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
                end = rows - int(last.sum())
                if end:
                    yield edges([x[:end] for x in cols])
                held, rows = [[x[end:] for x in cols]], rows - end
        if rows:
            yield edges([np.concatenate(x) for x in zip(*held, strict=True)])

    sent = nodes.select("fp").mapInArrow(send, "key long, salt int, fp long, home boolean")
    n = max(shuffle_partitions(nodes.sparkSession), total // 20_000)
    return (sent.repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
            .mapInArrow(meet, "a long, b long"))


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row: the SimHash as a long, and
    the smallest id reachable over links of at most ``max_bits`` differing bits.

    Equal fingerprints are one node, so a group of copies of any size costs one row in
    the comparison; components are found by star steps on DataFrames.

    Null and empty texts have fingerprint 0 and link like any other.  Repeated rows stay.
    Null ids are never a component's id unless all its ids are null.  An empty table
    gives no rows.
    """
    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return _grouped(src.withColumnRenamed("doc_id", "row"), F.col("row"), shingle, max_bits, blocks).select(
        F.col("row").alias("doc_id"), "fp", "component_id")


def _grouped(src: DataFrame, doc_id: Column, shingle: int, max_bits: int, blocks: int = 3) -> DataFrame:
    """``(row, fp, root, component_id)`` of ``(row, text)``; ``doc_id`` is the id in ``row``
    and ``root`` the component's smallest fingerprint."""
    def hashes(batch):
        fps = np.array([fingerprint(x, shingle) for x in batch["text"].to_pylist()], "u8").view("i8")
        return pa.RecordBatch.from_arrays([batch["row"], pa.array(fps)], names=["row", "fp"])

    prints = materialize(map_rows(src, hashes, T.StructType([src.schema["row"], T.StructField("fp", T.LongType())])))
    nodes = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(linked_fingerprints(nodes, max_bits, blocks))
    rooted = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")))
    classes = materialize(salted_join(rooted.select("fp", "n", "root"), least, ["root"], "m", [F.col("fp")])
                          .select("fp", "n", "root", "component_id"))
    # rows are numbered as the files hold them: repeated rows, null ids too, are spread
    return salted_join(prints, classes, ["fp"], "n", [F.monotonically_increasing_id()]).select(
        "row", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` reduced to one row of each SimHash group, one with the smallest id (null ids
    last; of unlike texts with that id, the one with the least hash).  Same columns.  Rows
    of different groups all stay, whether they share an id or have none."""
    groups = _grouped(select_rows(docs), row_id(), shingle, max_bits)
    return join_rows(docs, groups.groupBy("root").agg(F.min("row").alias("row")), "left_semi", once=True)


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs, shingle=4, max_bits=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
