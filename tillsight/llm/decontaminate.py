"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm.common import join_rows, portions, select_rows, select_text

#: Token positions that a seed looks at; the others may hold any token.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 8))
#: Items of fewer tokens have masks of their own length, see ``_short_masks``.
SHORT = 8
#: An aligned stretch counts if, of so many tokens (or the whole item, if shorter), this share agrees.
STRETCH, SHARE = 13, 0.8
#: Tokens of test items held by one broadcast block (about 100 bytes each).
BLOCK_TOKENS = 400_000

_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SPANS = ("item_id", "start", "end", "n_equal")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.decode("utf-8", "replace").lower().encode().translate(_TO_SPACE).split()


def _seeds(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash for each window of ``ids`` under ``mask``; 0 where it meets an unknown token."""
    n = len(ids) - mask[-1]
    h, known = np.zeros(n, "u8"), np.ones(n, bool)
    for k in mask:
        part = ids[k:k + n]
        known &= part > 0
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29)) ^ part.astype("u8")
    return np.where(known, h | np.uint64(1), np.uint64(0))


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` < SHORT tokens: of 5 to 7 tokens SHARE lets one be changed, so
    each mask leaves one position out and some mask meets whichever that is; below, the whole item."""
    if (n - 1) < SHARE * n:
        return [tuple(range(n))]
    return [tuple(k for k in range(n) if k != out) for out in range(n)]


class TestBlock:
    """Some test items: vocabulary, token ids and sorted seeds."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids, self.ids = [], []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], "i4")
            if len(ids):
                self.item_ids.append(item_id)
                self.ids.append(ids)
        # each mask with the lengths of the items it is for
        longest = max(map(len, self.ids), default=0)
        masks = [(mask, SHORT, longest) for mask in MASKS]
        masks += [(mask, n, n) for n in sorted({len(ids) for ids in self.ids if len(ids) < SHORT}) for mask in _short_masks(n)]
        self.masks, self.seeds = [mask for mask, _, _ in masks], []
        for mask, least, most in masks:
            hashes, owner, place = [np.zeros(0, "u8")], [np.zeros(0, "i4")], [np.zeros(0, "i4")]
            for i, ids in enumerate(self.ids):
                if least <= len(ids) <= most and len(ids) > mask[-1]:
                    h = _seeds(ids, mask)
                    hashes.append(h)
                    owner.append(np.full(len(h), i, "i4"))
                    place.append(np.arange(len(h), dtype="i4"))
            h, o, p = (np.concatenate(x) for x in (hashes, owner, place))
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], o[order], p[order]))

    def spans(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """``(item, start, end, n_equal)``: aligned stretches of ``text``, in tokens."""
        find = self.vocabulary.get
        ids = np.array([find(w, 0) for w in tokens(text)], "i4")
        owners, shifts = [], []
        for mask, (hashes, owner, place) in zip(self.masks, self.seeds, strict=True):
            if len(ids) <= mask[-1] or not len(hashes):
                continue
            h = _seeds(ids, mask)
            where = np.flatnonzero(h)
            low = np.searchsorted(hashes, h[where], "left")
            n = np.searchsorted(hashes, h[where], "right") - low
            where, low, n = where[n > 0], low[n > 0], n[n > 0]
            hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owners.append(owner[hit])
            shifts.append(np.repeat(where, n) - place[hit])
        if not owners or not sum(map(len, owners)):
            return []
        out = []
        for i, shift in np.unique(np.stack([np.concatenate(owners), np.concatenate(shifts)], 1), axis=0).tolist():
            item = self.ids[i]
            a, b = max(0, shift), min(len(ids), shift + len(item))
            equal = (ids[a:b] == item[a - shift:b - shift]).astype("i8")
            w = min(STRETCH, len(item))
            if len(equal) < w:
                continue
            total = np.concatenate(([0], np.cumsum(equal)))
            good = total[w:] - total[:-w] >= SHARE * w
            if not good.any():
                continue
            edge = np.diff(np.concatenate(([0], good.astype("i1"), [0])))
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + w - 1).tolist(), strict=True):
                hits = np.flatnonzero(equal[s:e])
                out.append((i, a + s + int(hits[0]), a + s + int(hits[-1]) + 1, len(hits)))
        return out


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, end, n_equal)``: stretches of a document that repeat a
    test item, substitutions allowed; positions count tokens.

    Every window of a document and of a test item is hashed under each mask of MASKS,
    which skips some positions, so a changed token spoils only seeds that look at it.
    Equal hashes give an alignment; it counts where, of STRETCH aligned tokens (the whole
    item if it is shorter), the share SHARE agrees.  Of items of 5 to 7 tokens one
    token may differ, at any place; shorter ones must occur whole.

    The test items are the query set: they are taken in blocks of about BLOCK_TOKENS
    tokens, dealt by hash, and each block is broadcast and held against all documents.
    So the documents are never shuffled, and a test set of any size needs no more memory.

    Null or empty texts and items match nothing.  Null ids are passed on.  Repeated rows
    give repeated spans.
    """
    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return _spans(src.withColumnRenamed("doc_id", "row"), benchmark, item_id_col, item_text_col).withColumnRenamed(
        "row", "doc_id")


def _spans(src: DataFrame, benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(row, item_id, start, end, n_equal)`` of ``(row, text)``."""
    spark = src.sparkSession
    schema = T.StructType([src.schema["row"], *(T.StructField(c, T.LongType()) for c in SPANS)])
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"),
                             F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-size // BLOCK_TOKENS) or 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = items.where(F.col("block") == b).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(TestBlock([(r["item_id"], r["text"].encode()) for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in portions(batches):
                found = [(at, block.item_ids[i], s, e, n) for at, text in enumerate(batch["text"].to_pylist())
                         for i, s, e, n in block.spans(text)]
                if found:
                    at, *spans = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch["row"].take(at), *spans], names=["row", *SPANS])

        part = src.mapInArrow(scan, schema)
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat a test item; same columns.  Each row is judged
    by its own text, rows that share an id or have none too."""
    return join_rows(docs, _spans(select_rows(docs), benchmark).select("row").distinct(), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document and test item that it repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return spans.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum("n_equal").alias("n_equal"))
