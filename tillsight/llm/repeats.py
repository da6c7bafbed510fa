"""Repeated byte strings: induced sorting from sampled suffixes, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import portions, salted_join, select_text
from tillsight.session import materialize, shuffle_partitions

#: Bytes of the hash that samples suffixes.
GRAM = 32
#: A text is sampled in pieces of so many window starts.
PIECE = 1 << 22
#: Blocks that a task sorts at once; a sample with more blocks is hot, and dealt out anew.
BLOCKS_AT_ONCE, HOT_BLOCKS = 20_000, 20_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def sampled_suffixes(text: bytes, length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(hash, first, last, at)``: the suffix at ``at`` is sampled by the windows of
    ``length`` bytes that start at first..last; every window samples one suffix.

    A window samples the leftmost of the positions whose GRAM-byte hash is least among
    those inside it: a choice by content alone, so equal windows sample the same place.
    """
    global _POWERS, _INVERSES
    width = length - GRAM + 1
    for begin in range(0, len(text) - length + 1, PIECE):
        part = np.frombuffer(text, "u1", min(PIECE + length - 1, len(text) - begin), begin)
        n = len(part)
        while len(_POWERS) < n:
            _POWERS, _INVERSES = _powers(_BASE, 2 * len(_POWERS)), _powers(_INVERSE, 2 * len(_POWERS))
        sums = np.zeros(n + 1, "u8")
        np.cumsum((part.astype("u8") + np.uint64(1)) * _POWERS[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * _INVERSES[:n - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype="u8")
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        at = (low & np.uint64((1 << 24) - 1)).astype("i8")
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        yield from zip(h[at].view("i8").tolist(), (first + begin).tolist(), (last + begin).tolist(),
                       (at + begin).tolist(), strict=True)


def common_prefixes(rights: list[bytes]) -> np.ndarray:
    """For each string but the first, the bytes it shares with the one before it."""
    n = max(map(len, rights), default=0)
    sizes = np.array([len(x) for x in rights])
    m = np.frombuffer(b"".join(x.ljust(n, b"\0") for x in rights), "u1").reshape(len(rights), n)
    differ = np.ones((len(rights) - 1, n + 1), bool)
    differ[:, :n] = m[1:] != m[:-1]
    return np.minimum(differ.argmax(1), np.minimum(sizes[1:], sizes[:-1]))


def induced_repeats(group: np.ndarray, rights: list[bytes], lefts: list[bytes], nearest: np.ndarray,
                    length: int) -> np.ndarray:
    """Which windows are repeated: a matrix (block, bytes left of the sampled suffix).

    A block is a sampled suffix, ``rights`` (as far as its windows reach), with the bytes
    ``lefts`` before it; its windows start ``nearest`` to len(left) bytes before it.
    Blocks come sorted by (group, right).  The sampled suffixes' common prefixes are found
    once.  All other suffixes are induced: the suffix one byte further left is the tuple
    (that byte, name of the suffix it precedes), and equal tuples get equal names.  Two
    windows are equal if their names to the left are, and the common prefix of their
    sampled suffixes reaches the windows' end.
    """
    farthest = np.array([len(x) for x in lefts])
    out = np.zeros((len(rights), int(farthest.max()) + 1), bool)
    shared = np.concatenate(([0], common_prefixes(rights)))
    shared[np.flatnonzero(np.diff(group, prepend=-1))] = 0
    name, live = group.astype("i8"), np.arange(len(rights))
    for k in range(out.shape[1]):
        if k:
            live = live[farthest[live] >= k]
            byte = np.array([lefts[i][-k] for i in live.tolist()], "i8")
            _, name[live], many = np.unique(name[live] * 256 + byte, return_inverse=True, return_counts=True)
            live = live[many[name[live]] > 1]  # a name of its own meets no other further left
        if not len(live):
            break
        right = np.cumsum(shared < length - k)
        now = live[nearest[live] <= k]
        _, which, many = np.unique(name[now] * (len(rights) + 1) + right[now], return_inverse=True, return_counts=True)
        out[now, k] = many[which] > 1
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true."""
    edge = np.diff(np.concatenate(([0], flags.astype("i1"), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``(key, tag, spans)``: per text of ``docs (key, tag, packed)`` the runs of window
    starts (first, last) whose ``length`` bytes also start anywhere else."""
    import xxhash
    import zstandard

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches):
            keys, places, hashes, blocks = [], [], [], []
            for key, tag, packed in zip(*(batch[c].to_pylist() for c in ("key", "tag", "packed")), strict=True):
                text = unpack(packed)
                for h, first, last, at in sampled_suffixes(text, length):
                    keys.append(key)
                    # a block's bytes, with the place of the sampled suffix and of its windows
                    blocks.append(xxhash.xxh64_intdigest(text[first:last + length], at - first << 16 | last - first) - (1 << 63))
                    places.append(tag << 48 | first << 16 | at - first << 8 | last - first)
                    hashes.append(h)
                if len(keys) >= 20_000:
                    yield _batch(keys, places, hashes, blocks)
                    keys, places, hashes, blocks = [], [], [], []
            if keys:
                yield _batch(keys, places, hashes, blocks)

    def _batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "place", "h", "block"])

    suffixes = docs.where("n_bytes >= " + str(length)).mapInArrow(sample, "key long, place long, h long, block long")
    shared = materialize(suffixes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("lo"),
                                                   F.max("block").alias("hi"))
                         .where("n > 1").select("h", "n", (F.col("lo") != F.col("hi")).alias("mixed")))
    met = materialize(salted_join(suffixes, shared, ["h"], "n", [F.col("key"), F.col("place")])
                      .select("key", "place", "h", "block", "mixed"))

    # a sample whose blocks are all equal: all its windows are repeated
    whole = met.where("not mixed").select("key", "place")
    mixed = met.where("mixed")
    blocks = materialize(mixed.groupBy("h", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("one")))
    whole = whole.union(salted_join(mixed, blocks.where("n > 1").select("h", "block", "n"), ["h", "block"], "n",
                                    [F.col("key"), F.col("place")]).select("key", "place"))

    # one of each block, with its bytes cut from its text
    wanted = (blocks.select(F.col("one.key").alias("key"), F.shiftright("one.place", 48).cast("int").alias("tag"),
                            F.struct("h", F.col("n").alias("n"), F.col("one.place").alias("place")).alias("w"))
                .groupBy("key", "tag").agg(F.collect_list("w").alias("w")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches, 64):
            rows = []
            for key, packed, w in zip(*(batch[c].to_pylist() for c in ("key", "packed", "w")), strict=True):
                text = unpack(packed)
                for x in w:
                    place = x["place"]
                    first, left, more = place >> 16 & (1 << 32) - 1, place >> 8 & 255, place & 255
                    rows.append((x["h"], x["n"], key, place, text[first:first + left], text[first + left:first + more + length]))
                if len(rows) >= 5000:
                    yield _cut(rows)
                    rows = []
            if rows:
                yield _cut(rows)

    def _cut(rows):
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["h", "n", "key", "place", "l", "r"])

    cuts = materialize(docs.join(wanted, ["key", "tag"]).select("key", "packed", "w")
                       .mapInArrow(cut, "h long, n long, key long, place long, l binary, r binary"))
    sizes = cuts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_BLOCKS)
    hot = materialize(sizes)  # at most blocks / HOT_BLOCKS rows

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCKS_AT_ONCE:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                others = np.flatnonzero(h != h[-1])
                end = int(others[-1]) + 1 if len(others) else 0
                if end:
                    yield from _induce(table.slice(0, end))
                held, rows = table.slice(end).to_batches(), rows - end
        if rows:
            yield from _induce(pa.Table.from_batches(held))

    def _induce(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, place, n = (table[c].to_numpy() for c in ("h", "place", "n"))
        lefts = table["l"].to_pylist()
        farthest = place >> 8 & 255
        found = induced_repeats(np.cumsum(np.diff(h, prepend=h[0] - 1) != 0), table["r"].to_pylist(), lefts,
                                farthest - (place & 255), length)
        at = (place >> 16 & (1 << 32) - 1) + farthest
        rows = [(key, int(p) >> 48, int(a) - hi, int(a) - lo)
                for key, p, a, c, flags in zip(table["key"].to_pylist(), place, at, n, found, strict=True) if c == 1
                for lo, hi in _runs(flags)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)],
                names=["key", "tag", "first", "last"])

    spark = docs.sparkSession
    out = "key long, tag int, first long, last long"
    partitions = max(shuffle_partitions(spark), cuts.count() // BLOCKS_AT_ONCE)
    # Spark's external sort is the queue: tuples (sample, suffix) come out in order
    few = (cuts.join(hot, "h", "left_anti").repartition(partitions, "h").sortWithinPartitions("h", "r")
           .mapInArrow(induce, out))

    # a hot sample is met by too many blocks for one task: its windows are dealt by their own hash
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            for key, place, left, right in zip(*(batch[c].to_pylist() for c in ("key", "place", "l", "r")), strict=True):
                text, first = left + right, place >> 16 & (1 << 32) - 1
                for k in range((place & 255) + 1):
                    d = xxhash.xxh3_128_intdigest(text[k:k + length])
                    rows.append((key, place >> 48, first + k, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32()] + [pa.int64()] * 3, strict=True)],
                names=["key", "tag", "start", "d1", "d2"])

    starts = cuts.join(hot.select("h"), "h", "left_semi").mapInArrow(
        spread, "key long, tag int, start long, d1 long, d2 long")
    twice = materialize(starts.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    many = salted_join(starts, twice, ["d1", "d2"], "n", [F.col("key"), F.col("start")]).select(
        "key", "tag", F.col("start").alias("first"), F.col("start").alias("last"))

    first = F.shiftright("place", 16).bitwiseAND(F.lit((1 << 32) - 1))
    whole = whole.select("key", F.shiftright("place", 48).cast("int").alias("tag"), first.alias("first"),
                         (first + F.col("place").bitwiseAND(F.lit(255))).alias("last"))
    return whole.union(few).union(many).groupBy("key", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary)``, one row per input row: each
    text without the bytes covered by a ``length``-byte string that also starts anywhere
    else, in the same or another document.

    A suffix array of the corpus is never built whole.  Each window samples one suffix by
    its content (about one byte in 85 is sampled), and suffixes that share the sample's
    hash form a shard: windows that are equal meet in one.  Shards whose blocks are all
    equal are settled by counting, however large.  Elsewhere one of each block goes, with
    its bytes, through Spark's sort, which spills to disk; the sorted sampled suffixes
    carry their common prefixes, and the rest are induced from them byte by byte.  A shard
    of more than HOT_BLOCKS different blocks is dealt out by window instead.

    Null and short texts lose nothing.  Repeated rows are documents of their own, so each
    repeats the other.  Null ids are kept.  An empty table gives no rows.
    """
    if not GRAM <= length < GRAM + 255:
        raise ValueError(f"length must be {GRAM} to {GRAM + 254}")
    import zstandard

    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    src = src.withColumns({"key": F.xxhash64("doc_id", "text"),
                           "tag": F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 15)).cast("int")})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in portions(batches):
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], batch["tag"], pa.array([len(x) for x in texts], pa.int64()),
                 pa.array([compress(x) for x in texts], pa.binary())], names=["doc_id", "key", "tag", "n_bytes", "packed"])

    packed = src.mapInArrow(pack, "doc_id long, key long, tag int, n_bytes long, packed binary")
    spans = repeated_spans(packed.drop("doc_id"), length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches):
            removed, runs, kept = [], [], []
            for packed_text, spans_of in zip(batch["packed"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                text, at, parts, n, end = unpack(packed_text), 0, [], 0, -1
                for a, b in sorted((x["first"], x["last"] + length) for x in spans_of or ()):
                    if a > end:
                        n += 1
                        parts.append(text[at:a])
                    end = max(end, b)
                    at = end
                parts.append(text[at:])
                kept.append(b"".join(parts))
                removed.append(len(text) - len(kept[-1]))
                runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (packed.join(spans, ["key", "tag"], "left").select("doc_id", "n_bytes", "packed", "spans")
            .mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                            F.sha2("kept", 256).alias("kept_sha256"))
