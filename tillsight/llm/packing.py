"""Packing: documents become token sequences of a fixed window, with little padding."""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import dense_ordinals, select_text
from tillsight.llm.trees import CapacityTree
from tillsight.llm.words import SLICE_BYTES, Generations, byte_slices, gathered
from tillsight.session import materialize

#: Entries of one generation of a cache (about 200 bytes each, two generations).
CACHED = 400_000

_ENCODERS: dict[str, Callable] = {}  # by path: a reused Python worker keeps its caches


def word_tokenizer(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Words to token ids, each 4 bytes little-endian, as ``encode(word)`` gives them.

    For lower-casing tokenizers that split at white space, and at the end of a run of
    letters, before merging: a text's ids are those of its words one after another, and
    a word's those of its letters and of the full stop or comma that ends it.  So each
    is encoded once and kept in a cache of bounded size.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    if path in _ENCODERS:
        return _ENCODERS[path]
    tokenizer = Tokenizer.from_file(path)
    words, stems = Generations(CACHED), Generations(CACHED)

    def little(ids: list[int]) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def stem(word: bytes) -> tuple[bytes, bytes]:
        if b"<|" in word:  # may hold a special token, whose case counts
            return word, b""
        word = word.lower()
        return (word[:-1], word[-1:]) if word[-1:] in b".," and word[-2:-1].isalpha() else (word, b"")

    def learn(new: list[bytes]) -> None:
        parts = [stem(w) for w in new]
        stems.turn()
        unknown = stems.missing({x for part in parts for x in part if x and x not in stems})
        got = tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in unknown], add_special_tokens=False)
        stems.update((x, little(e.ids)) for x, e in zip(unknown, got, strict=True))
        words.update((w, stems[a] + (stems[b] if b else b"")) for w, (a, b) in zip(new, parts, strict=True))

    def encode(distinct: list[bytes]) -> list[bytes]:
        words.turn()
        words[b""] = b""
        learn(words.missing([w for w in distinct if w not in words]))
        return list(map(words.__getitem__, distinct))

    _ENCODERS[path] = encode
    return encode


def plan_best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of piece lengths, all at most ``window``.

    Pieces of one length are interchangeable, and so are open windows of equal room;
    whole runs of both are placed at once.  Returns ``(length, first, last, sequence,
    offset)``: the pieces number first..last-1 of that length go to the sequences
    sequence, sequence+1, ... at that offset.  Exactly what placing piece by piece into
    the tightest open window gives, in a time that depends on the number of lengths.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    rooms, plan, opened = CapacityTree(window), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                rooms.set(room, True)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = rooms.tightest(length)
            if room is None:  # open as many windows as these pieces can need
                room, first, m = window, opened, -(-(n - done) // (window // length))
                opened += m
            else:
                first, m = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.set(room, False)
            each = min(room // length, n - done)  # a window is filled up before the next
            full = min(m, (n - done) // each)
            for k in range(each):
                plan.append((length, done, done + full, first, window - room + k * length))
                done += full
            put(room - each * length, first, full)
            if m > full:
                put(room, first + full, m - full)
    return plan


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_ids binary"


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, ``with_ids``, the ids themselves (4 bytes little-endian each).

    A document is its token ids plus ``end_id``.  Overlong ones are first cut into full
    windows; the rest of each is packed by best-fit decreasing.  The packing is exact and
    global though no task sees all pieces: only the histogram of lengths, at most
    ``window`` numbers, reaches the driver.  Pieces then get their number within their
    length and look up their place in the plan.

    A task tokenizes slices of about ``slice_bytes`` of text: larger ones look up fewer words
    and take more memory; the rows are the same.

    Null and empty texts are the end id alone.  Null ids and repeated rows are packed
    like others.  An empty table gives no rows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for part in byte_slices(batches, "text", size=slice_bytes):
            rows = []
            data, ends = gathered(part["text"], encode)
            at = ends.tolist()
            for doc_id, i, j in zip(part["doc_id"].to_pylist(), at, at[1:], strict=False):
                ids = bytes(data[i:j]) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start:4 * (start + window)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece_ids"])

    src = select_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    pieces = materialize(src.mapInArrow(cut, PIECE))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sorted(plan_best_fit(counts, window))
    length, first, _, sequence, offset = (np.array(x, "int64") for x in (zip(*plan, strict=True) if plan else [[]] * 5))
    key = (length << 44) | first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinal = batch["ordinal"].to_numpy()
            at = np.searchsorted(key, (batch["length"].to_numpy() << 44) | ordinal, "right") - 1
            made = [pa.array(sequence[at] + ordinal - first[at]), pa.array(offset[at])]
            kept = [c for c in batch.schema.names if c != "ordinal"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *made], names=[*kept, "sequence_id", "offset"])

    wanted = pieces if with_ids else pieces.drop("piece_ids")
    numbered = dense_ordinals(wanted, ["length"], ["doc_id", "start", "ids_crc32"], sum(counts.values()), "ordinal")
    numbered = numbered.select(*wanted.columns, F.col("ordinal").cast("long").alias("ordinal"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
