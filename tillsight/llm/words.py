"""Texts to token ids through their distinct words: Arrow does the work per occurrence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch ends at so many rows or with the row that brings it to so many bytes.
SLICE_ROWS, SLICE_BYTES = 4096, 8 << 20


class Generations(dict):
    """A bounded cache: when full it becomes the old generation, from which entries
    still in use are taken over."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, keys) -> list:
        """Those of ``keys`` that neither generation holds."""
        new = []
        for k in keys:
            got = self.old.get(k)
            if got is None:
                new.append(k)
            else:
                self[k] = got
        return new


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = SLICE_ROWS,
                size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose text in ``column`` is bounded, but for a last long row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(int(np.searchsorted(ends, before + size)) + 1, at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def gathered(texts: pa.Array, made: Callable[[list[bytes]], list[bytes]]) -> tuple[memoryview, np.ndarray]:
    """``(buffer, ends)``: what ``made`` gives for each text's words, one after another in
    one buffer; text i's part lies between ends[i] and ends[i + 1].

    Texts (binary, no nulls) are split at runs of ASCII white space; the words are
    dictionary-encoded, ``made`` sees each distinct one once, and the results are taken
    by code.
    """
    if not len(texts):
        return memoryview(b""), np.zeros(1, "int64")
    words = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
    codes = words.flatten().dictionary_encode()
    distinct = codes.dictionary.view(pa.large_binary()).to_pylist()
    values = pa.array(made(distinct), pa.large_binary()).take(codes.indices)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype("int64")
    if not len(values):
        return memoryview(b""), np.zeros(len(texts) + 1, "int64")
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, "int64")[values.offset:values.offset + len(values) + 1][bounds]
    return memoryview(data) if data is not None else memoryview(b""), ends
