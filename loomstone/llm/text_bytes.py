"""Batches of texts as one byte array, for vectorised scans in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 4 << 20


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values back to back, and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; one text is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def split_at(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values that never cross a text: starts, ends, index of the text."""
    n, lengths = len(mask), np.diff(offsets)
    before = np.zeros(n + 1, bool)
    before[1:] = mask
    inner = offsets[:-1][lengths > 0]
    start = mask & ~before[:-1]
    start[inner] = mask[inner]
    after = np.zeros(n + 1, bool)
    after[:-1] = mask
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    last = offsets[1:][lengths > 0] - 1
    end[last] = mask[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


def parts_of_words(data: np.ndarray, word_byte: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places of parts of about ``most`` bytes that never cut a word; a longer word makes a longer part."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + most, n)
        while end < n and word_byte[data[end]]:
            further = np.flatnonzero(~word_byte[data[end : end + most]])
            end = end + int(further[0]) if len(further) else min(end + most, n)
        yield start, end
        start = end
