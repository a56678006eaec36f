"""Helpers for functions that Spark runs over Arrow batches: whole texts as one byte buffer.

A null text counts as an empty one. Work is done in slices of whole documents of about ``SLICE`` bytes, so that the
arrays beside a batch stay small however long the batch is; only a single document may be larger than a slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
PAD = 16


#: What drops the tables that operators keep in a process from task to task.
forgetting: list[Callable[[], None]] = []


def forget() -> None:
    for drop in forgetting:
        drop()


def lean(run: Callable, tables: bool = False) -> Callable:
    """``run`` over batches, which gives freed memory back to the system after every few batches and at its end. Spark keeps Python workers for
    the tasks to come, and what their allocators hold back would add up from one step of a job to the next. So would the tables that operators
    keep in a process: they go before ``run`` starts, unless it uses ``tables`` itself."""

    def release() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in batches:
                seen += batch.nbytes
                yield batch
                if seen > 8 * SLICE:
                    seen = 0
                    release()

        if not tables:
            forget()
        try:
            yield from run(own())
        finally:
            release()

    return trimmed


def text_column(column) -> pa.Array:
    """A string or binary column as Arrow binary with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with ``PAD`` zero bytes at both ends, and the n + 1 offsets into them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    out = np.zeros(hi - lo + 2 * PAD, np.uint8)
    if hi > lo:
        out[PAD : PAD + hi - lo] = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    return out, offsets - lo + PAD


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, len(texts))
        row = end


def words_view(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at every byte position, without a copy."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))


def ragged_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + counts[i] - 1`` for every i, one after another."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column whose row i is ``values[offsets[i]:offsets[i + 1]]`` as bytes."""
    raw = np.ascontiguousarray(values)
    edges = np.asarray(offsets, np.int64) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw.view(np.uint8))]).cast(pa.binary())


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space (space, tab to carriage return), which never cross texts, and the
    n + 1 places where each text's words begin in them."""
    inside = ~SPACES[buf]
    inside[: offsets[0]] = False
    inside[offsets[-1] :] = False
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span's bytes, eight bytes a round."""
    view, lengths = words_view(buf), ends - starts
    out = mix64(lengths.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    active, at = np.arange(len(starts)), starts.copy()
    while len(active):
        left = ends[active] - at[active]
        word = view[at[active]]
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        word = np.where(left >= 8, word, word & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))
        out[active] = mix64(out[active] * np.uint64(0xC2B2AE3D27D4EB4F) + word)
        at[active] += 8
        active = active[left > 8]
    return out
