"""Vectorised text primitives on Arrow string columns (used inside Python tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at a time; keeps the numpy temporaries of a task to some tens of megabytes.
SLICE_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    if len(_powers.get(key, ())) < n:
        out = np.full(max(n, 1 << 16), BASE_INVERSE if inverse else BASE, np.uint64)
        out[0] = 1
        fresh = np.multiply.accumulate(out)
        if n > 4 * SLICE_BYTES:  # an outsized text: do not keep its table
            return fresh[:n]
        _powers[key] = fresh
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, independent of where it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(values) + 1, inverse=True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets from 0) of about ``limit`` bytes.

    A longer text is a slice of its own; texts are never cut.
    """
    data, offsets = string_parts(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def batches_of(batches: Iterator[pa.RecordBatch], limit: int, column: str, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``limit`` bytes of a string or binary column and ``rows`` rows; a longer value is a batch of its own."""
    for b in batches:
        low = 0
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.append(0, np.cumsum(size))
        while low < b.num_rows:
            end = max(low + 1, int(np.searchsorted(total, total[low] + limit, side="right")) - 1)
            end = min(end, low + rows, b.num_rows)
            yield b.slice(low, end - low)
            low = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a slice, and for each text the index of its first word.

    The last array has one more entry than there are texts; words never cross texts.
    """
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(BYTE_VALUE[data], starts, ends)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, pa.Array]:
    """The number of each word of a slice among its distinct words, and these; told apart by their bytes."""
    packed = np.ascontiguousarray(data[~separator[data]])
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
