"""Vectorised words and word hashes over Arrow batches of UTF-8 text.

Words are maximal runs of bytes other than space and \\x09-\\x0D.  Everything
here works on one flat byte buffer with row offsets, so that the cost per word
is a few numpy operations and not a Python call.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


BYTE = constants(256, 1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64; kept between calls up to 4 M entries."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INVERSE, U64)
        up[0] = down[0] = 1
        table = {"up": np.multiply.accumulate(up), "down": np.multiply.accumulate(down)}
        if size > 1 << 22:
            return table["up"], table["down"]
        _powers.update(table)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _trim() -> None:
    """Give freed memory back to the system, where the C library can: a worker is used again by other stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    if batch.num_rows:
        _trim()


class Words:
    """Words of a run of rows: starts, ends (byte positions) and bounds (row r has words bounds[r]:bounds[r+1])."""

    def __init__(self, column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE):
        data, self.offsets = flat(column)
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(gaps[data], out=inside[1:-1])
        first = np.zeros(len(data) + 1, bool)
        first[self.offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.rows = len(self.offsets) - 1

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `width` values, by its start; runs across rows are for the caller to leave out."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((mix(values + U64(seed)) if seed else values) * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n] + U64(width))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's LONG."""
    return x.view(np.int64) if x.dtype == U64 else x


#: Byte classes: 0 space, 1 letters and bytes of multi-byte characters, 2 digits, 3 other signs.
CLASS = np.full(256, 3, np.uint8)
CLASS[:0x21][SPACE[:0x21]] = 0
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2


class Tokens(Words):
    """Runs of bytes of one class; `classes` names those that are tokens, the rest are gaps."""

    def __init__(self, column: pa.Array, lower: bool = False, classes: tuple[int, ...] = (1, 2, 3)):
        data, self.offsets = flat(column)
        self.data = LOWER[data] if lower else data
        kind = CLASS[data]
        wanted = np.isin(np.arange(4), classes)[kind]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[self.offsets] = True
        self.starts = np.flatnonzero(wanted & edge[:-1])
        self.ends = np.flatnonzero(wanted & edge[1:]) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.rows = len(self.offsets) - 1


def held_out(of: int, remainder: int):
    """Whether crc32 of doc_id as text has this remainder; false without a doc_id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))
