"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on whole Arrow string columns: bytes are classified with
256-entry tables, words are found from class changes and hashed with segmented
sums, so no Python code runs per character or per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

PIECE_ROWS, PIECE_BYTES = 512, 1 << 18
# Clear what an operator keeps in a worker between its tasks; called when another operator's task begins there.
HELD: list[Callable[[], None]] = []

# ASCII white space: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 arrays."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = U64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of one odd constant, grown on demand."""

    def __init__(self) -> None:
        self.values = np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = max(n, 2 * len(self.values), 256)
            steps = np.full(size, _STEP, dtype=U64)
            steps[0] = U64(1)
            self.values = np.multiply.accumulate(steps)
        return self.values


_POWERS = _Powers()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and each would keep the most that it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most PIECE_ROWS rows and, single rows apart, PIECE_BYTES of column ``text``; memory goes back after each batch."""
    for clear in HELD:
        clear()
    for batch in batches:
        _, offsets = string_bytes(batch.column(text))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1
            b = max(a + 1, min(b, a + PIECE_ROWS))
            yield batch.slice(a, b - a)
            a = b
        del batch
        give_back()


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values end to end, and len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        wide = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
        column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a column: byte ranges, a 64-bit hash each, and each text's word range."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bound: np.ndarray  # words of text i are bound[i] .. bound[i + 1]


def words(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """Split at ASCII white space and text ends; ``fold`` lower-cases A-Z first."""
    space = IS_SPACE[raw]
    inner = np.ones(len(raw) + 1, dtype=bool)
    inner[:-1] = space
    before = np.ones(len(raw), dtype=bool)
    before[1:] = space[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cut] = True
    start = np.flatnonzero(before & ~space)
    after = np.ones(len(raw), dtype=bool)
    after[:-1] = space[1:]
    after[cut - 1] = True
    end = np.flatnonzero(after & ~space) + 1
    bound = np.searchsorted(start, offsets)
    return Words(start, end, hash_ranges(raw, start, end, fold), bound)


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each byte range; ranges ascend and don't overlap."""
    if not len(start):
        return np.zeros(0, U64)
    out = np.empty(len(start), dtype=U64)
    code = _BYTE_CODE[LOWER] if fold else _BYTE_CODE
    block = 1 << 20  # ranges at a time keep the working set small
    for a in range(0, len(start), block):
        s, e = start[a : a + block], end[a : a + block]
        length = e - s
        first = np.zeros(len(s), dtype=np.int64)
        np.cumsum(length[:-1], out=first[1:])
        within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
        value = code[raw[within + np.repeat(s, length)]]
        value *= _POWERS.upto(int(length.max()) + 1)[within]
        out[a : a + block] = mix64(np.add.reduceat(value, first) + length.astype(U64) * U64(0xA0761D6478BD642F))
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``width`` consecutive entries."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, (width * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    for k in range(width):
        total = (total ^ h[k : k + n]) * U64(0xE7037ED1A0B428DB)
        total ^= total >> U64(29)
    return mix64(total)


def shingle_sets(found: Words, width: int):
    """Yield each text's sorted distinct shingle hashes; shorter texts give one."""
    h, bound = found.hash, found.bound
    runs = window_hashes(h, width)
    for i in range(len(bound) - 1):
        a, b = int(bound[i]), int(bound[i + 1])
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield window_hashes(h[a:b], b - a) ^ U64(0x5851F42D4C957F2D)
        else:
            yield np.zeros(0, U64)
