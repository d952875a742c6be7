"""Vectorised helpers on UTF-8 text that the operators use inside Arrow batches.

Everything here works on one Arrow batch of a partition; nothing keeps rows
between batches. Texts are views into the batch's own buffer, null being empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 21
#: What a worker may keep in memory between tasks.
KEEP_BYTES = 1 << 28

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not part of an alphanumeric word (ASCII other than letters and digits).
NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_lo:_hi] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept and grown as longer texts come."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 16))
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[: n + 1]


class Rolling:
    """Hashes of any substring of a byte buffer, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, lower: bool = False, salt: int = 0):
        table = _BYTE_LOWER if lower else _BYTE
        if salt:
            table = mix64(table + U64(salt))
        n = len(data)
        x = table[data]
        x *= _power(_BASE, n)[:n]
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(x, out=self.prefix[1:])
        self.back = _power(_BASE_INV, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.back[start])

    def fixed(self, n: int) -> np.ndarray:
        """The hash of the n bytes from each position on."""
        got = self.prefix[n:] - self.prefix[:-n]
        got *= self.back[: len(got)]
        return mix64(got)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]), off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def each_chunk(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """(rows lo, hi, bytes, offsets from 0) over a batch, in chunks of bounded size."""
    data, off = utf8(batch.column(column))
    for lo, hi in chunks(off, limit):
        part = off[lo : hi + 1]
        yield lo, hi, data[part[0] : part[-1]], part - part[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; `gap` says which bytes separate. No word crosses rows."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n + 1 places in `starts` at which each row's words begin."""
    return np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lowered, and where each row's begin (n + 1)."""
    start, end = word_bounds(data, offsets, gap)
    if len(start) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    return Rolling(data, lower=True).of(start, end), rows_of(start, offsets)


def sum_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], 0 where empty."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _resident() -> int:
    """Bytes of this process in memory; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:
        return 0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and where a task leaves over KEEP_BYTES in memory, what it freed goes back to the system: workers live on and would keep the most that any task needed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if _resident() > KEEP_BYTES:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
            if trim is not None:
                trim(0)

    return task
