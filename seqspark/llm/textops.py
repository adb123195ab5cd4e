"""Vectorised helpers over Arrow string columns (bytes, words, rolling hashes).

They run inside Arrow tasks; Spark deals the rows. Nulls count as empty texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word contracts: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; a longer one stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    if base not in _tables or len(_tables[base]) < n:
        table = np.full(max(n, 1 << 16), base, dtype=U64)
        table[0] = 1
        _tables[base] = np.multiply.accumulate(table)
    return _tables[base][:n]


def words(low: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the number of words of each document."""
    inside = np.zeros(len(low) + 2, dtype=bool)
    inside[1:-1] = ~separator[low]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edges = off[:-1][off[:-1] < len(low)]
    before[edges] = False
    ends = off[1:][off[1:] > 0]
    after[ends - 1] = False
    start = np.flatnonzero(here & ~before)
    end = np.flatnonzero(here & ~after) + 1
    at = np.searchsorted(start, off)
    return start, end, np.diff(at)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums H with H[j] - H[i] = sum of (byte + 1) * BASE**k over i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), the same wherever they stand."""
    raw = (h[end] - h[start]) * powers(len(h), BASE_INV)[start]
    return mix64(raw ^ ((end - start).astype(U64) << U64(48)))


def word_hashes(low: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and words of each document."""
    if not len(low):
        return np.zeros(0, U64), np.zeros(len(off) - 1, np.int64)
    start, end, counts = words(low, off, separator)
    return span_hash(prefix_hash(low), start, end), counts


def pack_steps(values: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as their steps, byte by byte, compressed."""
    return zlib.compress(np.diff(values, prepend=values.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) if len(values) else b""


def unpack_steps(raws) -> np.ndarray:
    """The numbers of several packs, one pack after another."""
    parts = [np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=U64) for raw in raws if len(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, U64)
