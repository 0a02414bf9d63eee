"""Vectorised text primitives: batches of texts as one byte buffer, and 64-bit hashes of any substring.

hash(s, e) of a buffer is (P[e] - P[s]) * BASE**-s mod 2**64, where P is the running sum of
TABLE[byte] * BASE**position: one cumulative sum serves words, shingles and windows of any length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
#: Bytes A-Z hash as a-z.
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
GAP = SPACE.copy()
GAP[[b for b in range(128) if not chr(b).isalnum()]] = True
#: Bytes of text handled at a time, so that eight-byte work arrays stay small.
CHUNK = (1 << 20) - 64


@lru_cache(maxsize=2)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    out = []
    for b in (BASE, INVERSE):
        x = np.full(n, b, U)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(20, int(n).bit_length()))


def released(run):
    """run, after which the worker, which Spark keeps for the next task, gives freed memory back to the system."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def prefix(buf: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(table[buf] * p[: len(buf)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U))


def windows_hash(pre: np.ndarray, k: int, raw: bool = False) -> np.ndarray:
    """Of each k consecutive bytes; raw: not mixed."""
    n = len(pre) - k
    if n <= 0:
        return np.zeros(0, U)
    _, inv = powers(len(pre))
    h = (pre[k:] - pre[:-k]) * inv[:n]
    return h if raw else mix(h)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    c = batch.column(batch.schema.get_field_index(name))
    if c.null_count:
        c = c.fill_null(b"" if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else "")
    if not pa.types.is_large_binary(c.type):
        c = c.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(c.type) else c.cast(pa.large_binary())
    _, off, data = c.buffers()
    off = np.frombuffer(off, np.int64, len(c) + 1, c.offset * 8) if len(c) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most about limit bytes: first row, last row + 1, bytes, offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes outside gap; none crosses a row), and each row's first word."""
    solid = ~gap[buf]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    start[cut] = solid[cut]
    end[cut - 1] = solid[cut - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, or of all words where it has fewer; and each row's first shingle."""
    n_words = np.diff(first)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    row = np.repeat(np.arange(len(count)), count)
    begin = first[:-1][row] + np.arange(len(row)) - at[:-1][row]
    size = np.minimum(k, n_words)[row]
    out = size.astype(U)
    padded = np.concatenate([h, np.zeros(k, U)])
    for j in range(k):
        out = out * U(BASE) + np.where(j < size, padded[begin + j], U(0))
    return mix(out), at


def listed(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def windows_hash_of(rows: np.ndarray) -> np.ndarray:
    """The hash that windows_hash gives each row of a byte matrix."""
    p, _ = powers(rows.shape[1])
    return mix((TABLE[rows] * p[: rows.shape[1]]).sum(axis=1, dtype=U))
