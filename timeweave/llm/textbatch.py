"""Vectorised views of a batch of texts: byte buffers, word bounds and 64-bit word hashes without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


class Texts(NamedTuple):
    """Rows lo..hi of a batch: their bytes, where each text starts, and the end of the last."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


def texts(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[Texts]:
    """The texts of a string column in pieces of about `chunk` bytes. A null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield Texts(lo, hi, whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n > 1 << 24:  # not kept: a single very long text
            return have
        _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words(NamedTuple):
    """Word k of the chunk is data[start[k]:end[k]] of text doc[k]; first[d]..first[d+1] are the words of text d."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(t: Texts, inside: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Runs of the bytes that `inside` marks, within each text, with a hash of their bytes (those of `data`)."""
    data = t.data if data is None else data
    n, docs = len(data), len(t.bounds) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(docs + 1, np.int64), np.zeros(0, np.uint64))
    is_in = inside[data]
    start = is_in.copy()
    start[1:] &= ~is_in[:-1]
    edges = t.bounds[1:-1]
    edges = edges[edges < n]
    start[edges] = is_in[edges]
    end = is_in.copy()
    end[:-1] &= ~is_in[1:]
    edges = edges[edges > 0] - 1
    end[edges] = is_in[edges]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(t.bounds, s, "right") - 1
    first = np.searchsorted(s, t.bounds, "left")
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=total[1:])
    h = (total[e] - total[s]) * powers(BASE_INV, n)[s]
    return Words(s, e, doc, first, mixed(h + (e - s).astype(np.uint64)))


def spans_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]]; 0 for empty spans."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:], dtype=total.dtype)
    return total[first[1:]] - total[first[:-1]]


def count_words(column: pa.Array) -> np.ndarray:
    """Whitespace-separated words of each text; 0 for null or empty ones."""
    out = np.zeros(len(column), np.int64)
    for t in texts(column):
        if len(t.data):
            start = ~WHITE[t.data]
            inner = start[1:] & start[:-1]
            edges = t.bounds[1:-1]
            edges = edges[(edges > 0) & (edges < len(t.data))] - 1
            inner[edges] = False
            start[1:] &= ~inner
            total = np.concatenate([[0], np.cumsum(start, dtype=np.int64)])
            out[t.lo : t.hi] = total[t.bounds[1:]] - total[t.bounds[:-1]]
    return out
