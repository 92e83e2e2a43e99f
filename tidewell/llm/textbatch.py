"""Vectorised text primitives over Arrow string columns.

Every routine works on the UTF-8 bytes of a slice of whole documents, so a
document is never cut. Hashes are 64-bit and depend on content alone: they are
equal across batches, tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one numpy pass takes at once (a longer document is one pass of its own).
SLICE_BYTES = 1 << 19

_BASE = U64(0x9E3779B97F4A7C15 | 1)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base & 0xFFFFFFFFFFFFFFFF
    return out


_LOW = 4096
_FINE, _FINE_INV = _table(int(_BASE), _LOW), _table(_inverse(int(_BASE)), _LOW)
_COARSE: dict[bool, np.ndarray] = {}


def _coarse(n: int, inverse: bool) -> np.ndarray:
    """Powers of the base to the multiples of 4,096, at least n of them."""
    have = _COARSE.get(inverse)
    if have is None or len(have) < n:
        base = _inverse(int(_BASE)) if inverse else int(_BASE)
        have = _COARSE[inverse] = _table(pow(base, _LOW, 1 << 64), max(n, 512))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of inside bytes that stay in one document: starts, ends, document numbers."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, from which span_hash takes the hash of any span."""
    n = len(data)
    out = np.zeros(n + 1, U64)
    if n:
        powers = (_coarse(-(-n // _LOW), False)[: -(-n // _LOW), None] * _FINE[None, :]).ravel()[:n]
        np.cumsum((data.astype(U64) + U64(1)) * powers, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    top = starts >> 12
    back = _coarse(int(top.max()) + 1 if len(top) else 1, True)[top] * _FINE_INV[starts & (_LOW - 1)]
    return mix((sums[ends] - sums[starts]) * back)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice in order, and the first word of each document (n + 1 bounds).

    A word is a run of ASCII letters, digits and non-ASCII characters, in lower case.
    """
    data, offsets = utf8(pc.utf8_lower(column))
    starts, ends, doc = spans(WORD[data], offsets)
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(doc, np.arange(len(offsets)))


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams of each document, and their bounds; a document of 1 to k - 1 words has one gram of them all."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) >= k:
        h = hashes[: len(hashes) - k + 1].copy()
        for i in range(1, k):
            h = h * U64(0xD1342543DE82EF95) + hashes[i : len(hashes) - k + 1 + i]
        h = mix(h)
    else:
        h = np.zeros(0, U64)
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.arange(out[-1]) - out[:-1][doc] + bounds[:-1][doc]
    short = n[doc] < k
    g = np.empty(len(at), U64)
    g[~short] = h[at[~short]]
    for i in np.flatnonzero(short):
        value = U64(n[doc[i]])
        for x in hashes[bounds[doc[i]] : bounds[doc[i] + 1]]:
            value = U64((int(value) * 0xD1342543DE82EF95 + int(x)) & 0xFFFFFFFFFFFFFFFF)
        g[i] = value
    if short.any():
        g[short] = mix(g[short])
    return g, out


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is the bytes of data[cuts[i]:cuts[i + 1]]; at most 2 GiB together."""
    body = np.ascontiguousarray(data)
    offsets = np.asarray(cuts, np.int64) * body.itemsize
    if len(offsets) and offsets[-1] >= 1 << 31:
        raise OverflowError("a binary column holds 2 GiB at most: use more blocks")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])


def joined(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """The values of a binary column behind each other."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def pack7(h: np.ndarray) -> np.ndarray:
    """The low seven bytes of each value."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).ravel()


def unpack7(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = data.reshape(-1, 7)
    return out.view(U64).ravel()
