"""Vectorised scanning of text columns inside Spark tasks.

Everything here works on one Arrow batch at a time: the UTF-8 buffer of the whole batch is one byte array, documents are
offset ranges in it, words are ``[^\\x20\\x09-\\x0D]+`` spans. Nulls count as empty texts. Temporary arrays are bounded by
``CHUNK`` positions, however long a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Positions hashed at once.
CHUNK = 1 << 20
#: Text bytes handed to an operator at once (a single longer document still comes whole).
SLICE_BYTES = 4 << 20

_R = U(0x9E3779B97F4A7C15 | 3)  # odd, so it has an inverse modulo 2**64
_RINV = U(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)

#: White space of the word definition: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        for i, r in enumerate((_R, _RINV)):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64))
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and each document's first byte (one more entry at the end)."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut each batch into runs of rows of about ``limit`` text bytes: (rows, bytes, offsets)."""
    for b in batches:
        at = 0
        data, off = text_bytes(b.column(b.schema.get_field_index(text)))
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            end = min(end, b.num_rows)
            yield b.slice(at, end - at), data[off[at]:off[end]], off[at:end + 1] - off[at]
            at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and each document's first word (one more entry at the end)."""
    inside = ~IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = off[:-1][off[:-1] < off[1:]]
    begins[first] = inside[first]
    last = off[1:][off[:-1] < off[1:]] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (ordered, may touch but not overlap)."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:-1], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93), seed)


def window_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes from each position on (positions with fewer than n codes left are absent)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(m, np.uint64)
    for at in range(0, m, CHUNK):
        end = min(at + CHUNK, m)
        part = codes[at:end + n - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        out[at:end] = (total[n:] - total[:-n]) * down[:end - at]
    return out


def owners(off: np.ndarray) -> np.ndarray:
    """The document number of each position covered by the offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def doc_starts(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which n more fit into their document, and those positions' document numbers."""
    room = np.maximum(np.diff(off) - n + 1, 0)
    own = np.repeat(np.arange(len(room)), room)
    before = np.cumsum(room) - room
    return np.arange(int(room.sum())) - before[own] + off[:-1][own], own


def ints(col: pa.Array, null: int) -> np.ndarray:
    """An integer column as int64, nulls as the given value."""
    return pc.fill_null(col.cast(pa.int64()), null).to_numpy(zero_copy_only=False)
