"""Level-wise doubling: windows repeated at one length alone are extended to twice that length, until no candidates survive.

The texts are read once, in slices of whole documents; a window is known by its slice and its word position there. A level

1. sends each candidate window's hash to its hash range (some 9 bytes a window; the first level has a candidate for each word),
2. keeps the windows whose hash occurs in two or more documents,
3. joins each kept window with the kept window that starts where it ends, or overlaps it if the last length asks for less than
   twice as much: their two hashes are the longer window's, so no text is read again.

A window that isn't repeated at one length is in no repeated window of a later one, so nothing is lost. At the last length
windows are compared by both halves' hashes, and those that also start in a document with a smaller doc_id are the result.

Rows travel packed, one value for a slice and a hash range. A slice sends at most two rows for a hash that several of its documents
hold, so a passage that a third of all documents share costs a hash range two rows a slice; all its other windows are known
to be repeated without being sent. Range numbers follow the corpus size.

Documents are known by (doc_id, hash of doc_id and text): rows that share a doc_id don't remove each other's words, and a null
doc_id counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textcore as tc
from flowlens.llm.repeats import NULL_ID, _equal_groups, _part_of, _record, keyed, union
from flowlens.llm.stages import materialize

U = np.uint64
#: Text bytes of a slice and of a hash range.
SLICE, RANGE = 8 << 20, 64 << 20
#: Words of the first level's windows at most.
FIRST = 13
#: Kinds of packed rows: a slice's documents, windows known to be kept, candidates, candidates that several documents of the
#: slice hold.
_DOCS, _KEPT, _OPEN, _SHARED = range(4)
_PACKED = "kind int, part int, blob binary"
_FOUND = "id long, key long, removed binary"


def lengths(target: int, first: int = FIRST) -> list[int]:
    """The lengths of the levels: ``target`` halved, rounding up, until it is at most ``first``; at least one doubling."""
    out = [target]
    while out[0] > first or (len(out) == 1 and target > 1):
        out.insert(0, -(-out[0] // 2))
    return out


def _planes(x: np.ndarray) -> bytes:
    """Integers that rise by small steps, as the bytes of the steps, high bytes apart: these are zeros and compress to nothing."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _pack(piece: int, *cols: np.ndarray) -> bytes:
    """A slice's rows: hashes as they are, positions and ids as steps."""
    return b"".join([np.array([piece, len(cols[0])], np.int64).tobytes(),
                     *(np.ascontiguousarray(c).tobytes() if c.dtype == U else _planes(c) for c in cols)])


def _unpack(blob: pa.Scalar, *kinds: type) -> tuple:
    """(slice, the row arrays)."""
    raw = blob.as_buffer()
    piece, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    out, at = [], 16
    for kind in kinds:
        width = np.dtype(kind).itemsize
        if kind is U:
            out.append(np.frombuffer(raw, U, n, at))
        else:
            steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(-1)
            out.append(np.cumsum(steps, dtype=kind))
        at += n * width
    return piece, *out


def _home(piece: int, parts: int) -> int:
    """The part that a slice's kept windows go to."""
    return int(_part_of(tc.mix(np.array([piece], np.int64).view(U), 3), parts)[0])


def _deal(kind: int, part: np.ndarray, parts: int, piece: int, *cols: np.ndarray) -> list[tuple]:
    """Rows to one packed value for each part."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    names, first = np.unique(part[order], return_index=True)
    return [(kind, int(p), _pack(piece, *(c[order[a:b]] for c in cols)))
            for p, a, b in zip(names, first, [*first[1:], len(part)], strict=True)]


def _candidates(piece: int, pos: np.ndarray, own: np.ndarray, h: np.ndarray, parts: int) -> list[tuple]:
    """A slice's windows (by position) to hash ranges; of those that several of its documents hold, the first and the last."""
    if not len(h):
        return []
    order = np.argsort(h, kind="stable")
    k = h[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    last = np.concatenate([first[1:], [len(k)]]) - 1
    shared = own[order[first]] != own[order[last]]
    kept, ends = np.zeros(len(h), bool), np.zeros(len(h), bool)
    kept[order] = np.repeat(shared, last - first + 1)
    ends[order[first[shared]]] = ends[order[last[shared]]] = True
    out, part = [], _part_of(h, parts)
    for kind, pick in ((_OPEN, ~kept), (_SHARED, ends)):
        out += _deal(kind, part[pick], parts, piece, pos[pick], h[pick])
    known = kept & ~ends
    if known.any():
        out.append((_KEPT, _home(piece, parts), _pack(piece, pos[known], h[known])))
    return out


def _decide(piece: np.ndarray, pos: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, parts: int) -> list[tuple]:
    """Windows of the last length: those that a smaller document of the same task holds are settled, the others go on."""
    later = _equal_groups(ids, [left, right])
    out = []
    part = _part_of(tc.mix(tc.mix(left, 4) ^ right, 5), parts)
    for p in np.unique(piece):
        mine = piece == p
        gone, on = mine & later, mine & ~later
        if gone.any():
            out.append((_KEPT, _home(int(p), parts), _pack(int(p), pos[gone], np.zeros(int(gone.sum()), U))))
        out += _deal(_OPEN, part[on], parts, int(p), pos[on], ids[on], left[on], right[on])
    return out


def _scan(length: int, target: int, parts: int, size: int) -> Callable:
    """The first level's windows of documents that have a window of the last length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for n, (rows, data, off) in enumerate(tc.slices(batches, "__text", size)):
            starts, ends, wo = tc.words(data, off)
            codes = tc.span_hash(data, starts, ends)
            at, own = tc.doc_starts(wo, length)
            enough = np.diff(wo) >= target
            keep = enough[own]
            at, own = at[keep], own[keep]
            if not len(at):
                continue
            ids, keys = tc.ints(rows.column(0), NULL_ID)[enough], tc.ints(rows.column(1), 0)[enough]
            docs = (_DOCS, _home(task + n, parts), _pack(task + n, ids, keys, wo[:-1][enough]))
            h, pos = tc.mix(tc.window_hash(codes, length)[at], 1), at.astype(np.int32)
            if length < target:
                yield _record([docs, *_candidates(task + n, pos, own, h, parts)])
            else:
                yield _record([docs, *_decide(np.full(len(at), task + n), pos, tc.ints(rows.column(0), NULL_ID)[own], h, h, parts)])
    return run


def _on(table: pa.Table, *kinds: int) -> list[tuple]:
    """The rows of these kinds as they are."""
    return [(k, p, b.as_py()) for k, p, b in zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["blob"], strict=True)
            if k in kinds]


def _repeated(parts: int) -> Callable:
    """The windows of a hash range that occur in two or more documents."""
    def run(table: pa.Table) -> pa.Table:
        rows, got, shared = _on(table, _DOCS, _KEPT), [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"], strict=True):
            if kind in (_OPEN, _SHARED):
                got.append(_unpack(blob, np.int32, U))
                shared.append(kind == _SHARED)
        if got:
            counts = [len(x[1]) for x in got]
            h = np.concatenate([x[2] for x in got])
            order = np.argsort(h)
            k = h[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            piece = np.repeat(np.array([x[0] for x in got]), counts)[order]
            many = np.minimum.reduceat(piece, first) != np.maximum.reduceat(piece, first)
            many |= np.logical_or.reduceat(np.repeat(np.array(shared), counts)[order], first)
            keep = np.empty(len(h), bool)
            keep[order] = np.repeat(many, np.diff(np.concatenate([first, [len(h)]])))
            for (p, pos, x), a, n in zip(got, np.cumsum([0, *counts]), counts):
                mine = keep[a:a + n]
                if mine.any():
                    rows.append((_KEPT, _home(p, parts), _pack(p, pos[mine], x[mine])))
        return pa.Table.from_batches([_record(rows)])
    return run


def _settled(parts: int) -> Callable:
    """The windows of the last length that also start in a document with a smaller id."""
    def run(table: pa.Table) -> pa.Table:
        rows = _on(table, _DOCS, _KEPT)
        got = [_unpack(b, np.int32, np.int64, U, U) for k, b in zip(table["kind"].to_pylist(), table["blob"], strict=True) if k == _OPEN]
        if got:
            ids, left, right = (np.concatenate([x[i] for x in got]) for i in (2, 3, 4))
            later, done = _equal_groups(ids, [left, right]), 0
            for p, pos, *_ in got:
                mine = later[done:done + len(pos)]
                done += len(pos)
                if mine.any():
                    rows.append((_KEPT, _home(p, parts), _pack(p, pos[mine], np.zeros(int(mine.sum()), U))))
        return pa.Table.from_batches([_record(rows)])
    return run


def _slices(table: pa.Table) -> Iterator[tuple]:
    """(slice, ids, keys and first words of its documents, positions and hashes of its kept windows in order)."""
    docs, kept = {}, {}
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"], strict=True):
        if kind == _DOCS:
            piece, *cols = _unpack(blob, np.int64, np.int64, np.int64)
            docs[piece] = cols
        else:
            piece, *cols = _unpack(blob, np.int32, U)
            kept.setdefault(piece, []).append(cols)
    for piece, got in kept.items():
        pos, h = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(pos)
        yield piece, docs[piece], pos[order], h[order]


def _double(length: int, longer: int, last: bool, parts: int) -> Callable:
    """Kept windows to candidates of the next length."""
    def run(table: pa.Table) -> pa.Table:
        rows, open_rows = _on(table, _DOCS), []
        for piece, (ids, _, first), pos, h in _slices(table):
            own = np.searchsorted(first, pos, "right") - 1
            follow = np.minimum(np.searchsorted(pos, pos + (longer - length)), len(pos) - 1)
            ok = (pos[follow] == pos + (longer - length)) & (own[follow] == own)
            pos, own, left, right = pos[ok], own[ok], h[ok], h[follow[ok]]
            if last:
                open_rows.append((np.full(len(pos), piece), pos, ids[own], left, right))
            else:
                rows += _candidates(piece, pos, own, tc.mix(tc.mix(left, 7) + right, 8), parts)
        if open_rows:
            rows += _decide(*(np.concatenate(x) for x in zip(*open_rows, strict=True)), parts)
        return pa.Table.from_batches([_record(rows)])
    return run


def _intervals(length: int) -> Callable:
    """The removed words of each document, as pairs of int32."""
    def run(table: pa.Table) -> pa.Table:
        out: dict[tuple[int, int], bytes] = {}
        for _, (ids, keys, first), pos, _ in _slices(table):
            own = np.searchsorted(first, pos, "right") - 1
            names, at = np.unique(own, return_index=True)
            for d, a, b in zip(names, at, [*at[1:], len(own)], strict=True):
                start = pos[a:b].astype(np.int64) - first[d]
                out[int(ids[d]), int(keys[d])] = np.stack(union(start, start + length), 1).astype(np.int32).tobytes()
        return pa.table({"id": pa.array([d for d, _ in out], pa.int64()), "key": pa.array([k for _, k in out], pa.int64()),
                         "removed": pa.array(list(out.values()), pa.binary())})
    return run


def find(docs: DataFrame, target: int, first: int = FIRST) -> DataFrame:
    """(id, key, removed): the word intervals to remove, for documents that have any. ``docs``: doc_id and text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(48, -(-size // RANGE))
    steps = lengths(target, first)
    rows = keyed(docs).select("id", "key", "__text").mapInArrow(_scan(steps[0], target, parts, SLICE), _PACKED)
    for i, length in enumerate(steps):
        last = i == len(steps) - 1
        kept = rows.groupBy("part").applyInArrow(_settled(parts) if last else _repeated(parts), _PACKED)
        kept = materialize(kept, f"doubling-{length}")
        if last or kept.where(F.col("kind") == _KEPT).isEmpty():
            break  # done, or no candidate survives
        rows = kept.groupBy("part").applyInArrow(_double(length, steps[i + 1], i + 2 == len(steps), parts), _PACKED)
    found = kept.groupBy("part").applyInArrow(_intervals(target), _FOUND)
    # repeated rows are found once for each copy, with the same words
    return materialize(found.dropDuplicates(["id", "key"]), "doubling-found")
