"""Distributed search for windows of ``length`` units that also start in a document with a smaller doc_id.

Units are bytes or words. Sorting every suffix would shuffle several times the corpus, so only one suffix per *run* is sent:
the windows of a document are cut into runs that share the position of their smallest ``gram``-unit hash (the run's sync
point). Which sync point a window has depends on its own units alone, so equal windows always meet in the same gram group,
whatever surrounds them; nothing is sampled away. Then

1. gram groups seen in one document only are dropped; within the others, runs of equal content are settled as a whole
   (all their windows repeat, those in the smallest document stay);
2. gram groups with different contents (the borders of a passage, an edited word) keep one run for each content, and their
   windows are compared one by one over exactly ``length`` units, but for those whose part before (after) the gram occurs
   in no other document.

Rows travel as packed arrays, one row for a slice of documents and a hash range. Equal runs of a slice are settled before the
shuffle, so a passage that a third of all documents share arrives once a slice, not once a document. Range and part numbers
follow the corpus size. Hash ranges spread grams, not the runs of one gram, so the runs of each gram are counted first: a gram
with more than ``HOT_ROWS`` of them (a frequent line shorter than a window, in different surroundings) is dealt by (gram,
content) instead. Equal runs still meet there; as no task sees such a gram whole, all that stays of it is compared window by
window, which needs no digits. No task holds a hot gram, and which grams are hot changes the dealing, never the result.

A document is known by (doc_id, hash of doc_id and text): rows that share a doc_id don't remove each other's windows, and a
null doc_id counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textcore as tc
from flowlens.llm.stages import materialize

U = np.uint64
_NONE = U(0xFFFFFFFFFFFFFFFF)
_POS = U((1 << 22) - 1)
NULL_ID = np.iinfo(np.int64).max
#: Text bytes of a slice (packed together) and of a hash range.
SLICE = 16 << 20
#: Runs of one gram from which it is dealt by content, and runs in a slice from which a slice reports the gram. What no slice
#: reports has fewer than LEAST runs a slice.
HOT_ROWS, LEAST = 1 << 18, 4
#: Rows of packed arrays: kind 0 removed intervals, 1 runs to compare window by window, 2 runs to settle, 3 those of hot grams.
_PACKED = "kind int, part int, blob binary"


def sync_runs(codes: np.ndarray, off: np.ndarray, length: int, gram: int,
              table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut all windows into runs: (first window, windows - 1, sync point after the first window, gram hash, content hash,
    left and right digit).

    The digits hash the gram with as many units before (after) it as every second window has at least; a window has one of
    the two in full, so a run that shares neither with another document has no repeated window.
    """
    found = [(*np.zeros((3, 0), np.int64), *np.zeros((2, 0), U), *np.zeros((2, 0), np.uint16))]
    side = -(-(length - gram) // 2)
    windows = len(codes) - length + 1
    short_from = np.maximum(off[1:] - length + 1, off[:-1])  # starts from here to the document's end don't fit
    for c0 in range(0, max(windows, 0), tc.CHUNK):
        c1 = min(c0 + tc.CHUNK, windows)
        part = codes[c0:c1 + length - 1]
        x = table[part] if table is not None else part
        up, down = tc.powers(len(x) + 1)
        total = np.zeros(len(x) + 1, U)
        np.cumsum(x * up[:-1], out=total[1:])
        g = (total[gram:] - total[:-gram]) * down[:len(x) - gram + 1]
        m = g & ~_POS
        m |= np.arange(len(m), dtype=U)
        span, w = 1, length - gram + 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < w:
            m = np.minimum(m[:len(m) - (w - span)], m[w - span:])
        first = int(np.searchsorted(off, c0, "right")) - 1
        for d in range(max(first, 0), len(off) - 1):
            if off[d] >= c1:
                break
            m[max(int(short_from[d]) - c0, 0):max(int(off[d + 1]) - c0, 0)] = _NONE
        lo = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        n = np.diff(np.concatenate([lo, [len(m)]])) - 1
        ok = m[lo] != _NONE
        lo, n = lo[ok], n[ok]
        at = (m[lo] & _POS).astype(np.int64)
        content = (total[lo + n + length] - total[lo]) * down[lo]
        content = tc.mix(content ^ ((at - lo).astype(U) << U(32)) ^ n.astype(U))
        digits = []
        for a, b in ((np.maximum(at - side, 0), at + gram), (at, np.minimum(at + gram + side, len(x)))):
            fits = (b - a == gram + side) & (a >= lo) & (b <= lo + n + length)
            digit = tc.mix((total[b] - total[a]) * down[a], 2)
            digits.append((np.where(fits, digit, content) >> U(48)).astype(np.uint16))
        found.append((lo + c0, n, at - lo, tc.mix(g[at], 1), content, *digits))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge intervals that overlap or touch."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def pack(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, *cols: np.ndarray) -> bytes:
    """Arrays of documents (id, key, rows) and of rows as one value."""
    parts = [np.array([len(ids), len(cols[0]), *(c.dtype.itemsize for c in cols)], np.int64), ids, keys, counts, *cols]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def unpack(blob: bytes, *kinds: type) -> tuple[np.ndarray, ...]:
    """(id and key of each row, the row arrays)."""
    head = np.frombuffer(blob, np.int64, 2 + len(kinds))
    docs, rows, at = int(head[0]), int(head[1]), head.nbytes
    out = []
    for kind, n in [(np.int64, docs), (np.int64, docs), (np.int64, docs), *((k, rows) for k in kinds)]:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    ids, keys, counts, *cols = out
    return np.repeat(ids, counts), np.repeat(keys, counts), *cols


def _by_doc(ids: np.ndarray, keys: np.ndarray, *cols: np.ndarray) -> bytes:
    """Pack rows that stand document by document."""
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]))
    return pack(ids[new], keys[new], np.diff(np.concatenate([new, [len(ids)]])), *cols)


def _split(kind: int, part: np.ndarray, parts: int, ids: np.ndarray, keys: np.ndarray, *cols: np.ndarray) -> list[tuple]:
    """Rows to one packed value for each part."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1)) if parts < len(part) else None
    if at is None:
        names, first = np.unique(part[order], return_index=True)
        pieces = zip(names, first, [*first[1:], len(part)], strict=True)
    else:
        pieces = ((p, at[p], at[p + 1]) for p in np.flatnonzero(np.diff(at)))
    return [(kind, int(p), _by_doc(ids[o], keys[o], *(c[o] for c in cols))) for p, a, b in pieces for o in [order[a:b]]]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _doc_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return _part_of(tc.mix(keys.view(U) if keys.dtype == np.int64 else keys, 3), parts)


def _spans_out(ids: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int, kind: int = 0) -> list[tuple]:
    if not len(ids):
        return []
    order = np.lexsort((lo, ids, keys))
    ids, keys, lo, hi = ids[order], keys[order], lo[order], hi[order]
    return _split(kind, _doc_part(keys, parts), parts, ids, keys, lo.astype(np.int32), hi.astype(np.int32))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    k, p, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(b, pa.binary())],
                                      ["kind", "part", "blob"])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and each group's first place in it."""
    order = np.argsort(key)
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _several(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which rows have an equal key on a row with another value."""
    order, first = _groups(key)
    out = np.zeros(len(key), bool)
    if len(order):
        v = values[order]
        out[order] = np.repeat(np.minimum.reduceat(v, first) < np.maximum.reduceat(v, first),
                               np.diff(np.concatenate([first, [len(order)]])))
    return out


def _settle(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows have an equal key in a document with a smaller id."""
    order, first = _groups(key)
    if not len(order):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(ids[order], first)
    later = np.empty(len(ids), bool)
    later[order] = ids[order] > np.repeat(least, np.diff(np.concatenate([first, [len(order)]])))
    return later


def _runs(unit, length: int, gram: int, data: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document of each run, whether the run is settled within its slice, the runs with windows counted in their document)."""
    codes, uoff, table = unit.codes(data, off)
    lo, n, sync, g, content, left, right = sync_runs(codes, uoff, length, gram, table)
    own = np.searchsorted(uoff, lo, "right") - 1
    return own, _settle(ids[own], _whole(g, content)), lo - uoff[own], n, sync, g, content, left, right


def _whole(g: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One key of a run's gram and content."""
    return g + content * U(0x9FB21C651E98DF25)


def _counts(unit, length: int, gram: int, least: int) -> Callable:
    """(g, n) of the grams with at least ``least`` runs to send in a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text", SLICE):
            later, g = itemgetter(1, 5)(_runs(unit, length, gram, data, off, tc.ints(rows.column(0), NULL_ID)))
            names, n = np.unique(g[~later], return_counts=True)
            many = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(names[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["g", "n"])
    return run


def hot_grams(rows: DataFrame, unit, length: int, gram: int) -> np.ndarray:
    """The sorted hashes of grams with more than ``HOT_ROWS`` runs: at most one for each ``HOT_ROWS`` runs of the corpus."""
    counts = rows.mapInArrow(_counts(unit, length, gram, LEAST), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    found = [r.g for r in counts.where(F.col("n") > HOT_ROWS).select("g").collect()]
    return np.sort(np.array(found, np.int64).view(U))


def _in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _scan(unit, length: int, gram: int, parts: int, hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text", SLICE):
            ids, keys = tc.ints(rows.column(0), NULL_ID), tc.ints(rows.column(1), 0)
            own, later, lo, n, sync, g, content, left, right = _runs(unit, length, gram, data, off, ids)
            out = []
            if later.any():  # settled here: consecutive runs become one interval
                o, a, b = own[later], lo[later], lo[later] + n[later] + length
                wide = int(b.max()) + 2
                a, b = union(o * wide + a, o * wide + b)
                o = a // wide
                out = _spans_out(ids[o], keys[o], a - o * wide, b - o * wide, parts)
            dealt = ~later & _in(g, hot)
            if dealt.any():
                o, whole = own[dealt], _whole(g[dealt], content[dealt])
                out += _split(3, _part_of(tc.mix(whole, 16), parts), parts, ids[o], keys[o], whole, lo[dealt].astype(np.int32),
                              n[dealt].astype(_small(length)))
            keep = ~later & ~dealt
            own, lo, n, sync, g, content, left, right = (x[keep] for x in (own, lo, n, sync, g, content, left, right))
            out += _split(2, _part_of(g, parts), parts, ids[own], keys[own], g, content, lo.astype(np.int32),
                          n.astype(_small(length)), sync.astype(_small(length)), left, right)
            yield _record(out)
    return run


def _small(length: int) -> type:
    return np.uint8 if length < 256 else np.uint16


def _meet(length: int, gram: int, parts: int) -> Callable:
    """Settle the runs of one hash range; pass on intervals settled before."""
    small, side = _small(length), -(-(length - gram) // 2)

    def run(table: pa.Table) -> pa.Table:
        rows, got, dealt = [], [], []
        for kind, part, blob in zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["blob"], strict=True):
            if kind == 2:
                got.append(unpack(blob.as_buffer(), U, U, np.int32, small, small, np.uint16, np.uint16))
            elif kind == 3:
                dealt.append(unpack(blob.as_buffer(), U, np.int32, small))
            else:
                rows.append((kind, part, blob.as_py()))
        if got:
            cols = tuple(np.concatenate(x) for x in zip(*got, strict=True))
            del got
            keep = _several(cols[2], cols[0])
            ids, keys, g, content, lo, n, sync, left, right = (x[keep] for x in cols)
            later = _settle(ids, _whole(g, content))
            lo, n, sync = (x.astype(np.int64) for x in (lo, n, sync))
            rows += _spans_out(ids[later], keys[later], lo[later], (lo + n + length)[later], parts)
            ids, keys, g, content, lo, n, sync, left, right = (x[~later] for x in (ids, keys, g, content, lo, n, sync, left, right))
            mixed = _several(g, content)
            before, after = (_several(tc.mix(g ^ x, i), ids) & mixed for i, x in ((3, left), (4, right)))
            # the windows that hold the whole left part, and those that hold the whole right part
            for pick, a, b in ((before, lo, np.minimum(lo + sync - side, lo + n) + 1),
                               (after, np.maximum(lo, lo + sync - (length - gram - side)), lo + n + 1)):
                pick = pick & (a < b)
                rows += _spans_out(ids[pick], keys[pick], a[pick], b[pick], parts, kind=1)
        if dealt:
            ids, keys, whole, lo, n = (np.concatenate(x) for x in zip(*dealt, strict=True))
            later = _settle(ids, whole)
            lo, n = lo.astype(np.int64), n.astype(np.int64)
            rows += _spans_out(ids[later], keys[later], lo[later], (lo + n + length)[later], parts)
            rows += _spans_out(ids[~later], keys[~later], lo[~later], (lo + n + 1)[~later], parts, kind=1)
        return pa.Table.from_batches([_record(rows)])
    return run


def _gather(table: pa.Table) -> pa.Table:
    """The intervals of each document of a part, merged: kind 0 as ``removed``, kind 1 as ``open``."""
    kinds = table["kind"].to_numpy()
    per: dict[int, tuple] = {}
    for kind in (0, 1):
        got = [unpack(b.as_buffer(), np.int32, np.int32) for b, k in zip(table["blob"], kinds, strict=True) if k == kind]
        if got:
            ids, keys, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((lo, ids, keys))
            per[kind] = tuple(x[order] for x in (ids, keys, lo, hi))
    out: dict[tuple[int, int], list] = {}
    for kind, (ids, keys, lo, hi) in per.items():
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]))
        for a, b in zip(new, [*new[1:], len(ids)], strict=True):
            x = union(lo[a:b].astype(np.int64), hi[a:b].astype(np.int64))
            out.setdefault((int(ids[a]), int(keys[a])), [None, None])[kind] = np.stack(x, 1).astype(np.int32).tobytes()
    docs = list(out)
    return pa.table({"id": pa.array([d[0] for d in docs], pa.int64()), "key": pa.array([d[1] for d in docs], pa.int64()),
                     "removed": pa.array([out[d][0] for d in docs], pa.binary()),
                     "open": pa.array([out[d][1] for d in docs], pa.binary())})


_GATHERED = "id long, key long, removed binary, open binary"


def _single(unit, length: int, parts: int) -> Callable:
    """The windows of open runs, each with its digits, to hash ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text", SLICE // 4):
            ids, keys = tc.ints(rows.column(0), NULL_ID), tc.ints(rows.column(1), 0)
            codes, uoff, table = unit.codes(data, off)
            at, own = [], []
            for d, x in enumerate(rows.column(rows.schema.get_field_index("open"))):
                for lo, hi in np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2):
                    at.append(np.arange(lo, hi) + uoff[d])
                    own.append(np.full(hi - lo, d))
            if at:
                at, own = np.concatenate(at), np.concatenate(own)
                digits = unit.digits(codes, table, at, length)
                h = digits[0].copy()
                for x in digits[1:]:
                    h = tc.mix(h ^ x, 5)
                lo, later = at - uoff[own], _settle(ids[own], h)
                o = own[later]
                out = _spans_out(ids[o], keys[o], lo[later], lo[later] + length, parts)
                own, lo, h, *digits = (x[~later] for x in (own, lo, h, *digits))
                yield _record(out + _split(2, _part_of(tc.mix(h, 6), parts), parts, ids[own], keys[own], lo.astype(np.int32), *digits))
    return run


def _equal_groups(ids: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    """Most-significant-digit passes: order by one digit after the other within equal groups, single rows drop out early.

    Returns which rows equal, in all digits, a row of a document with a smaller id."""
    live = np.arange(len(ids))
    group = np.zeros(len(ids), np.int64)
    for d in digits:
        order = np.lexsort((d[live], group))
        live, group = live[order], group[order]
        x = d[live]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (x[1:] != x[:-1])]) if len(live) else np.zeros(0, bool)
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1 if len(live) else np.zeros(0, bool)
        live, group = live[many], group[many]
    later = np.zeros(len(ids), bool)
    if len(live):
        least = np.full(int(group.max()) + 1, NULL_ID)
        np.minimum.at(least, group, ids[live])
        later[live] = ids[live] > least[group]
    return later


def _meet_single(length: int, parts: int, n_digits: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = [(k, p, b.as_py()) for k, p, b in zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["blob"], strict=True)
                if k == 0]
        got = [unpack(b.as_buffer(), np.int32, *[U] * n_digits) for k, b in zip(table["kind"].to_pylist(), table["blob"], strict=True) if k]
        if got:
            ids, keys, lo, *digits = (np.concatenate(x) for x in zip(*got, strict=True))
            later = _equal_groups(ids, digits)
            lo = lo[later].astype(np.int64)
            rows += _spans_out(ids[later], keys[later], lo, lo + length, parts)
        return pa.Table.from_batches([_record(rows)])
    return run


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, kept columns, __text) of every row."""
    key = F.xxhash64(F.col("doc_id"), F.col("text")).alias("key")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), key,
                       *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))


def find(docs: DataFrame, unit, length: int, gram: int) -> DataFrame:
    """(id, key, removed): the intervals of units to remove, for documents that have any. ``docs``: doc_id and text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(48, -(-size // unit.range_bytes))
    rows = keyed(docs).select("id", "key", "__text")
    # a gram has at most as many runs as the texts have bytes
    hot = hot_grams(rows, unit, length, gram) if size > HOT_ROWS else np.zeros(0, U)
    runs = rows.mapInArrow(_scan(unit, length, gram, parts, hot), _PACKED)
    settled = materialize(runs.groupBy("part").applyInArrow(_meet(length, gram, parts), _PACKED), "repeats-settled")
    first = materialize(settled.groupBy("part").applyInArrow(_gather, _GATHERED), "repeats-open")
    # one join strategy at every size: texts are never broadcast, nor is what grows with them
    opened = first.where("open is not null").select("id", "key", "open").hint("merge")
    todo = rows.join(opened, ["id", "key"]).select("id", "key", "open", "__text")
    windows = todo.mapInArrow(_single(unit, length, parts), _PACKED)
    more = windows.groupBy("part").applyInArrow(_meet_single(length, parts, unit.n_digits), _PACKED)
    again = settled.where("kind = 0").unionByName(more)
    return materialize(again.groupBy("part").applyInArrow(_gather, _GATHERED).select("id", "key", "removed"), "repeats-found")


def with_intervals(docs: DataFrame, found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, kept columns as c0.., __text, removed) of every row, ``removed`` null where nothing goes."""
    return keyed(docs, keep).join(found.hint("merge"), ["id", "key"], "left")
