"""Operator 3: packing token pieces into sequences by Karmarkar-Karp multiway differencing.

Documents become ids (see ``token_ids``) plus an end id. Whole windows of ``capacity`` ids are cut off as sequences of their
own; the rest of a document is cut into pieces of at most ``PIECE`` ids. Pieces are dealt by row number, not by content, into
groups of about ``GROUP_WINDOWS`` windows, so a group is bounded however documents repeat. In a group, multiway differencing
starts with one partial partition for each piece and always merges the two with the largest imbalance, largest part onto
smallest, which gives near-equal windows; the window count rises by one whenever a window would exceed the capacity.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; a null doc_id is
carried along; an empty table gives no pieces; other input columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textcore as tc
from flowlens.llm.stages import materialize
from flowlens.llm.token_ids import Encoder

CAPACITY = 4096
END = 2
PIECE = 512
GROUP_WINDOWS = 128


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of ``sizes`` in k near-equal parts."""
    # a partial partition: (-imbalance, number, part sums descending with the least taken off, parts as nested pairs)
    heap: list = []
    for i, x in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = x
        heap.append((-x if k > 1 else 0, i, sums, [i, *[None] * (k - 1)]))
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        s = a + b[::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        s -= s[-1]
        pairs = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y), strict=True)]
        heapq.heappush(heap, (-int(s[0]), at, s, [pairs[i] for i in order.tolist()]))
        at += 1
    out = []
    for tree in heap[0][3] if heap else []:
        part, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            elif t is not None:
                part.append(t)
        out.append(part)
    return out


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: as few as differencing finds, counting up from the least possible."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids) of every piece; ``ids`` is null without ``with_ids``. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for rows, data, off in tc.slices(batches, "__text", 2 << 20):
            ids, io = encoder.encode(data, off, END)
            doc, start, length = [], [], []
            for d, n in enumerate(np.diff(io).tolist()):
                full = n // capacity * capacity
                cuts = [*range(0, full, capacity), *range(full, n, piece), n]
                doc += [d] * (len(cuts) - 1)
                start += cuts[:-1]
                length += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
            doc, start, length = np.array(doc, np.int64), np.array(start, np.int64), np.array(length, np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (io[doc] + start) * 4
            parts = [raw[a:b] for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
                 pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(np.diff(io)[doc].astype(np.int64)),
                 pa.array([bytes(p) for p in parts] if with_ids else [None] * len(parts), pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Every piece with its sequence and its place there (``sequence_id``, ``offset``)."""
    cut = pieces(docs, tokenizer, capacity, min(PIECE, capacity), with_ids)
    rows = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = rows.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (GROUP_WINDOWS * capacity)))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_pylist()
        windows = pack_group(sizes, capacity)
        order = np.array([i for w in windows for i in w], np.int64)
        number = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        size = np.array(sizes, np.int64)[order]
        ends = np.cumsum(size)
        first = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1]).astype(np.int64)
        offset = ends - size - (ends - size)[first][number]
        group = table["group"][0].as_py()
        return pa.table({"row": table["row"].take(pa.array(order)), "sequence_id": pa.array(number * groups + group),
                         "offset": pa.array(offset)})

    placed = rest.select("row", "length", "group").groupBy("group").applyInArrow(run, "row long, sequence_id long, offset long")
    whole = rows.where(F.col("length") == capacity).select(
        "row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.join(placed.unionByName(whole), "row").drop("row")


def op3_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's digest of the packing (pieces without their ids)."""
    return pack(docs, tokenizer, with_ids=False).drop("ids")
