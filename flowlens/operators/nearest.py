"""Exact k nearest neighbours among distinct vectors (E5) by a tree of cells that split where the data are dense.

Cells of more than ``CELL`` vectors are cut at quantiles of their widest dimension, round by round, until none is larger; a cell's
box is the range of its vectors. At most ``CELLS`` cells are aimed for (the cell size grows with the table beyond that), so the list
of boxes that tasks share stays small. Inside a task, a cell is split further into leaves of ``LEAF`` vectors by medians.

Every vector first meets its own cell; its k-th distance so far bounds its true one. The other cells, ordered by the distance of
their box, can hold a nearer vector only up to that bound: the next ``STEP`` of them are visited, the bound shrinks, and so on until
no cell within the bound is left. Leaves inside a cell are skipped in the same way. So the vectors a point is compared with are
those of the leaves around it, whether it lies in a dense core or far out.

Distances are rounded to 9 decimals, ties go to the smaller tie key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialize

CELL, CELLS, FAN = 1024, 16384, 8
LEAF = 64
STEP = 8
#: Queries that one group holds, about.
QUERIES = 8192
DIGITS = 9
_SLACK = 2 * 10.0 ** -DIGITS  # rounded distances may be equal though the box is this much further


def cells(vectors: DataFrame, dims: list[str], n: int, cell: int = CELL) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(the vectors with their ``cell``, boxes as (cells, 2, dims) of lower and upper ends, vectors in each cell)."""
    cell = max(cell, n // CELLS)
    low_high = [f(c).alias(f"{p}{c}") for p, f in (("l", F.min), ("h", F.max)) for c in dims]
    x = vectors.withColumn("cell", F.lit(0))
    while True:
        boxes = sorted(x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *low_high).collect())
        wide = {r.cell: max(dims, key=lambda c: r["h" + c] - r["l" + c]) for r in boxes if r.n > cell}
        # whole at last: renumber without gaps
        if not wide:
            number = x.sparkSession.createDataFrame([(r.cell, i) for i, r in enumerate(boxes)], "cell int, number int")
            x = x.join(F.broadcast(number), "cell").drop("cell").withColumnRenamed("number", "cell")
            ends = np.array([[[r[p + c] for c in dims] for p in "lh"] for r in boxes], float).reshape(len(boxes), 2, len(dims))
            return materialize(x, "cells"), ends, np.array([r.n for r in boxes])
        to = x.sparkSession.createDataFrame([(c, dims.index(d)) for c, d in wide.items()], "cell int, at int")
        x = x.join(F.broadcast(to), "cell", "left")
        value = F.get(F.array(*dims), F.col("at"))
        shares = [i / FAN for i in range(1, FAN)]
        cuts = x.where("at is not null").groupBy("cell").agg(
            F.percentile_approx(value, shares, 1000).alias("q"), F.min(value).alias("low"), F.max(value).alias("top"))
        # a cut at the largest value would leave nothing above it; equal cuts are one; the smallest value always cuts
        some = F.array_distinct(F.filter("q", lambda v: v < F.col("top")))
        cuts = cuts.select("cell", F.when(F.size(some) > 0, some).otherwise(F.array("low")).alias("q"))
        x = x.join(F.broadcast(cuts), "cell", "left")
        below = F.when(F.col("at").isNull(), 0).otherwise(F.size(F.filter("q", lambda v: v < value)))
        x = materialize(x.withColumn("cell", (F.col("cell") * FAN + below).cast("int")).drop("at", "q"), "cells-round")
        ids = {r.cell: i for i, r in enumerate(sorted(x.select("cell").distinct().collect()))}
        number = x.sparkSession.createDataFrame(list(ids.items()), "cell int, number int")
        x = x.join(F.broadcast(number), "cell").drop("cell").withColumnRenamed("number", "cell")


def box_distance(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distance of each point to each box (0 inside)."""
    out = np.zeros((len(points), len(ends)))
    for i in range(points.shape[1]):
        p = points[:, i:i + 1]
        out += np.maximum(np.maximum(ends[None, :, 0, i] - p, p - ends[None, :, 1, i]), 0) ** 2
    return np.sqrt(out)


def _columns(t: pa.Table, dims: list[str]) -> np.ndarray:
    return np.column_stack([t[c].to_numpy() for c in dims]) if len(t) else np.zeros((0, len(dims)))


def _next_cells(dims: list[str], ends, step: int):
    """The cells that each query visits next: (vid, cell, the query's columns), and how many it has then seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = ends.value
        for b in batches:
            t = pa.Table.from_batches([b])
            for lo in range(0, len(t), 512):
                part = t.slice(lo, 512)
                own, seen, bound = (part[c].to_numpy() for c in ("cell", "seen", "bound"))
                far = box_distance(_columns(part, dims), box)
                far[np.arange(len(part)), own] = -1.0  # its own cell is the first
                order = np.argsort(far, axis=1, kind="stable")
                place = seen[:, None] + np.arange(step)[None, :]
                inside = place < len(box)
                to = np.take_along_axis(order, np.minimum(place, len(box) - 1), 1)
                near = np.take_along_axis(far, to, 1) <= bound[:, None] + _SLACK
                row, col = np.nonzero(inside & near)
                yield pa.RecordBatch.from_arrays(
                    [part["vid"].combine_chunks().take(pa.array(row)), pa.array(to[row, col].astype(np.int32)),
                     *[part[c].combine_chunks().take(pa.array(row)) for c in (*dims, "bound")]],
                    ["vid", "cell", *dims, "bound"])
    return run


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of blocks of at most ``size`` points, halved at the median of the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        x = points[rows]
        rows = rows[np.argsort(x[:, np.argmax(np.ptp(x, axis=0))], kind="stable")]
        todo += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
    return out


def _nearest(dims: list[str], k: int):
    """Each query's k nearest (copies counted) of one cell, within its bound; a row without vid counts the pairs compared."""
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        data = data.sort_by("tie")  # a smaller place is a smaller tie key
        points, asked = _columns(data, dims), _columns(queries, dims)
        vid, mult, who = data["vid"].to_numpy(), data["mult"].to_numpy(), queries["vid"].to_numpy()
        leaves = [np.sort(rows) for rows in _leaves(points, max(LEAF, 2 * k + 2))] if len(data) and len(queries) else []
        ends = np.array([[points[r].min(0), points[r].max(0)] for r in leaves]).reshape(len(leaves), 2, len(dims))
        far = box_distance(asked, ends)
        bound = queries["bound"].to_numpy().copy()
        room = k + 1  # each candidate but the query itself counts at least once
        dist = np.full((len(asked), room), np.inf)
        place = np.full((len(asked), room), np.iinfo(np.int64).max)
        pairs = 0
        # every query's nearest leaf first, so that its bound is tight before it looks at others
        first = far.argmin(1) if leaves else np.zeros(0, int)
        for turn in (0, 1):
            for i, rows in enumerate(leaves):
                q = np.flatnonzero(first == i) if turn == 0 else np.flatnonzero((first != i) & (far[:, i] <= bound + _SLACK))
                pairs += len(q) * len(rows)
                for lo in range(0, len(q), 1024):
                    s = q[lo:lo + 1024]
                    d = np.zeros((len(s), len(rows)))
                    for j in range(len(dims)):
                        d += (asked[s, j][:, None] - points[rows, j][None, :]) ** 2
                    d = np.concatenate([dist[s], np.round(np.sqrt(d), DIGITS)], 1)
                    at = np.concatenate([place[s], np.broadcast_to(rows, (len(s), len(rows)))], 1)
                    keep = np.lexsort((at, d))[:, :room]
                    dist[s], place[s] = np.take_along_axis(d, keep, 1), np.take_along_axis(at, keep, 1)
                    some = np.isfinite(dist[s])
                    at = np.where(some, place[s], 0)
                    copies = np.where(some, mult[at] - (vid[at] == who[s][:, None]), 0).cumsum(1)
                    kth = np.where((copies >= k).any(1), np.take_along_axis(dist[s], (copies >= k).argmax(1)[:, None], 1)[:, 0], np.inf)
                    bound[s] = np.minimum(bound[s], kth)
        row, col = np.nonzero(np.isfinite(dist) & (dist <= bound[:, None]))
        at = place[row, col]
        avail = mult[at] - (vid[at] == who[row])
        row, col, at, avail = (x[avail > 0] for x in (row, col, at, avail))
        return pa.table({"vid": pa.array(np.append(who[row], 0), mask=np.append(np.zeros(len(row), bool), True)),
                         "nid": np.append(vid[at], 0), "dist": np.append(dist[row, col], 0.0), "avail": np.append(avail, pairs),
                         "tie": pa.concat_arrays([data["tie"].combine_chunks().take(pa.array(at)).cast(pa.string()),
                                                  pa.nulls(1, pa.string())])})
    return run


def knn(vectors: DataFrame, dims: list[str], n: int, k: int, cell: int = CELL, stats: list | None = None) -> DataFrame:
    """``vid, nid, dist, take``: ``take`` copies of neighbour vector ``nid``; the takes of a vid sum to k.

    ``vectors``: ``vid``, the ``dims``, ``mult`` (copies) and ``tie``, ``n`` rows that hold more than k copies besides each
    vector. With ``stats``, the number of compared pairs of each round is appended.
    """
    spark = vectors.sparkSession
    data, ends, sizes = cells(vectors.select("vid", *dims, "mult", F.col("tie").cast("string").alias("tie")), dims, n, cell)
    shared = spark.sparkContext.broadcast(ends)
    types = ", ".join(f"{c} double" for c in dims)
    state = data.select("vid", *dims, "cell", F.lit(float("inf")).alias("bound"), F.lit(0).alias("seen"))
    best = None
    for it in range(len(sizes) + 1):
        step = 1 if it == 0 else STEP
        visits = materialize(state.mapInArrow(_next_cells(dims, shared, step), f"vid long, cell int, {types}, bound double"), "visits")
        load = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).select("cell", F.ceil(F.col("m") / QUERIES).cast("int").alias("g"))
        # a cell that many ask is many groups; cells without visits have no row
        ask = visits.join(load, "cell").withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("g")).cast("int"))
        have = data.join(load.select(F.col("cell").alias("of"), F.col("g").alias("groups")), F.col("cell") == F.col("of"))
        have = have.drop("of").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        new = ask.groupBy("cell", "chunk").cogroup(have.groupBy("cell", "chunk")).applyInArrow(
            _nearest(dims, k), "vid long, nid long, dist double, avail long, tie string")
        new = materialize(new, "found")
        if stats is not None:
            stats.append(new.where("vid is null").agg(F.sum("avail")).first()[0] or 0)
        every = new.where("vid is not null")
        every = every if best is None else every.unionByName(best)
        cum = F.sum("avail").over(Window.partitionBy("vid").orderBy("dist", "tie").rowsBetween(Window.unboundedPreceding, 0))
        best = every.withColumn("cum", cum).where(F.col("cum") - F.col("avail") < k).drop("cum")
        best = materialize(best, "best")
        kth = best.groupBy("vid").agg(F.when(F.sum("avail") >= k, F.max("dist")).otherwise(float("inf")).alias("bound"))
        left = visits.groupBy("vid").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == step).select("vid")
        # who had fewer cells within the bound than it may visit has seen them all
        state = (state.drop("bound").withColumn("seen", F.col("seen") + step).join(left, "vid", "left_semi")
                 .join(kth, "vid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
        state = materialize(state.select("vid", *dims, "cell", "bound", "seen"), "state")
        if len(sizes) <= 1 + it * STEP or state.isEmpty():
            break
    cum = F.sum("avail").over(Window.partitionBy("vid").orderBy("dist", "tie").rowsBetween(Window.unboundedPreceding, 0))
    best = best.withColumn("cum", cum)
    return best.select("vid", "nid", "dist", F.least(F.col("avail"), F.lit(k) - (F.col("cum") - F.col("avail"))).alias("take"))
