"""Top-N similarity join of sparse vectors (E6): blocks of queries against blocks of texts.

Texts are dealt by the hash of their id to parts of about ``TEXT_ROWS`` and queries to blocks of about ``QUERY_ROWS``; every
(part, block) pair is one group, so a group's memory is bounded at any table size. A group multiplies its two sides and keeps the
n best texts of each query, so at most queries x n x parts rows leave the groups, never one for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_ROWS = 4096
QUERY_ROWS = 1024
#: Scores are ranked at this many decimals, as the result is.
_DIGITS = 9
#: Texts multiplied at once.
_STEP = 512


def _dense(t: pa.Table, dims: int) -> np.ndarray:
    """The unit vectors of a table of (dims, counts, norm) rows."""
    at, counts = t["dims"].combine_chunks(), t["counts"].combine_chunks()
    n = np.diff(at.offsets.to_numpy())
    out = np.zeros((len(t), dims))
    own = np.repeat(np.arange(len(t)), n)
    norm = t["norm"].to_numpy()
    out[own, at.flatten().to_numpy()] = counts.flatten().to_numpy().astype(float) / norm[own]
    return out


def _best(n: int, id_col: str, dims: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(texts: pa.Table, queries: pa.Table) -> pa.Table:
        texts = texts.sort_by(id_col)  # ties go to the smaller id: a later text must be strictly better
        q = _dense(queries, dims) if len(texts) and len(queries) else np.zeros((0, dims))
        rank, score = np.zeros((len(q), n)), np.zeros((len(q), n))
        place = np.full((len(q), n), -1)
        for lo in range(0, len(texts) if len(q) else 0, _STEP):
            s = q @ _dense(texts.slice(lo, _STEP), dims).T
            r = np.round(s, _DIGITS)
            rows = np.flatnonzero((r > rank[:, -1:]).any(1))
            every = np.concatenate([rank[rows], r[rows]], 1)
            keep = np.argsort(-every, axis=1, kind="stable")[:, :n]
            rank[rows] = np.take_along_axis(every, keep, 1)
            score[rows] = np.take_along_axis(np.concatenate([score[rows], s[rows]], 1), keep, 1)
            here = np.broadcast_to(np.arange(lo, lo + s.shape[1]), (len(rows), s.shape[1]))
            place[rows] = np.take_along_axis(np.concatenate([place[rows], here], 1), keep, 1)
        own, col = np.nonzero(place >= 0)
        return pa.table({"qid": queries["qid"].take(pa.array(own)), id_col: texts[id_col].take(pa.array(place[own, col])),
                         "score": pa.array(score[own, col])})
    return run


def topn_join(queries: DataFrame, index: DataFrame, n: int, id_col: str, dims: int, text_rows: int = TEXT_ROWS,
              query_rows: int = QUERY_ROWS, n_texts: int | None = None) -> DataFrame:
    """``(qid, id_col, score)``: for each query and part of the texts, the n best texts with a positive score.

    Both sides are packed embeddings ``(key, dims, counts, norm)`` with unique keys; the best n over all parts are among the rows.
    ``n_texts`` saves counting the index where the caller knows about how many rows it has.
    """
    parts = max(1, -(-(index.count() if n_texts is None else n_texts) // text_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    cols = ["dims", "counts", "norm"]
    left = index.select(id_col, *cols, F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("qid", *cols, F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    types = f"qid {dict(queries.dtypes)['qid']}, {id_col} {dict(index.dtypes)[id_col]}, score double"
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_best(n, id_col, dims), types)
