"""Operator 9: toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased) and their first
``PREFIXES`` bytes, so that inflected forms share an input; each is hashed to one of ``BUCKETS`` inputs. The machine has a weight and a vector of ``RANK`` numbers for each input; the vectors' products are the
learned pairwise interactions. Fitted with proximal steps on at most ``TRAIN_ROWS`` labelled documents; inputs seen in fewer
than ``LEAST`` of them, whose slope at zero stays under the penalty, or without effect, have no parameters, so the model is
bounded by the sample.

Defined cases: a null or empty text has no terms and scores by the intercept; without labels of both classes the score is
0.5; repeated rows get equal scores; a null doc_id is not held out and never fitted on; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import labelled
from flowlens.llm import textcore as tc

TRAIN_ROWS, EPOCHS, BATCH = 6000, 20, 256
BITS, RANK, LEAST = 22, 4, 6
BUCKETS = 1 << BITS
PREFIXES = (4, 5, 6, 7, 8)
RATE, L1_W, L1_V, L2 = 0.1, 6e-3, 3e-3, 1e-5
PREDICT = 0.7
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def terms(data: np.ndarray, off: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct inputs of each document in order, end to end, and each document's first one; of ``known`` ones only, if given."""
    low = tc.LOWER[data]
    inside = _TERM[low]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    begins[off[:-1][full]] = inside[off[:-1][full]]
    ends[off[1:][full] - 1] = inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    own = np.searchsorted(off, starts, "right") - 1
    keys = []
    for n in (0, *PREFIXES):
        some = slice(None) if n == 0 else np.flatnonzero(ends - starts > n)
        h = (tc.span_hash(low, starts[some], starts[some] + n if n else ends, 9 + n) >> np.uint64(64 - BITS)).astype(np.int64)
        if known is None:
            keys.append(own[some] * BUCKETS + h)
        else:
            hit = known[h]
            keys.append(own[some][hit] * BUCKETS + h[hit])
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key % BUCKETS, np.searchsorted(key // BUCKETS, np.arange(len(off)))


def _rows_sum(x: np.ndarray, so: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
    return total[so[1:]] - total[so[:-1]]


def _logit(at: np.ndarray, so: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    s = _rows_sum(v[at], so)
    return b + _rows_sum(w[at], so) + 0.5 * (s * s - _rows_sum(v[at] ** 2, so)).sum(1), s


def fit(docs: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> dict | None:
    """Proximal Adagrad with a threshold on weights and on whole vectors; both classes weigh the same."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    every = np.concatenate(docs)
    pull = np.repeat((y - 0.5) * weight / len(y), [len(d) for d in docs])
    slope = np.abs(np.bincount(every, pull, BUCKETS))
    ids = np.flatnonzero((np.bincount(every, minlength=BUCKETS) >= LEAST) & (slope > L1_W / 2))
    rows = [np.searchsorted(ids, d[np.isin(d, ids, assume_unique=True)]) for d in docs]
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(ids)), rng.standard_normal((len(ids), RANK)) * 0.01, 0.0
    gw, gv, gb = np.full(len(ids), 1e-6), np.full((len(ids), RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            pick = order[k:k + BATCH]
            so = np.concatenate([[0], np.cumsum([len(rows[i]) for i in pick])])
            at = np.concatenate([rows[i] for i in pick]).astype(np.int64)
            z, s = _logit(at, so, w, v, b)
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            d = np.repeat(dz, np.diff(so))
            dw = np.bincount(at, d, len(ids)) + L2 * w
            pull = d[:, None] * (np.repeat(s, np.diff(so), 0) - v[at])
            dv = np.stack([np.bincount(at, pull[:, r], len(ids)) for r in range(RANK)], 1) + L2 * v
            gw, gv, gb = gw + dw ** 2, gv + dv ** 2, gb + dz.sum() ** 2
            w = w - RATE * dw / np.sqrt(gw)
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1_W / np.sqrt(gw), 0)
            v = v - RATE * dv / np.sqrt(gv)
            size = np.sqrt((v ** 2).sum(1))
            cut = RATE * L1_V / np.sqrt(gv.mean(1))
            v = v * (np.maximum(size - cut, 0) / np.maximum(size, 1e-12))[:, None]
            b -= RATE * dz.sum() / gb ** 0.5
    used = (w != 0) | (v != 0).any(1)
    return {"ids": ids[used], "w": w[used], "v": v[used], "b": float(b)}


def scores(data: np.ndarray, off: np.ndarray, m: dict) -> np.ndarray:
    """The probability of each document."""
    known = np.zeros(BUCKETS, bool)
    known[m["ids"]] = True
    h, so = terms(data, off, known)
    z, _ = _logit(np.searchsorted(m["ids"], h), so, m["w"], m["v"], m["b"])
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row. The model is bounded by the training sample and travels with the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text"):
            p = np.full(rows.num_rows, 0.5) if model is None else scores(data, off, model)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(run, f"doc_id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """Fit on the bounded sample; tasks turn its texts into inputs, the driver sees input numbers only."""
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tc.slices(batches, "text"):
            h, so = terms(data, off)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1),
                 pa.array([h[a:b].astype(np.int32).tobytes() for a, b in zip(so[:-1], so[1:], strict=True)], pa.binary())],
                ["doc_id", "label", "inputs"])

    chosen = labelled.sample(docs, labels, "toxic", labelled.fold(3) == 1, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = chosen.mapInArrow(inputs, f"doc_id {kind}, label int, inputs binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.label, bytes(r.inputs)))
    return fit([np.frombuffer(r.inputs, np.int32).astype(np.int64) for r in got], [r.label for r in got]) if got else None


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: score and prediction of every document."""
    x = score(docs, train(docs, labels))
    return x.select("doc_id", F.coalesce(labelled.fold(3) == 1, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= PREDICT).cast("int").alias("predicted"))
