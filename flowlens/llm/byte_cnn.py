"""Operator 1: quality classifier, a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes slide over the text every ``STEP`` bytes; activations are max-pooled
over overlapping chunks of two blocks, which together cover the whole document; a hidden layer reads each chunk, is max-pooled
over the chunks and combined into one probability. Fitted on at most ``TRAIN_ROWS`` labelled documents: a step
sees ``TRAIN_BLOCKS`` consecutive blocks, drawn from the whole text anew for each epoch; scores use every byte of every document.

Defined cases: a null or empty text is one chunk of padding and gets its score; without labels of both classes the score is
0.5; repeated rows get equal scores; a null doc_id is not held out and never fitted on; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import labelled
from flowlens.llm import textcore as tc

TRAIN_ROWS, TRAIN_BLOCKS, EPOCHS, BATCH = 3000, 48, 10, 64
BLOCK, STEP, WIDTH, EMBED, FILTERS, HIDDEN = 128, 4, 12, 8, 32, 16
PAD = 256
PREDICT = 0.7


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents as whole blocks with a block of padding after each, and each document's first block."""
    n = np.diff(off)
    blocks = np.maximum(1, -(-n // BLOCK)) + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.full(first[-1] * BLOCK, PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - off[:-1], n)] = data
    return out, first


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    g = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
    return {"E": g(257, EMBED, k=0.5), "K": g(WIDTH * EMBED, FILTERS, k=(2 / WIDTH / EMBED) ** 0.5), "b": np.zeros(FILTERS, np.float32),
            "H": g(FILTERS, HIDDEN, k=(2 / FILTERS) ** 0.5), "c": np.zeros(HIDDEN, np.float32),
            "u": g(HIDDEN, k=0.3), "d": np.zeros(1, np.float32)}


def _windows(codes: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    x = np.concatenate([m["E"][codes], np.broadcast_to(m["E"][PAD], (WIDTH, EMBED))]).reshape(-1)
    rows = len(codes) // STEP
    return np.lib.stride_tricks.as_strided(x, (rows, WIDTH * EMBED), (STEP * EMBED * 4, 4))


def _forward(codes: np.ndarray, first: np.ndarray, m: dict[str, np.ndarray]):
    """Everything up to the probability of each document; the pieces serve the gradient."""
    per = BLOCK // STEP
    x = _windows(codes, m)
    a = (x @ m["K"]).reshape(-1, per, FILTERS)
    top = a.max(1)
    real = np.ones(len(top), bool)
    real[first[1:] - 1] = False
    chunk = np.flatnonzero(real)  # a chunk is a block and the one after it
    pooled = np.maximum(np.maximum(top[chunk], top[chunk + 1]) + m["b"], 0)
    hidden = np.maximum(pooled @ m["H"] + m["c"], 0)
    starts = first[:-1] - np.arange(len(first) - 1)
    best = np.maximum.reduceat(hidden, starts)
    z = best @ m["u"] + m["d"][0]
    return 1 / (1 + np.exp(-z)), (x, a, top, chunk, pooled, hidden, starts, best)


def _gradient(codes: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p, (x, a, top, chunk, pooled, hidden, starts, best) = _forward(codes, first, m)
    dz = ((p - y) * weight / weight.sum()).astype(np.float32)
    g = {"u": best.T @ dz, "d": dz.sum(keepdims=True)}
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(hidden)]))
    won = (hidden == best[owner]) & (hidden > 0)
    dh = won * (dz[:, None] * m["u"])[owner]
    g["H"], g["c"] = pooled.T @ dh, dh.sum(0)
    dp = (dh @ m["H"].T) * (pooled > 0)
    g["b"] = dp.sum(0)
    right = top[chunk + 1] > top[chunk]
    block = chunk[:, None] + right
    row = block * (BLOCK // STEP) + np.take_along_axis(a.argmax(1), block, 0)
    at = np.flatnonzero(dp)
    row, col, val = row.reshape(-1)[at], at % FILTERS, dp.reshape(-1)[at]
    dk = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
    de = np.zeros((257, EMBED), np.float32)
    padded = np.concatenate([codes, np.full(WIDTH, PAD, codes.dtype)])
    for f in range(FILTERS):
        pick = col == f
        r, v = row[pick], val[pick]
        dk[f] = v @ x[r]
        back = (v[:, None] * m["K"][:, f]).reshape(-1, EMBED)
        b = padded[(r[:, None] * STEP + np.arange(WIDTH)).reshape(-1)]
        for e in range(EMBED):
            de[:, e] += np.bincount(b, back[:, e], 257).astype(np.float32)
    g["K"], g["E"] = dk.T, de
    return g


def parts(text: bytes, epochs: int = EPOCHS) -> list[bytes]:
    """What each epoch sees of a text: the whole of a short one, otherwise a run of blocks. The epochs share the text out evenly,
    each draws its place in its share."""
    room = -(-len(text) // BLOCK) - TRAIN_BLOCKS
    if room <= 0:
        return [text]
    draw = np.random.default_rng(zlib.crc32(text)).random(epochs)
    starts = ((np.arange(epochs) + draw) * (room + 1) / epochs).astype(int) * BLOCK
    return [text[a:a + TRAIN_BLOCKS * BLOCK] for a in starts.tolist()]


def fit(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray] | None:
    """Adam over small batches; both classes weigh the same. ``texts``: the ``parts`` of each document."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m, rng = initial(seed), np.random.default_rng(seed)
    first, second, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at:at + BATCH]
            part = [texts[i][epoch % len(texts[i])] for i in pick]
            off = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            codes, start = layout(np.frombuffer(b"".join(part), np.uint8), off)
            g = _gradient(codes, start, y[pick], weight[pick], m)
            t += 1
            rate = 0.004 * (1 - 0.9 * epoch / epochs)
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return m


def scores(data: np.ndarray, off: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """The probability of each document, in runs of documents of bounded size; a long document runs chunk by chunk."""
    codes, first = layout(data, off)
    per, out = 4096, np.empty((0, HIDDEN), np.float32)
    hidden = []
    for a in range(0, int(first[-1]), per):  # one block more, so that the last chunk is whole
        b = min(a + per, int(first[-1]))
        part = codes[a * BLOCK:min(b + 1, int(first[-1])) * BLOCK + WIDTH]
        blocks = len(part) // BLOCK
        top = (_windows(part, m)[:blocks * BLOCK // STEP] @ m["K"]).reshape(blocks, BLOCK // STEP, FILTERS).max(1)
        following = np.concatenate([top[1:], top[-1:]])[:b - a]
        pooled = np.maximum(np.maximum(top[:b - a], following) + m["b"], 0)
        hidden.append(np.maximum(pooled @ m["H"] + m["c"], 0))
    hidden = np.concatenate(hidden) if hidden else out
    hidden[first[1:] - 1] = 0  # the padding block begins no chunk
    z = np.maximum.reduceat(hidden, first[:-1]).astype(np.float64) @ m["u"].astype(np.float64) + float(m["d"][0])
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, score) of every row. The model (a few kB) travels with the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text", 1 << 20):
            p = np.full(rows.num_rows, 0.5) if model is None else scores(data, off, model)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(run, f"doc_id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray] | None:
    """Fit on the bounded sample. Tasks cut the parts out of the whole texts; at most ``EPOCHS * TRAIN_BLOCKS * BLOCK`` bytes a row
    reach the driver."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [(x or "").encode() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([parts(x) for x in whole], pa.list_(pa.binary()))],
                                             ["doc_id", "label", "parts"])

    chosen = labelled.sample(docs, labels, "quality", labelled.fold(4) == 2, rows)
    got = chosen.mapInArrow(cut, f"doc_id {kind}, label int, parts array<binary>").collect()
    got.sort(key=lambda r: (r.doc_id, r.label))
    return fit([[bytes(x) for x in r.parts] for r in got], [r.label for r in got])


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: score and prediction of every document."""
    x = score(docs, train(docs, labels))
    return x.select("doc_id", F.coalesce(labelled.fold(4) == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= PREDICT).cast("int").alias("predicted"))
