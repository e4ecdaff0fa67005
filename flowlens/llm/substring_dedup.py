"""Operator 7: substring dedup of words by level-wise doubling.

The levels are windows of 13, 25 and 50 words (see ``doubling``): those found in one document alone end at their level, only
the others are extended, and with no candidate left the levels stop. The last length is the threshold.

Defined cases: a null or empty text has no words and the hash of nothing; texts with fewer words than a window are kept
whole; rows sharing a doc_id don't remove each other's words; a null doc_id counts as the largest; an empty table gives no
rows; other input columns are not read, or carried along unchanged by ``strip``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import doubling, repeats
from flowlens.llm import textcore as tc

LENGTH = 50


def find(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, key, removed): word intervals to remove as int32 pairs."""
    return doubling.find(docs, length)


def _intervals(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) if x.is_valid else np.zeros((0, 2), np.int32)


def op7_substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The contract's digest: word counts and the hash of the kept words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = repeats.with_intervals(docs, find(docs, length), ("doc_id",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text"):
            raw, total, removed, sha = data.tobytes(), [], [], []
            for i, x in enumerate(rows.column(rows.schema.get_field_index("removed"))):
                ws, gone, out, at = raw[off[i]:off[i + 1]].split(), 0, [], 0
                for lo, hi in _intervals(x).tolist():
                    out += ws[at:lo]
                    at, gone = hi, gone + hi - lo
                kept = out + ws[at:]
                total.append(len(ws))
                removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("c0")), pa.array(total, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated words, all columns kept; a document left without words goes.

    A cut reaches from the first removed word to the next kept one, so the white space before it stays."""
    cols = docs.columns
    joined = repeats.with_intervals(docs, find(docs, length), tuple(cols))
    untouched, cut = joined.where("removed is null"), joined.where("removed is not null")
    names = [f"c{i}" for i in range(len(cols))]
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text"):
            starts, _, wo = tc.words(data, off)
            raw, texts = data.tobytes(), []
            for i, x in enumerate(rows.column(rows.schema.get_field_index("removed"))):
                at, out = int(off[i]), []
                for lo, hi in _intervals(x).tolist():
                    out.append(raw[at:starts[wo[i] + lo]])
                    at = int(starts[wo[i] + hi]) if wo[i] + hi < wo[i + 1] else int(off[i + 1])
                text = b"".join([*out, raw[at:off[i + 1]]])
                texts.append(text.decode() if text.split() else None)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(n)) for n in names]
                                             + [pa.array(texts, pa.string())], [*names, "__text"])

    out = cut.mapInArrow(run, fields + ", __text string").where("__text is not null")
    whole = untouched.select(*names, "__text")
    return whole.unionByName(out).select(*[(F.col("__text") if c == "text" else F.col(n)).alias(c)
                                           for n, c in zip(names, cols, strict=True)])
