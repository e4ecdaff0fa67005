"""Operator 2: suffix-array dedup of bytes by a depth-limited radix sort.

Suffixes are ordered only through ``length`` bytes, by most-significant-digit passes: the first pass takes the bytes around
each suffix's sync point (see ``repeats``), the second the bytes of a whole run, and what these leave open is ordered by its
first ``length`` bytes in two digits of half that size, dropping suffixes that are alone after any pass. Digits are compared as
64-bit hashes of their bytes. The groups that stay equal are exactly the repeated windows.

Defined cases: a null or empty text has no bytes and the hash of nothing; texts shorter than ``length`` are kept whole;
rows sharing a doc_id don't remove each other's bytes; a null doc_id counts as the largest; an empty table gives no rows;
other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm import repeats
from flowlens.llm import textcore as tc

LENGTH = 50
GRAM = 20


class Bytes:
    """Units are the bytes of the UTF-8 text."""

    range_bytes = 32 << 20

    @staticmethod
    def codes(data: np.ndarray, off: np.ndarray):
        return data, off, tc._BYTE

    n_digits = 2

    @staticmethod
    def digits(codes: np.ndarray, table, at: np.ndarray, length: int) -> list[np.ndarray]:
        """The window's first and second half as 64-bit digits."""
        half, x = length // 2, table[codes]
        return [tc.mix(tc.window_hash(x, half)[at], 7), tc.mix(tc.window_hash(x, length - half)[at + half], 8)]


def find(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, key, removed): byte intervals to remove as int32 pairs."""
    return repeats.find(docs, Bytes, length, max(1, min(GRAM, length - 8)))


def _cut(texts: bytes, intervals: np.ndarray) -> list[bytes]:
    at, out = 0, []
    for lo, hi in intervals.tolist():
        out.append(texts[at:lo])
        at = hi
    out.append(texts[at:])
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",),
                with_bytes: bool = True) -> DataFrame:
    """Every document with counts, the kept bytes' hash and (``with_bytes``) the kept bytes as column ``kept``."""
    joined = repeats.with_intervals(docs, find(docs, length), keep)
    names, kinds = list(keep), [f.dataType.simpleString() for f in docs.select(*keep).schema.fields]
    schema = ", ".join([f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)]
                       + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
                       + ["kept binary"] * with_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in tc.slices(batches, "__text"):
            raw, removed, spans, kept, sha = data.tobytes(), [], [], [], []
            for i, x in enumerate(rows.column(rows.schema.get_field_index("removed"))):
                cuts = np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) if x.is_valid else np.zeros((0, 2), np.int32)
                rest = b"".join(_cut(raw[off[i]:off[i + 1]], cuts))
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_bytes:
                    kept.append(rest)
                removed.append(int((cuts[:, 1] - cuts[:, 0]).sum()))
                spans.append(len(cuts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(f"c{i}")) for i in range(len(names))]
                + [pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                   pa.array(sha, pa.string())] + [pa.array(kept, pa.binary())] * with_bytes,
                [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    return joined.mapInArrow(run, schema)


def op2_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest: counts and the hash of the kept bytes."""
    return deduplicate(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
