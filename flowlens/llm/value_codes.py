"""Operator 11: vector code compression over per-dimension value dictionaries.

Vectors become whole numbers, floor(4096 * x). Slices of vectors are stored once as blocks: for each dimension the distinct integers
of the slice (its dictionary) and every vector's 16-bit place in it. A pass over the blocks tabulates, for each dimension, the
squared differences of every distinct integer to that dimension of all codebook entries; a part's distance to all entries is then a
gather by the codes and an add for each of its dimensions, with no arithmetic on vectors. Each of ``ROUNDS`` passes sends counts and
sums of every (part, entry) to be added up, 8 x 16 short rows however many vectors there are; the codebooks go out with the next
pass. All arithmetic is in 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vec_id may be null (last in the order that
starts the codebooks) and repeated (smaller vector first), each row counts; with fewer than 16 vectors the codebooks have as many
entries as there are vectors; a length that eight doesn't divide makes parts that differ by one; null labels are equal to each
other; an empty table gives no rows; other input columns are not read. Vectors of different lengths, or components beyond
+-``LIMIT`` / 4096, for which squares would leave 64 bits, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.joins import salted
from flowlens.llm.stages import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block at most: a place in a block's dictionary fits in 16 bits.
ROWS = 4096
LIMIT = 1 << 27
_BLOCK = "vec_id array<long>, label array<long>, size array<int>, dictionary array<long>, codes binary"


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, x, label) of the rows that take part."""
    x = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"),
                     F.col("label").cast("long").alias("label"))
    return x.where(F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))


def whole(col: pa.Array) -> np.ndarray:
    """The vectors' components as integers."""
    n = pc.list_value_length(col).to_numpy()
    if len(n) and (n != n[0]).any():
        raise ValueError(f"vectors of {n.min()} and {n.max()} components")
    v = np.floor(col.flatten().to_numpy() * SCALE).reshape(len(n), int(n[0]) if len(n) else 0)
    if (np.abs(v) > LIMIT).any():
        raise ValueError(f"components beyond +-{LIMIT // SCALE}")
    return v.astype(np.int64)


def blocks(vectors: DataFrame) -> DataFrame:
    """The vectors as blocks of dictionaries and codes, one row for up to ``ROWS`` vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                v = whole(part.column(1))
                found = [np.unique(v[:, d], return_inverse=True) for d in range(v.shape[1])]
                codes = np.array([inverse for _, inverse in found], np.uint16).tobytes()
                values = np.concatenate([np.zeros(0, np.int64), *[u for u, _ in found]])
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": [part.column(0)], "label": [part.column(2)], "size": [[len(u) for u, _ in found]],
                     "dictionary": [values], "codes": [codes]},
                    pa.schema([("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())),
                               ("dictionary", pa.list_(pa.int64())), ("codes", pa.binary())]))

    return vectors.select("vec_id", "x", "label").mapInArrow(run, _BLOCK)


def cuts(d: int) -> list[int]:
    """First dimension of each part (one more entry at the end)."""
    return [p * d // PARTS for p in range(PARTS + 1)]


def _assigned(row: dict, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(entry and squared distance of each vector's parts; the block's dictionaries and codes by dimension)."""
    values = np.split(np.array(row["dictionary"], np.int64), np.cumsum(row["size"])[:-1]) if row["size"] else []
    n, d = len(row["vec_id"]), len(values)
    codes = np.frombuffer(row["codes"], np.uint16).reshape(d, n)
    at = cuts(d)
    entry, error = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64)
    for p in range(PARTS):
        far = np.zeros((n, books.shape[0]), np.int64)
        for j in range(at[p], at[p + 1]):
            table = (values[j][:, None] - books[None, :, j]) ** 2
            far += table[codes[j]]
        entry[:, p] = far.argmin(1)  # the first of equal ones
        error[:, p] = far[np.arange(n), entry[:, p]]
    return entry, error, values, codes


def _sums(books: np.ndarray):
    """Counts and sums of the parts that each entry got, over a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, d = books.shape
        at = cuts(d)
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((entries, d), np.int64)
        for b in batches:
            for row in b.to_pylist():
                entry, _, values, codes = _assigned(row, books)
                for p in range(PARTS):
                    count[p] += np.bincount(entry[:, p], minlength=entries)
                    for j in range(at[p], at[p + 1]):
                        np.add.at(total[:, j], entry[:, p], values[j][codes[j]])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
             pa.array([total[j, at[i]:at[i + 1]] for i, j in zip(p, e, strict=True)], pa.list_(pa.int64()))], ["p", "e", "n", "s"])
    return run


def fit(table: DataFrame, stored: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (entries x dimensions) after the rounds; the driver sees ``entries`` vectors and 8 x ``entries`` sums."""
    start = table.orderBy(F.col("vec_id").asc_nulls_last(), "x", "label").limit(entries).select("x").toArrow()
    books = whole(start["x"].combine_chunks())
    at = cuts(books.shape[1])
    for _ in range(rounds if len(books) else 0):
        got = stored.mapInArrow(_sums(books), "p int, e int, n long, s array<long>")
        got = got.select("p", "e", "n", F.posexplode("s").alias("j", "v")).groupBy("p", "e", "j").agg(
            F.sum("n").alias("n"), F.sum("v").alias("v"))
        books = books.copy()
        for r in got.collect():
            books[r.e, at[r.p] + r.j] = r.v // r.n  # Python's division rounds down
    return books


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                entry, error, _, _ = _assigned(row, books)
                code = [bytes(r).hex() for r in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_id"], pa.int64()), pa.array(row["label"], pa.int64()),
                                                  pa.array(code), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])
    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers, by part, entry and position within the part."""
    at = cuts(books.shape[1])
    text = ",".join(str(x) for p in range(PARTS) for e in books[:, at[p]:at[p + 1]].tolist() for x in e)
    return hashlib.sha256(text.encode()).hexdigest()


def encode(table: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every vector, codebooks)."""
    vectors = usable(table)
    stored = materialize(blocks(vectors), "codes-blocks")
    books = fit(vectors, stored)
    return stored.mapInArrow(_coded(books), "vec_id long, label long, code string, error long"), books


def op11_value_codes(table: DataFrame) -> DataFrame:
    """The contract's digest: code and error of every vector, the error of its label, and the codebooks' hash."""
    coded, books = encode(table)
    coded = materialize(coded, "codes")
    label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return salted(coded, label, "label", "vec_id").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the digest over the view ``embeddings``."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label) - 1 AS r, vec_id, label,
 list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
            f"""v AS MATERIALIZED (SELECT r, p, x[(p * len(x)) // {PARTS} + 1 : ((p + 1) * len(x)) // {PARTS}] AS x
 FROM kept, range({PARTS}) AS t(p))""",
            f"c0 AS MATERIALIZED (SELECT p, r AS e, x FROM v WHERE r < {ENTRIES})"]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (f, e)) AS e, min(f) AS f FROM (
 SELECT v.r, v.p, c.e, {far} AS f FROM v JOIN c{i} c ON v.p = c.p) GROUP BY r, p)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
 SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (SELECT a.p, a.e, j, CAST(sum(v.x[j]) AS BIGINT) AS s, count(*) AS n
  FROM a{i} a JOIN v ON a.r = v.r AND a.p = v.p, range(1, 100000) AS t(j) WHERE j <= len(v.x) GROUP BY 1, 2, 3) GROUP BY p, e) m
 ON c.p = m.p AND c.e = m.e)""")
    return "WITH " + ",\n".join(ctes) + f""",
out AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(f) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT kept.vec_id, out.code, out.error, CAST(sum(out.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(x[j] AS VARCHAR), ',' ORDER BY p, e, j)) FROM c{rounds}, range(1, 100000) AS t(j) WHERE j <= len(x))
 AS codebooks_sha256 FROM kept JOIN out ON kept.r = out.r"""
