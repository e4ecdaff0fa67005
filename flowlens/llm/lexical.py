"""Operator 13: ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton over bytes, each term guarded by a blank on both sides. A text's bytes that belong to no
term become blanks, so the automaton's matches are exactly the occurrences of whole terms; each match counts one tf, straight from
the text. The scan writes each document's length and counts once; document frequencies and lengths are aggregated from that, then
every document's part scores are handed to the items that hold its terms, and each task keeps the best ``K`` of every item.

The automaton and the items' term lists are broadcast. Their size is checked first: items are dealt by the hash of their id to
shards of about ``SHARD_BYTES`` of item text, one automaton and one scan each, so the broadcast is bounded at any number of items.
Scores are whole numbers under 2**53, so sums in doubles are exact.

Defined cases: null and empty texts and texts without a term have no terms, aren't counted in N and are never ranked; items
without a term have no rows; items that share an item_id (null is an id like any other) are one item that holds the terms of all;
documents that share a doc_id are documents of their own, one with a null doc_id comes after all others of its score; empty tables
give no rows; other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import textcore as tc
from flowlens.llm.repeats import NULL_ID
from flowlens.llm.stages import materialize

K = 10
SHARD_BYTES = 16 << 20
#: (document, item) cells scored at once.
_CELLS = 1 << 22

#: Bytes of terms: letters and digits of ASCII and every byte of other code points; A-Z are lower-cased, other bytes blank.
_TERM = tc.LOWER.copy()
_TERM[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_BLANK = 0x20


def _plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' term bytes with blanks between, before and after them, and each document's first byte."""
    flat = np.insert(_TERM[data], np.append(off[:-1], len(data)), np.uint8(_BLANK))
    return flat, off + np.arange(len(off))


def terms(data: np.ndarray, off: np.ndarray) -> list[set[bytes]]:
    """The distinct terms of each text."""
    flat, at = _plain(data, off)
    whole = flat.tobytes()
    return [set(whole[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Items:
    """The items of one shard: their terms' automaton, and the items that hold each term (``holders[begin[t]:begin[t + 1]]``)."""

    def __init__(self, ids: list[int | None], held: list[set[bytes]]):
        merged: dict[int | None, set[bytes]] = {}
        for i, ts in zip(ids, held, strict=True):
            merged.setdefault(i, set()).update(ts)
        self.ids = list(merged)
        self.terms = sorted(set().union(*merged.values()))
        place = {t: n for n, t in enumerate(self.terms)}
        pairs = sorted((place[t], i) for i, ts in enumerate(merged.values()) for t in ts)
        self.holders = np.array([i for _, i in pairs], np.int64)
        self.begin = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        """Built where it is used: a task's workers share nothing. Bytes pass as the code points 0 to 255."""
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, t in enumerate(self.terms):
            a.add_word(" " + t.decode("latin-1") + " ", n)
        a.make_automaton()
        return a


def counts(automaton: ahocorasick.Automaton, n_terms: int, data: np.ndarray,
           off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each document; document, item term and tf of every item term that a document holds)."""
    flat, at = _plain(data, off)
    inside = flat != _BLANK
    total = np.concatenate([[0], np.cumsum(inside[1:] & ~inside[:-1])])  # term begins before each byte
    n = total[at[1:]] - total[at[:-1]]
    found = automaton.iter(flat.tobytes().decode("latin-1")) if n_terms else ()  # an empty automaton can't be asked
    hits = np.fromiter((x for hit in found for x in hit), np.int64).reshape(-1, 2)
    # a match ends on the blank after its term; that blank may be the next document's first byte
    own = np.searchsorted(at, hits[:, 0] - 1, "right") - 1
    key, tf = np.unique(own * n_terms + hits[:, 1], return_counts=True)
    return n, key // n_terms, key % n_terms, tf


def scan(docs: DataFrame, items: Items) -> DataFrame:
    """(id, n, term, tf) of every document with a term: its number of terms, and the item terms it holds. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, n_terms = shared.value.automaton(), len(shared.value.terms)
        for rows, data, off in tc.slices(batches, "__text", 1 << 21):
            n, own, term, tf = counts(automaton, n_terms, data, off)
            have = np.flatnonzero(n)
            cut = pa.array(np.append(np.searchsorted(own, have), len(own)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tc.ints(rows.column(0), NULL_ID)[have]), pa.array(n[have]),
                 pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(tf))],
                ["id", "n", "term", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("__text"))
    return rows.mapInArrow(run, "id long, n long, term array<int>, tf array<long>")


def _best(k: int, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each item: highest score, then smallest document."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(item)))
    keep = np.arange(len(item)) - np.repeat(first, size) < k
    return item[keep], score[keep], doc[keep]


def _scored(items, weights, n_docs: int, n_words: int, k: int):
    """The best documents of every item among a task's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, w = items.value, weights.value
        n_items = len(it.ids)
        least = np.ones(n_items)
        top = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for b in batches:
            ids, lens, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            cut, term = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            tf = b.column(3).flatten().to_numpy()
            m = np.array([10 + 90 * n * n_docs // n_words for n in lens.tolist()], np.int64)  # Python integers can't overflow
            own = np.repeat(np.arange(len(ids)), np.diff(cut))
            part = (w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[own]))).astype(float)
            step = max(1, _CELLS // max(n_items, 1))
            for lo in range(0, len(ids), step):
                a, z = cut[lo], cut[min(lo + step, len(ids))]
                t = term[a:z]
                many = it.begin[t + 1] - it.begin[t]
                e = np.repeat(np.arange(len(t)), many)
                to = it.holders[np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many) + it.begin[t][e]]
                docs = min(step, len(ids) - lo)
                s = np.bincount((own[a:z][e] - lo) * n_items + to, part[a:z][e], docs * n_items).reshape(docs, n_items)
                d, i = np.nonzero(s >= least)
                if len(d):
                    top = _best(k, np.append(top[0], i), np.append(top[1], s[d, i]), np.append(top[2], ids[lo + d]))
                    full = np.bincount(top[0], minlength=n_items) >= k
                    low = np.full(n_items, np.inf)
                    np.minimum.at(low, top[0], top[1])
                    least = np.where(full, low, 1.0)
        known = [it.ids[i] for i in top[0].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(top[2]), pa.array(top[1].astype(np.int64))],
                                         ["item_id", "id", "score"])
    return run


def _shard(docs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(item_id, id, score): each task's best documents of the items of one shard."""
    spark = docs.sparkSession
    rows = table.toArrow()
    items = Items(rows["item_id"].to_pylist(), terms(*tc.text_bytes(rows["text"].combine_chunks())))
    counted = materialize(scan(docs, items), "lexical-counts")
    n_docs, n_words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.terms), np.int64)
    for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r.t] = r.df
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    run = _scored(spark.sparkContext.broadcast(items), spark.sparkContext.broadcast(w), n_docs, n_words, k)
    return counted.where(F.size("term") > 0).mapInArrow(run, "item_id long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, id, score) of each item's k best documents; ``docs``: doc_id and text, ``items``: item_id and text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    found = None
    for s in range(shards):
        part = _shard(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s), k)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k)).select("item_id", "rank", "id", "score")


def op13_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest: each item's ten best documents."""
    return search(docs, items).select("item_id", "rank", F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "score")


def oracle(k: int = K) -> str:
    """DuckDB SQL of the digest over views ``documents`` and ``benchmark``."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"regexp_extract_all({low}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS ts FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
it AS MATERIALIZED (SELECT DISTINCT item_id, unnest({split}) AS t FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
part AS (SELECT tf.r, tf.t, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * n.n * total.docs) // total.words))) AS p
 FROM tf JOIN w ON tf.t = w.t JOIN n ON tf.r = n.r, total),
s AS (SELECT it.item_id, part.r, CAST(sum(p) AS BIGINT) AS score FROM it JOIN part ON it.t = part.t GROUP BY 1, 2 HAVING sum(p) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT s.item_id, n.doc_id, s.score,
 row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, n.doc_id NULLS LAST) AS rank FROM s JOIN n ON s.r = n.r)
WHERE rank <= {k}"""
