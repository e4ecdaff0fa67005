"""Hashed bag-of-words embeddings and top-N retrieval.

A text's embedding is made within its row: words, MD5 buckets mod 512, counts, L2 norm. ``embed_rows`` keeps it as two arrays,
``embed`` as the long table ``(id, dim, weight)``. A zero vector (no words) has no entries.

Retrieval multiplies blocks of queries with blocks of texts (``topn_join``); n rows a query leave a block, and a window whose
literal bound Spark applies in each task before the shuffle keeps the best n of all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalar import EMBED_DIMS
from flowlens.operators.topn_join import topn_join

_RANK_DIGITS = 9


#: White space that separates words (Unicode's White_Space property), as a pattern of Arrow's regular expressions.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Text bytes counted at once (a longer text still comes whole).
_SLICE_BYTES = 4 << 20


def _bucket_counts(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of every bucket that a text has words in, ordered; each distinct word is hashed once."""
    lists = pc.split_pattern_regex(texts, pattern=_SPACE)
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words_ = coded.dictionary.to_pylist()
    # the last three hex digits decide the remainder (``word_bucket``); no word, no bucket
    bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[-3:], 16) % dims if w else -1 for w in words_], np.int64)
    at = bucket[coded.indices.to_numpy()] if len(words_) else np.zeros(0, np.int64)
    key = (np.repeat(np.arange(len(n)), n) * dims + at)[at >= 0]
    key, count = np.unique(key, return_counts=True)
    return key // dims, key % dims, count


def embed_rows(df: DataFrame, id_col: str, text_col: str, dims: int = EMBED_DIMS) -> DataFrame:
    """``(id_col, dims, counts, norm)``: the buckets of each text's words with their counts, by bucket, and the length of the
    count vector; empty arrays without words.

    One row is one text, so nothing is shuffled. Counting runs over Arrow batches (array functions of the row took three times as
    long, see README); words are lower-cased in the JVM.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _SLICE_BYTES, "right")))
                part = b.slice(lo, hi - lo)
                own, bucket, count = _bucket_counts(part.column(1), dims)
                off = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32))
                norm = np.sqrt(np.bincount(own, count * count, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(off, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(off, pa.array(count.astype(np.int64))), pa.array(norm)],
                    [id_col, "dims", "counts", "norm"])
                lo = hi

    x = df.select(id_col, F.lower(text_col).alias("t"))
    return x.mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, dims array<int>, counts array<long>, norm double")


def embed(df: DataFrame, id_col: str, text_col: str, dims: int = EMBED_DIMS) -> DataFrame:
    """``(id_col, dim, weight)``: lower-case whitespace tokens, MD5 bucket, count, L2 norm."""
    x = embed_rows(df, id_col, text_col, dims)
    x = x.select(id_col, F.explode(F.arrays_zip("dims", "counts")).alias("e"), "norm")
    return x.select(id_col, F.col("e.dims").alias("dim"), (F.col("e.counts") / F.col("norm")).alias("weight"))


def embed_dense(sparse: DataFrame, id_col: str, dims: int = EMBED_DIMS) -> DataFrame:
    """Dense ``array<double>`` form of a sparse embedding (zeros where a bucket is absent)."""
    return (sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
            .select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                        lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vector")))


def _packed(vectors: DataFrame, id_col: str) -> DataFrame:
    """``(id_col, dims, counts, norm)`` of a long embedding; rows that are packed already pass as they are."""
    if "dims" in vectors.columns:
        return vectors
    return (vectors.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("dim", "weight"))).alias("e"))
            .select(id_col, F.col("e.dim").alias("dims"), F.col("e.weight").alias("counts"), F.lit(1.0).alias("norm")))


def retrieve(queries: DataFrame, index: DataFrame, n: int = 4, id_col: str = "id",
             ids: DataFrame | None = None, dims: int = EMBED_DIMS) -> DataFrame:
    """Top-n ids per query by dot product: ``qid, rank, id_col, score``.

    ``queries`` (key ``qid``) and ``index`` (key ``id_col``) are embeddings, long (``embed``) or packed (``embed_rows``); keys
    are unique. With ``ids`` (all candidate ids), queries with fewer than n positive scores are filled with zero-score ids in id
    order, as a full ranking would.
    """
    queries = _packed(queries, "qid").where(F.size("dims") > 0)
    scores = topn_join(queries, _packed(index, id_col), n, id_col, dims, n_texts=None if ids is None else ids.count())
    w = Window.partitionBy("qid").orderBy(F.round("score", _RANK_DIGITS).desc(), F.col(id_col))
    top = (scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.lit(n))
           .select("qid", "rank", id_col, "score"))
    if ids is None:
        return top
    # Zero-score fill for queries with fewer than n positive hits, applied after the top-n so
    # it touches at most queries x n rows (never the full score table).
    first = ids.select(id_col).distinct().orderBy(id_col).limit(n)
    first_ids = first.agg(F.sort_array(F.collect_list(id_col))).scalar()
    fill = (queries.select("qid")
            .select("qid", F.explode(first_ids).alias(id_col), F.lit(0.0).alias("score")))
    both = (top.drop("rank").unionByName(fill).groupBy("qid", id_col).agg(F.max("score").alias("score")))
    return (both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.lit(n))
            .select("qid", "rank", id_col, "score"))


def context(hits: DataFrame, texts: DataFrame, id_col: str, text_col: str = "text", cut: int = 800,
            sep: str = "\n\n---\n\n") -> DataFrame:
    """Per query: the hit texts in rank order, each cut to ``cut`` characters, joined by ``sep``.

    ``hits`` grows with the queries; Spark broadcasts it only below its own size threshold.
    """
    j = texts.select(id_col, F.substring(text_col, 1, cut).alias("piece")).join(hits, id_col)
    return j.groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda s: s["piece"]), sep).alias("context"))


def recent_turns(conv: DataFrame, n: int = 6) -> DataFrame:
    """Last n turns of each conversation (the chat history sent with a question)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return conv.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.lit(n)).drop("pos")


def sample_rows(df: DataFrame, key: str, n: int = 300, seed: int = 42) -> DataFrame:
    """Deterministic sample of n rows: the n smallest MD5(key|seed) (a top-k, no full sort)."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def _stratum_rank(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds ``_rank`` (from 0, in MD5 order of key and seed) and ``_n`` within each label.

    Ranks are taken within 4,096 hash buckets a label and offset by the buckets before, so a label is never one task.
    """
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    x = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    counts = x.groupBy(F.col(label).alias("_l"), "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_l")
    base = counts.select("_l", F.col("_b").alias("_bb"), F.sum("_c").over(w).alias("_n"), F.coalesce(
        F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)))
    x = x.join(base, x[label].eqNullSafe(base["_l"]) & (x["_b"] == base["_bb"]))
    return x.withColumn("_rank", F.col("_base") + F.col("_in") - 1).drop("_h", "_b", "_bb", "_l", "_in", "_base")


def split_label(df: DataFrame, key: str, train_pct: int = 70, seed: int = 42, label: str = "label") -> DataFrame:
    """``split`` = train / test, stratified: the first ``train_pct`` percent of each label in MD5 order are train."""
    x = _stratum_rank(df, key, label, seed)
    return x.withColumn("split", F.when(F.col("_rank") * 100 < F.col("_n") * train_pct, "train").otherwise("test")).drop("_rank", "_n")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """``fold`` in 0..k-1, stratified: each label's rows in MD5 order take the folds in turn."""
    return _stratum_rank(df, key, label, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def fingerprint(df: DataFrame, cols=None) -> DataFrame:
    """Order-insensitive fingerprint of all rows, repeats included: count, sum of a 60-bit MD5 prefix, sum of xxhash64 (both
    sums as decimal text)."""
    cols = cols or df.columns
    parts = []
    for c in cols:
        t = dict(df.dtypes)[c]
        if t.startswith("timestamp"):
            # epoch microseconds of the wall-clock value, independent of the session time zone
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            parts.append(F.timestamp_diff("MICROSECOND", epoch, F.col(c).cast("timestamp_ntz")).cast("string"))
        else:
            parts.append(F.col(c).cast("string"))
    row = F.concat_ws("|", *[F.coalesce(p, F.lit("\\N")) for p in parts])
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fp_md5"),
                  F.sum(F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")).cast("string").alias("fp_xx"))


def build_index(df: DataFrame, id_col: str, text_col: str, path: str, dims: int = EMBED_DIMS) -> DataFrame:
    """Persist the embedding index at ``path`` with the fingerprint of its source beside it, and
    reuse it when the source has not changed (fingerprint over all rows, order-insensitive). The
    index is partitioned by ``dim``, so a query reads the folders of its own words only."""
    spark = df.sparkSession
    fp = fingerprint(df.select(id_col, text_col)).first().asDict()
    fp_path = f"{path.rstrip('/')}/_fingerprint"
    try:
        old = spark.read.json(fp_path).first()
        if old is not None and {k: old[k] for k in fp} == fp:
            return spark.read.parquet(f"{path.rstrip('/')}/index")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything but "no index yet" is an error
            raise
    embed(df, id_col, text_col, dims).hint("rebalance", "dim").write.mode("overwrite").partitionBy("dim").parquet(f"{path.rstrip('/')}/index")
    spark.createDataFrame([fp]).coalesce(1).write.mode("overwrite").json(fp_path)
    return spark.read.parquet(f"{path.rstrip('/')}/index")


# The five themed questions the report generator retrieves context for.
REPORT_QUERIES = ("resume global statistiques logs", "IP suspectes attaques", "ports cibles blocages deny",
                  "regles firewall", "analyse temporelle pics")


def report_context(chunks: DataFrame, per_query: int = 3, cap: int = 12, cut: int = 600,
                   questions=REPORT_QUERIES) -> DataFrame:
    """Context for the generated report: top chunks of the themed questions, first-seen order,
    at most ``cap`` chunks, each cut to ``cut`` characters: ``first_pos, chunk_id, kind, piece``."""
    spark = chunks.sparkSession
    qdf = spark.createDataFrame(list(enumerate(questions)), "qid int, text string")
    index = embed_rows(chunks, "chunk_id", "text")
    hits = retrieve(embed_rows(qdf, "qid", "text"), index, per_query, id_col="chunk_id", ids=chunks)
    first = hits.groupBy("chunk_id").agg(F.min(F.col("qid").cast("long") * (per_query + 1) + F.col("rank")).alias("first_pos"))
    top = first.orderBy("first_pos", "chunk_id").limit(cap)
    return (chunks.join(F.broadcast(top), "chunk_id")
            .select("first_pos", "chunk_id", "kind", F.substring("text", 1, cut).alias("piece")))
