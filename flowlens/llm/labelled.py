"""Bounded labelled samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, target: str, held_out: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents outside the held-out fold, the same ones in every run.

    Rows without doc_id or label are left out. The chosen labels are at most ``rows``, so they are broadcast; of documents that
    share a doc_id the one with the smallest text counts (a null text only if there is no other), so each label gives one row."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out)
              .select("doc_id", F.col(target).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows).distinct())
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
