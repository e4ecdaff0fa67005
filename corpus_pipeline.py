"""Corpus preparation as stages over ``documents``: each takes what its predecessor kept.

Quality rules, MinHash near-duplicates, substring dedup, mixing to target weights, packing. Every stage but the last returns
the columns of ``documents``; the last returns the packed pieces.

Defined cases, by stage. Input columns beyond those of ``documents`` are not carried, so their names can't clash. Null and empty
texts and texts without words fail the base rule of the quality stage and go there; given to a later stage, they stay through near
duplicates (they are like nothing) and substring dedup (nothing of them is removed), go in mixing (nothing to take), and are one
end id in packing. A null doc_id counts as the largest one. Rows that are equal in doc_id and text leave one copy in near duplicates; of other
ties the smallest doc_id stays. A long text is read whole by every stage. An empty table gives an empty table of the same columns at
every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import mixing, near_dup, packing, quality_rules, substring_dedup
from flowlens.session import scratch_path, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Similarity of the five-word shingle sets, in percent, from which documents are near duplicates here (op6's contract has 85).
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the policy rejects go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates: one document of each group stays, the smallest doc_id."""
    return near_dup.keep_one(docs.select(*COLUMNS), NEAR_PERCENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words covered by a window of a smaller document go; documents that this leaves without words go."""
    out = substring_dedup.strip(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as the mix takes them, the last copy of a source cut at its target."""
    return mixing.mix(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces with their ids and their place in sequences."""
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substrings),
          ("mixing", mixture), ("packing", sequences)]
#: SQL can't express packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
