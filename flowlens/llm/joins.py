"""Joins whose large side may hold one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted(large: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``large`` joined with ``small``, which has one row a key: the rows of a key are dealt by the hash of ``by`` to ``salts``
    tasks, and each row of the small side goes to all of them. Null keys meet null keys."""
    deal = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    every = small.withColumnRenamed(key, "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same: Column = F.col(key).eqNullSafe(F.col("__key")) & (deal == F.col("__salt"))
    return large.join(every, same, how).drop("__key", "__salt")
