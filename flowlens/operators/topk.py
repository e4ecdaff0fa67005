"""Top-k reports (H1-H19) and per-group ranks.

Every top-k orders by ``(count desc, key asc)`` so ties are deterministic, and uses
``orderBy(...).limit(k)`` which Spark plans as ``TakeOrderedAndProject``: each partition keeps
only its own k best rows, so no global sort of the data happens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def top_k(df: DataFrame, key, k: int | None, where: Column | None = None, share: bool = False,
          name: str = "n", weight: str | None = None) -> DataFrame:
    """Most frequent values of ``key`` (optionally under ``where``), with percent of that total.

    With ``weight`` the rows are pre-aggregated counts (e.g. a frame of ``flow_rollups``) and are summed.
    """
    base = df if where is None else df.filter(where)
    keys = _keys(key)
    cnt = F.sum(weight) if weight else F.count(F.lit(1))
    counts = base.groupBy(*keys).agg(cnt.alias(name))
    if share:
        total = base.select(cnt.cast("double")).scalar()
        counts = counts.withColumn("pct", F.round(F.lit(100.0) * F.col(name) / F.nullif(total, F.lit(0.0)), 2))
    if k is None:  # every value
        return counts
    return counts.orderBy(F.col(name).desc(), *[F.col(c).asc_nulls_last() for c in keys]).limit(k)


def top_k_per(df: DataFrame, part: str, key, k: int, name: str = "n") -> DataFrame:
    """Top-k of ``key`` within each ``part`` value, ranked 1..k.

    Counts are pre-aggregated first, so the window only sees one row per (part, key) group.
    """
    keys = _keys(key)
    counts = df.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(name))
    w = Window.partitionBy(part).orderBy(F.col(name).desc(), *[F.col(c).asc_nulls_last() for c in keys])
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quantile_outliers(df: DataFrame, key: str = "ip_source", q: float = 0.95, k: int = 20,
                      where: Column | None = None) -> DataFrame:
    """Keys whose count is strictly above the q-quantile (linear interpolation) of all counts.

    ``percentile`` keeps a value->frequency map, so its buffer holds the distinct per-key counts
    only: at most sqrt(2 * rows) values however many keys there are.
    """
    base = df if where is None else df.filter(where)
    counts = base.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    cut = counts.select(F.percentile(F.col("n").cast("double"), F.lit(q))).scalar()
    return (counts.withColumn("threshold", F.round(cut, 6)).filter(F.col("n") > cut)
            .orderBy(F.col("n").desc(), F.col(key)).limit(k))


def recent(df: DataFrame, n: int, order=("date", "flow_id")) -> DataFrame:
    """Newest n rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def first_rows(df: DataFrame, n: int, order=("date", "flow_id")) -> DataFrame:
    """First n rows in event order (the reference's ``head(n)`` on a time-ordered file)."""
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


def _at_ranks(df: DataFrame, col: str, ranks) -> list:
    """The exact values of a column at the 1-based ranks that ``ranks(n)`` asks for.

    Equal values are counted first, so ties are one row. The counted values are range-partitioned once; the sums of the
    partitions (one number each) name the partitions that hold the ranks, and running counts inside those pick the values. One row
    comes back for all ranks.
    """
    from flowlens.session import materialize
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    x = materialize(x.repartitionByRange(parts, "v").withColumn("pid", F.spark_partition_id()), "ranked")
    sizes = sorted((r.pid, r.n) for r in x.groupBy("pid").agg(F.sum("c").alias("n")).collect())
    places = []
    for rank in ranks(sum(n for _, n in sizes)) if sizes else []:
        for pid, n in sizes:
            if rank <= n:
                places.append((pid, rank))
                break
            rank -= n
    if not places:
        return []
    cum = F.sum("c").over(Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = x.where(F.col("pid").isin(sorted({p for p, _ in places}))).withColumn("cum", cum)
    hit = [F.min(F.when((F.col("pid") == p) & (F.col("cum") >= r), F.col("v"))).alias(f"r{i}") for i, (p, r) in enumerate(places)]
    return list(run.agg(*hit).first())


def order_statistic(df: DataFrame, col: str, q: float) -> float | None:
    """The exact value of rank ``ceil(q * n)`` (1-based) of a column; null when there is no value."""
    got = _at_ranks(df, col, lambda n: [max(1, math.ceil(q * n))])
    return got[0] if got else None


def linear_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbouring ranks; nulls when there is no value."""
    at: list[float] = []

    def ranks(n: int) -> list[int]:
        at.extend(q * (n - 1) for q in qs)
        return [r for p in at for r in (math.floor(p) + 1, math.ceil(p) + 1)]

    got = _at_ranks(df, col, ranks)
    return [lo + (hi - lo) * (p - math.floor(p)) for p, lo, hi in zip(at, got[::2], got[1::2], strict=True)] or [None] * len(qs)
