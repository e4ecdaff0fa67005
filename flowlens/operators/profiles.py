"""Per-source behaviour profiles and feature scaling.

Both profile builders are one ``groupBy(ip_source)`` with partial aggregation; a hot source IP
is combined map-side, so the shuffle carries one partial row per (task, IP).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE_FEATURES = ("n_distinct_ports", "n_denies", "n_connections", "duration_min", "mean_port",
                    "max_port", "tcp_ratio", "rate_per_min", "deny_ratio")
IFOREST_FEATURES = ("n_distinct_ports", "n_denies", "rate_per_min", "deny_ratio", "tcp_ratio")
LOF_FEATURES = ("n_distinct_ports", "n_denies", "rate_per_min", "deny_ratio")


def ip_behaviour(df: DataFrame) -> DataFrame:
    """Per source IP: destination rows, distinct destinations, denied, permitted, total.

    ``n_dest_rows`` is the dashboard's row count (it counts rows, not destinations);
    ``n_dest_distinct`` is the distinct count. One conditional aggregate replaces the
    reference's three aggregates merged by two left joins.
    """
    a = F.col("action")
    return (df.groupBy("ip_source").agg(
        F.count("ip_destination").alias("n_dest_rows"),
        F.count_distinct("ip_destination").alias("n_dest_distinct"),
        F.count_if(a == "Deny").alias("denied"),
        F.count_if(a == "Permit").alias("permitted"))
        .withColumn("total", F.col("denied") + F.col("permitted")))


def ip_behaviour_by_join(df: DataFrame) -> DataFrame:
    """The same table built as the reference does (three aggregates + left joins); for tests."""
    base = df.groupBy("ip_source").agg(F.count("ip_destination").alias("n_dest_rows"),
                                       F.count_distinct("ip_destination").alias("n_dest_distinct"))
    den = df.groupBy("ip_source").agg(F.count_if(F.col("action") == "Deny").alias("denied"))
    per = df.groupBy("ip_source").agg(F.count_if(F.col("action") == "Permit").alias("permitted"))
    return (base.join(den, "ip_source", "left").join(per, "ip_source", "left")
            .withColumn("total", F.col("denied") + F.col("permitted")))


def ip_profiles(df: DataFrame) -> DataFrame:
    """Behaviour profile per source IP (the ML page's eight descriptors + rate and ratio).

    Duration is (last - first) in minutes with a floor of 1 minute.
    """
    a = F.col("action")
    prof = df.groupBy("ip_source").agg(
        F.count_distinct("dest_port").alias("n_distinct_ports"),
        F.count_if(a == "Deny").alias("n_denies"),
        F.count("date").alias("n_connections"),
        F.greatest(F.timestamp_diff("MICROSECOND", F.min("date"), F.max("date")) / F.lit(60_000_000.0),
                   F.lit(1.0)).alias("duration_min"),
        F.avg("dest_port").alias("mean_port"),
        F.max("dest_port").alias("max_port"),
        F.avg((F.col("protocol") == "TCP").cast("int")).alias("tcp_ratio"),
    )
    return (prof.withColumn("rate_per_min", F.col("n_connections") / F.col("duration_min"))
            .withColumn("deny_ratio", F.col("n_denies") / F.nullif(F.col("n_connections").cast("double"), F.lit(0.0))))


def standardize(df: DataFrame, cols, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std, 0 where the std is 0 (scikit's StandardScaler convention).

    All means and standard deviations come from one global aggregate, used as a single
    struct-valued scalar subquery (evaluated once per query; no join and no single-partition
    window touches the data).
    """
    cols = list(cols)
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("st")).scalar()
    out = df
    for c in cols:
        m, sd = stats[f"m_{c}"], stats[f"s_{c}"]
        out = out.withColumn(c + suffix, F.when(sd > 0, (F.col(c) - m) / sd).otherwise(F.lit(0.0)))
    return out
