"""Attack-pattern jobs the assistant is asked about (port scan, brute force, DDoS spike,
decoy scan, TCP vs UDP risk). Each is a grouped aggregate over time buckets; the only ordered
window (the DDoS trailing baseline) runs over the per-bucket series, never over raw lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.chunks import SENSITIVE_PORTS


def _bucket(width: str):
    return F.window("date", width).start.cast("timestamp_ntz")


def port_scan(df: DataFrame, width: str = "1 day", min_ports: int = 3) -> DataFrame:
    """Sources touching at least ``min_ports`` distinct destination ports within one bucket."""
    return (df.groupBy("ip_source", _bucket(width).alias("window_start"))
            .agg(F.count_distinct("dest_port").alias("n_ports"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n_ports") >= min_ports))


def brute_force(df: DataFrame, ports=(21, 22), width: str = "1 hour", min_hits: int = 2) -> DataFrame:
    """Sources with at least ``min_hits`` lines (or denies) on FTP/SSH within one bucket."""
    hits = df.filter(F.col("dest_port").isin(*ports))
    return (hits.groupBy("ip_source", _bucket(width).alias("window_start"))
            .agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("action") == "Deny").alias("n_denied"))
            .filter((F.col("n_hits") >= min_hits) | (F.col("n_denied") >= min_hits)))


def ddos_spike(df: DataFrame, width: str = "1 hour", trailing: int = 24, z: float = 3.0) -> DataFrame:
    """Buckets whose line count exceeds mean + z * std of the previous ``trailing`` buckets; buckets
    without lines between the first and the last count as 0. The window sees one row per bucket."""
    per = df.where("date is not null").groupBy(_bucket(width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    span = per.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {width}"))).alias("bucket"))
    per = every.join(per, "bucket", "left").na.fill(0, ["n"])
    w = Window.orderBy("bucket").rowsBetween(-trailing, -1)
    base = per.select("bucket", "n", F.avg("n").over(w).alias("mean"), F.stddev_pop("n").over(w).alias("std"),
                      F.count("n").over(w).alias("k"))
    return (base.filter((F.col("k") >= trailing) & (F.col("n") > F.col("mean") + F.lit(z) * F.col("std")))
            .select("bucket", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")))


def decoy_scan(df: DataFrame, width: str = "1 hour", min_sources: int = 3) -> DataFrame:
    """(bucket, port) pairs probed by at least ``min_sources`` distinct sources."""
    return (df.groupBy(_bucket(width).alias("window_start"), "dest_port")
            .agg(F.count_distinct("ip_source").alias("n_sources"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n_sources") >= min_sources))


def decoy_sequences(df: DataFrame, width: str = "1 minute", min_sources: int = 3, min_ports: int = 2) -> DataFrame:
    """Port sequences that at least ``min_sources`` sources probed in the same order within one bucket.

    A source's sequence in a bucket is its distinct ports in the order of first contact (time, then flow_id); lines without a port
    or time are left out. First contacts are aggregated before the sequence is built, so it holds each port once, however many
    lines there are; sources are grouped by the sequence's hash, and the sequence itself tells hash-equal ones apart.
    """
    first = (df.where("dest_port is not null and date is not null")
             .groupBy("ip_source", _bucket(width).alias("window_start"), "dest_port")
             .agg(F.min(F.struct("date", "flow_id")).alias("first")))
    seq = first.groupBy("ip_source", "window_start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "dest_port"))), lambda s: s["dest_port"]).alias("ports"))
    seq = seq.where(F.size("ports") >= min_ports).select(
        "window_start", F.size("ports").alias("n_ports"), F.array_join(F.transform("ports", lambda x: x.cast("string")), ">").alias("ports"))
    return (seq.groupBy("window_start", F.md5("ports").alias("signature"), "ports", "n_ports")
            .agg(F.count(F.lit(1)).alias("n_sources")).where(F.col("n_sources") >= min_sources))


def tcp_udp_risk(df: DataFrame) -> DataFrame:
    """Per protocol: lines, denies, deny rate, sources, ports, sensitive-port share and its deny rate."""
    deny = F.col("action") == "Deny"
    sens = F.col("dest_port").isin(*SENSITIVE_PORTS)
    return (df.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(deny).alias("n_deny"),
        F.count_distinct("ip_source").alias("n_sources"), F.count_distinct("dest_port").alias("n_ports"),
        F.count_if(sens).alias("n_sensitive"), F.count_if(sens & deny).alias("n_sensitive_deny"))
        .withColumn("deny_rate", F.round(F.col("n_deny") / F.col("n").cast("double"), 6))
        .withColumn("sensitive_share", F.round(F.col("n_sensitive") / F.col("n").cast("double"), 6)))
