"""Key figures, cross-tabs and time profiles.

All are single-pass aggregates: Spark computes partial aggregates map-side, so a hot key
(one IP or rule holding a third of the rows) is pre-combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalar import pct, port_category

ACTIONS = ("Permit", "Deny")


def kpis(df: DataFrame, approx: bool = False) -> DataFrame:
    """Total, permits, denies, other actions, distinct sources and ports, global deny rate."""
    a = F.col("action")
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(a == "Permit").alias("permit"),
        F.count_if(a == "Deny").alias("deny"),
        F.count_if(~F.coalesce(a.isin(*ACTIONS), F.lit(False))).alias("other"),
        distinct("ip_source").alias("n_src_ips"),
        distinct("dest_port").alias("n_dest_ports"),
        F.round(F.avg((a == "Deny").cast("int")), 6).alias("deny_rate"),
    )


def exec_summary(df: DataFrame) -> DataFrame:
    """Report chapter 0: rows, date range, distinct IPs and rules, permit / deny shares."""
    a = F.col("action")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.count_distinct("ip_source").alias("n_ips"),
        F.count_distinct("rule_id").alias("n_rules"),
        F.count_if(a == "Permit").alias("_p"),
        F.count_if(a == "Deny").alias("_d"),
    ).select("total", "date_min", "date_max", "n_ips", "n_rules",
             pct("_p", "total").alias("pct_permit"), pct("_d", "total").alias("pct_deny"))


def crosstab(df: DataFrame, row: str, values=ACTIONS, col: str = "action") -> DataFrame:
    """Row key x fixed column values, 0-filled (``pivot`` with explicit values: no extra job)."""
    return (df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
            .na.fill(0, subset=list(values)))


def counts_over(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def daily_port_category(df: DataFrame) -> DataFrame:
    return counts_over(df.select(F.to_date("date").alias("day"), port_category().alias("port_category")),
                       ["day", "port_category"])


def block_rate(df: DataFrame, by: str = "protocol") -> DataFrame:
    """Per-key total, denied and deny rate (percent, 2 decimals)."""
    return (df.groupBy(by).agg(F.count(F.lit(1)).alias("total"),
                               F.count_if(F.col("action") == "Deny").alias("denied"))
            .withColumn("deny_rate", pct("denied", "total")))


def share(df: DataFrame, key: str, where=None, name: str = "n") -> DataFrame:
    """Counts per key with percent of the (filtered) total.

    The total is a scalar subquery evaluated once, not a global window (which would move every
    group into one partition) and not a join.
    """
    base = df if where is None else df.filter(where)
    total = base.select(F.count(F.lit(1)).cast("double")).scalar()
    return (base.groupBy(key).agg(F.count(F.lit(1)).alias(name))
            .withColumn("pct", F.round(F.lit(100.0) * F.col(name) / F.nullif(total, F.lit(0.0)), 2)))


def daily_actions(df: DataFrame) -> DataFrame:
    """Per day: Permit and Deny counts, 0-filled (wide form)."""
    a = F.col("action")
    return (df.groupBy(F.to_date("date").alias("day"))
            .agg(F.count_if(a == "Permit").alias("Permit"), F.count_if(a == "Deny").alias("Deny"),
                 F.count(F.lit(1)).alias("total")))


def hourly(df: DataFrame, by_action: bool = False) -> DataFrame:
    keys = [F.hour("date").alias("hour")] + ([F.col("action")] if by_action else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def peak_hours(df: DataFrame) -> DataFrame:
    """Busiest hour overall and for denies; ties go to the earliest hour (first maximum)."""
    h = (df.groupBy(F.hour("date").alias("hour"))
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "Deny").alias("n_deny")))
    return h.agg(
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"),
        F.max_by(F.when(F.col("n_deny") > 0, F.col("hour")),
                 F.struct(F.col("n_deny"), -F.col("hour"))).alias("peak_deny_hour"),
    )


# Days and labels of the timeline's look-back presets.
PRESETS = ((7, "1 semaine"), (14, "2 semaines"), (30, "1 mois"), (60, "2 mois"))


def range_presets(df: DataFrame) -> DataFrame:
    """Whole-day span of the data and which look-back presets (7/14/30/60 days) apply."""
    # zone-free: the difference of two timestamp_ntz values in microseconds
    span = df.agg(F.floor(F.timestamp_diff("MICROSECOND", F.min("date"), F.max("date")) / F.lit(86_400_000_000))
                  .alias("span_days"))
    rows = F.array(*[F.struct(F.lit(d).alias("preset_days"), F.lit(lbl).alias("label")) for d, lbl in PRESETS])
    return (span.select("span_days", F.explode(rows).alias("p"))
            .select("p.preset_days", "p.label", "span_days",
                    F.coalesce(F.col("span_days") >= F.col("p.preset_days"), F.lit(False)).alias("enabled")))


def protocol_rollup(df: DataFrame) -> DataFrame:
    """Rollup total -> protocol -> protocol x port category, with Permit / Deny counts."""
    a = F.col("action")
    return (df.select("protocol", port_category().alias("port_category"), "action")
            .rollup("protocol", "port_category")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(a == "Permit").alias("Permit"),
                 F.count_if(a == "Deny").alias("Deny"),
                 F.grouping_id().alias("level")))


def flow_rollups(df: DataFrame) -> dict[str, DataFrame]:
    """Three narrow, materialised counts of the flow table that report chapters and knowledge-base chunks share:

    * ``time``: per day, hour and action, with first and last time seen;
    * ``service``: per protocol, rule, port and action;
    * ``source``: per source and action, with first time seen.

    Each is one scan of the few columns it needs, combined before the shuffle; their sizes follow the distinct keys, not the
    lines.
    """
    from flowlens.session import materialize
    n = F.count(F.lit(1)).alias("n")
    seen = F.min("date").alias("first_seen")
    return {
        "time": materialize(df.groupBy(F.to_date("date").alias("day"), F.hour("date").alias("hour"), "action")
                            .agg(n, seen, F.max("date").alias("last_seen")), "rollup-time"),
        "service": materialize(df.groupBy("protocol", "rule_id", "dest_port", "action").agg(n), "rollup-service"),
        "source": materialize(df.groupBy("ip_source", "action").agg(n, seen), "rollup-source"),
    }
