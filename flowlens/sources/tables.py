"""Driver tables and the flow view derived from them.

The reference ships no data; the flow table is derived from the driver's ``events`` table by a
pure column mapping (no shuffle), so it scales 1:1 with ``events`` and every downstream query's
work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (parquet; column pruning and filter pushdown apply)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flows_from_events(events: DataFrame) -> DataFrame:
    """Map ``events`` rows to the canonical flow schema (narrow projection, no shuffle)."""
    eid, uid = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    port_pick = (F.when(eid % 10 == 0, 22).when(eid % 10 == 1, 80).when(eid % 10 == 2, 443)
                 .when(eid % 10 == 3, 21).when(eid % 10 == 4, 53).when(eid % 10 == 5, 3306)
                 .when(eid % 10 == 6, 23).otherwise((eid * 7919) % 65536))
    et = F.col("event_type")
    rule = (F.when(et == "error", 999).when(et == "click", 1).when(et == "view", 4)
            .when(et == "signup", 6).otherwise(7))
    return events.select(
        eid.alias("flow_id"),
        F.col("ts").alias("date"),
        F.when(uid % 5 == 0, F.concat(F.lit("203.0.113."), s(uid % 256)))
         .otherwise(F.concat(F.lit("159.84."), s(uid % 7), F.lit("."), s(uid % 256))).alias("ip_source"),
        F.concat(F.lit("159.84.146."), s(eid % 32)).alias("ip_destination"),
        F.when(eid % 4 == 0, "UDP").otherwise("TCP").alias("protocol"),
        (F.lit(1024) + (eid * 31) % 64512).cast("int").alias("source_port"),
        port_pick.cast("int").alias("dest_port"),
        rule.cast("int").alias("rule_id"),
        F.when((et == "error") | (eid % 10 >= 7), "Deny").otherwise("Permit").alias("action"),
        F.lit("eth0").alias("interface_in"),
        F.when(eid % 3 == 0, "").otherwise("eth1").alias("interface_out"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical flow table for a driver data directory."""
    return flows_from_events(load(spark, sf_dir, "events"))


def _raw_value() -> Column:
    fid = F.col("flow_id")
    return F.concat(
        F.lit("fw ulog: action="), F.upper("action"), F.lit(" RULE="), F.col("rule_id").cast("string"),
        F.lit(" IN="), F.col("interface_in"), F.lit(" OUT="), F.col("interface_out"),
        F.lit(" MAC=aa:bb SRC="), F.col("ip_source"), F.lit(" DST="), F.col("ip_destination"),
        F.lit(" LEN=60 TOS=00 PREC=0x00 TTL=64 ID="), fid.cast("string"),
        F.when(fid % 2 == 0, F.lit(" DF")).otherwise(F.lit("")),
        F.lit(" PROTO="), F.col("protocol"), F.lit(" SPT="), F.col("source_port").cast("string"),
        F.lit(" DPT="), F.col("dest_port").cast("string"),
        F.when(F.col("protocol") == "UDP", F.lit(" LEN=40")).otherwise(F.lit(" WINDOW=1024 SYN")),
    )


def _limit_ssh_value() -> Column:
    return F.concat(
        F.lit("fw ulog: action=LIMIT SSH IN="), F.col("interface_in"), F.lit(" OUT="), F.col("interface_out"),
        F.lit(" SRC="), F.col("ip_source"), F.lit(" DST="), F.col("ip_destination"),
        F.lit(" PROTO="), F.col("protocol"), F.lit(" DPT="), F.col("dest_port").cast("string"))


def render_raw(fl: DataFrame, mixed: bool = False) -> DataFrame:
    """Render flows back to raw L0 log lines ``(flow_id, date, value)`` (inverse of ``parse_raw``).

    With ``mixed``, denied SSH lines are rendered as the rate-limited "LIMIT SSH" logging rule
    writes them: without ``RULE=`` (so the forwarding filter drops them). Narrow projection only.
    """
    value = _raw_value()
    if mixed:
        value = F.when((F.col("dest_port") == 22) & (F.col("action") == "Deny"), _limit_ssh_value()).otherwise(value)
    return fl.select(F.col("flow_id"), F.col("date"), value.alias("value"))


def raw_lines(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """Raw log lines derived from the flow view: ``(flow_id, date, value)``."""
    return render_raw(flows(spark, sf_dir), mixed)
