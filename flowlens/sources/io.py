"""Readers and writers for every layout (A1-A13). Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.filters import date_predicate
from flowlens.operators.normalize import to_flows
from flowlens.schema import L1_SCHEMA, L2_SCHEMA, L45_SCHEMA

_TS_FMT = "yyyy-MM-dd HH:mm:ss"


def read_flows_csv(spark: SparkSession, path: str) -> DataFrame:
    """L3: comma CSV with a header, columns read by name (order is not fixed)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return to_flows(raw, "L3")


def read_flows_export(spark: SparkSession, path: str, start=None, end=None,
                      inclusive_midnight: bool = False) -> DataFrame:
    """L2: ';' export without header; optional date range; ``firewall_num`` is dropped.

    The range is half-open ``[start, end)``; ``inclusive_midnight=True`` reproduces the batch
    report's ``<= end`` (which keeps only the midnight instant of the last day).
    """
    raw = spark.read.schema(L2_SCHEMA).option("sep", ";").option("header", False).csv(path)
    df = to_flows(raw, "L2")
    if start is not None or end is not None:
        df = df.filter(date_predicate(start, end, inclusive_midnight))
    return df


def export_stats(df: DataFrame) -> DataFrame:
    """Row count and date range of a loaded export (what the report prints after loading)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def read_firewall_log(spark: SparkSession, path: str) -> DataFrame:
    """L1: the 9-column ';' firewall log written by the ingest chain."""
    raw = spark.read.schema(L1_SCHEMA).option("sep", ";").option("header", False).csv(path)
    return to_flows(raw, "L1")


def read_flows_json(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines with the SQL-table field names; policyid '' or missing -> 999, missing
    datetime -> time of arrival."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(L45_SCHEMA).json(path)
    return to_flows(raw, "L5")


def read_fw_table(spark: SparkSession, name: str, jdbc_options: dict | None = None) -> DataFrame:
    """L4: the ``FW`` table, from the catalog or (with options) over JDBC."""
    raw = (spark.read.format("jdbc").options(**jdbc_options).load() if jdbc_options
           else spark.read.table(name))
    return to_flows(raw, "L4")


# ------------------------------------------------------------------------------- writers

def _l1_frame(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("date", _TS_FMT).alias("date"), "ip_source", "ip_destination", "protocol",
                     F.col("dest_port").cast("string"), F.col("rule_id").cast("string"), "action",
                     "interface_in", "interface_out")


def write_firewall_log(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """L1 file sink: ``date;src;dst;proto;dport;rule;action;in;out``."""
    _l1_frame(df).write.mode(mode).option("sep", ";").option("header", False).csv(path)


def write_export(df: DataFrame, path: str, firewall_num: int = 6, mode: str = "overwrite") -> None:
    """L2 export sink (11 columns, ';', no header)."""
    (df.select(F.date_format("date", _TS_FMT).alias("date"), "ip_source", "ip_destination", "protocol",
               "source_port", "dest_port", "rule_id", "action", "interface_in", "interface_out",
               F.lit(firewall_num).alias("firewall_num"))
     .write.mode(mode).option("sep", ";").option("header", False).csv(path))


def write_flows_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """L5 sink: one JSON object per line with the table's field names, all values as text."""
    (df.select(F.date_format("date", _TS_FMT).alias("datetime"), F.col("ip_source").alias("ipsrc"),
               F.col("ip_destination").alias("ipdst"), F.col("protocol").alias("proto"),
               F.col("dest_port").cast("string").alias("dstport"), "action",
               F.col("rule_id").cast("string").alias("policyid"), "interface_in", "interface_out")
     .write.mode(mode).json(path))


def read_l1_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The text columns of L1 files as written, before any cast."""
    cols = ("date", "ip_source", "ip_destination", "protocol", "dest_port", "rule_id", "action", "interface_in", "interface_out")
    return spark.read.schema(", ".join(f"{c} string" for c in cols)).option("sep", ";").csv(paths)


def write_raw(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Copy of accepted raw lines as a text file."""
    lines.select("value").write.mode(mode).text(path)


def append_fw_table(df: DataFrame, name: str, batch_id: int | None = None) -> None:
    """Append rows to the ``FW`` table. With ``batch_id`` the write is idempotent: a replayed
    micro-batch overwrites its own partition instead of duplicating rows."""
    out = df.select(F.col("date").alias("datetime"), F.col("ip_source").alias("ipsrc"),
                    F.col("ip_destination").alias("ipdst"), F.col("dest_port").cast("string").alias("dstport"),
                    F.col("protocol").alias("proto"), "action", F.col("rule_id").cast("string").alias("policyid"),
                    "interface_in", "interface_out")
    spark = df.sparkSession
    if batch_id is None:
        out.write.mode("append").saveAsTable(name)
        return
    out = out.withColumn("batch_id", F.lit(int(batch_id)))
    if spark.catalog.tableExists(name):
        # the batch's own partition goes first; no session setting is touched
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (batch_id = {int(batch_id)})")
        out.write.mode("append").insertInto(name)
    else:
        out.write.partitionBy("batch_id").saveAsTable(name)


def write_daily_index(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per event day (the day-named index); readers get partition pruning on ``day``.

    Rows are clustered by day with a ``REBALANCE`` hint: each task writes few files per day, and
    AQE splits a hot day (say a third of all rows) over several tasks instead of one.
    """
    out = df.withColumn("day", F.to_date("date"))
    (out.hint("rebalance", "day").write.mode(mode).partitionBy("day").format(fmt).save(path))


def export_csv(df: DataFrame, path: str, n: int, order=("date", "flow_id")) -> None:
    """First n rows (in event order) as one header CSV (n is bounded by the caller)."""
    cols = [c for c in order if c in df.columns]
    df.orderBy(*cols).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def publish_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each named report table under ``out_dir`` (one folder per table)."""
    paths = {}
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).option("header", True).save(p)
        paths[name] = p
    return paths


def read_flow_table(spark: SparkSession, path: str) -> DataFrame:
    """A day-partitioned flow table written by ``write_daily_index`` (parquet); ``day`` is the
    partition column, so date filters through ``apply_filter`` prune folders."""
    return spark.read.parquet(path)
