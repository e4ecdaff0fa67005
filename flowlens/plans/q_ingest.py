"""Ingest queries: raw-line parsing, classification, acceptance, quarantine, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import normalize as N
from flowlens.operators.filters import FilterSpec, apply_filter
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import ACCEPT_SQL, RAW_MIXED_SQL, parsed_sql, with_flows
from flowlens.session import materialize, scratch_path
from flowlens.sources import io
from flowlens.sources.tables import flows, raw_lines

_MIXED = f"raw AS ({RAW_MIXED_SQL})"


@query("parse_raw_lines", with_flows(parsed_sql("raw"), raw=True), headline=True)
def q_parse_raw_lines(spark, sf):
    return N.parse_raw(raw_lines(spark, sf), keep=("flow_id",))


@query("line_classes", with_flows("SELECT parse_class, count(*) AS n FROM (" + parsed_sql("raw") + ") GROUP BY 1",
                                  extra=_MIXED))
def q_line_classes(spark, sf):
    p = N.parse_raw(raw_lines(spark, sf, mixed=True))
    return p.groupBy("parse_class").agg(F.count(F.lit(1)).alias("n"))


@query("accepted_lines", with_flows(parsed_sql(f"(SELECT * FROM raw WHERE {ACCEPT_SQL})"), extra=_MIXED))
def q_accepted_lines(spark, sf):
    return N.parse_raw(N.accept(raw_lines(spark, sf, mixed=True)), keep=("flow_id",))


@query("quarantine_counts", with_flows(f"""SELECT CASE WHEN NOT contains(value, 'action=') THEN 'not_firewall'
 WHEN NOT contains(value, 'RULE=') THEN 'no_rule' ELSE 'other_action' END AS reason, count(*) AS n
FROM raw WHERE NOT {ACCEPT_SQL} GROUP BY 1""", extra=_MIXED))
def q_quarantine_counts(spark, sf):
    q = N.quarantine(raw_lines(spark, sf, mixed=True))
    return q.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("default_rule", with_flows("SELECT flow_id, rule_id, action, date FROM (" + parsed_sql("raw") + ")",
                                  extra=_MIXED))
def q_default_rule(spark, sf):
    # Every line, accepted or not, gets a rule id: missing / empty RULE -> 999; date from the row.
    return N.parse_raw(raw_lines(spark, sf, mixed=True), keep=("flow_id",)).select("flow_id", "rule_id", "action", "date")


@query("export_summary", with_flows("""SELECT count(*) AS n_rows, min(d) AS date_min, max(d) AS date_max
FROM (SELECT date_trunc('second', date) AS d FROM flows)
WHERE d >= TIMESTAMP '2024-01-05 00:00:00' AND d < TIMESTAMP '2024-01-20 00:00:00'"""))
def q_export_summary(spark, sf):
    # Round trip through the ';' export layout in the shared work folder, then the range read.
    path = scratch_path(spark, "export")
    io.write_export(flows(spark, sf), path)
    return io.export_stats(io.read_flows_export(spark, path, "2024-01-05", "2024-01-20"))


@query("fw_table_rows", with_flows("""SELECT date_trunc('second', date) AS date, ip_source, ip_destination, protocol, dest_port, rule_id, action
FROM flows"""))
def q_fw_table_rows(spark, sf):
    # Two batches into the table, the second one replayed, read back in the canonical columns.
    table = "fw_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    fl = flows(spark, sf).withColumn("date", F.date_trunc("second", "date").cast("timestamp_ntz"))
    first = F.col("flow_id") % 2 == 0
    try:
        io.append_fw_table(fl.where(first), table, 0)
        for _ in range(2):
            io.append_fw_table(fl.where(~first), table, 1)
        got = io.read_fw_table(spark, table)
        return materialize(got.select("date", "ip_source", "ip_destination", "protocol", "dest_port", "rule_id", "action"), "fw-rows")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@query("daily_index_days", with_flows("SELECT CAST(date AS DATE) AS day, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS id_sum FROM flows GROUP BY 1"))
def q_daily_index_days(spark, sf):
    path = scratch_path(spark, "index")
    io.write_daily_index(flows(spark, sf), path)
    return io.read_flow_table(spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("id_sum"))


@query("export_csv_rows", with_flows("""SELECT flow_id, date_trunc('second', date) AS date, ip_source, dest_port, action FROM flows
 WHERE protocol = 'TCP' ORDER BY flows.date, flow_id LIMIT 1000"""))
def q_export_csv_rows(spark, sf):
    # The filtered first rows as one CSV file with a header, read back.
    path = scratch_path(spark, "export-csv")
    tcp = apply_filter(flows(spark, sf), FilterSpec(protocols=("TCP",)))
    io.export_csv(tcp, path, 1000)
    got = spark.read.option("header", True).csv(path)
    return got.select(F.col("flow_id").cast("long").alias("flow_id"),
                      F.date_trunc("second", F.to_timestamp_ntz("date")).cast("timestamp_ntz").alias("date"), "ip_source",
                      F.col("dest_port").cast("int").alias("dest_port"), "action")


@query("raw_copy", with_flows(f"SELECT value FROM raw WHERE {ACCEPT_SQL}", extra=_MIXED))
def q_raw_copy(spark, sf):
    path = scratch_path(spark, "raw-copy")
    io.write_raw(N.accept(raw_lines(spark, sf, mixed=True)), path)
    return spark.read.text(path)
