"""Report sections, conclusion, enrichment and the TCP rule x port x action tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.scalar import with_calendar, with_flags, with_service
from flowlens.operators import report as RP
from flowlens.operators import topk
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import PORT_BUCKET_SQL, PORT_CATEGORY_SQL, SERVICES_SQL, pct_sql, with_flows
from flowlens.session import scratch_path
from flowlens.sources.tables import flows


def _sec_topk(section, key, k, where="", label=None, pct=True):
    w = f"WHERE {where}" if where else ""
    lab = label or f"CAST({key} AS VARCHAR)"
    p = pct_sql("n", f"(SELECT count(*) FROM flows {w})") if pct else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY n DESC, {key}) AS INTEGER) AS rank,"
            f" {lab} AS label, n, {p} AS pct FROM (SELECT {key}, count(*) AS n FROM flows {w} GROUP BY {key}"
            f" ORDER BY n DESC, {key}{'' if k is None else f' LIMIT {k}'})")


_SECTIONS_SQL = with_flows("\nUNION ALL ".join([
    f"""SELECT * FROM (SELECT 'summary' AS section, CAST(r AS INTEGER) AS rank, label, n, pct FROM (
  SELECT unnest([1, 2, 3, 4, 5, 6]) AS r,
   unnest(['total', strftime(min(date), '%d/%m/%Y') || ' - ' || strftime(max(date), '%d/%m/%Y'), 'source_ips', 'rules',
           'permit', 'deny']) AS label,
   unnest([count(*), NULL, count(DISTINCT ip_source), count(DISTINCT rule_id),
           count(*) FILTER (WHERE action = 'Permit'), count(*) FILTER (WHERE action = 'Deny')]) AS n,
   unnest([NULL, NULL, NULL, NULL, {pct_sql("count(*) FILTER (WHERE action = 'Permit')", "count(*)")},
           {pct_sql("count(*) FILTER (WHERE action = 'Deny')", "count(*)")}]) AS pct FROM flows))""",
    "SELECT * FROM (" + _sec_topk("rules", "rule_id", 10) + ")",
    "SELECT * FROM (" + _sec_topk("protocols", "protocol", None, label="protocol") + ")",
    "SELECT * FROM (" + _sec_topk("udp_rules", "rule_id", 10, "protocol = 'UDP'") + ")",
    "SELECT * FROM (" + _sec_topk("tcp_rules", "rule_id", 5, "protocol = 'TCP'") + ")",
    """SELECT * FROM (SELECT 'tcp_rule_port_action' AS section, CAST(row_number() OVER (ORDER BY n DESC, rule_id, dest_port,
 action) AS INTEGER) AS rank, CAST(rule_id AS VARCHAR) || '/' || CAST(dest_port AS VARCHAR) || '/' || action AS label, n,
 CAST(NULL AS DOUBLE) AS pct FROM (SELECT rule_id, dest_port, action, count(*) AS n FROM flows WHERE protocol = 'TCP'
 GROUP BY 1, 2, 3 ORDER BY n DESC, rule_id, dest_port, action LIMIT 20))""",
    """SELECT 'daily' AS section, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS rank, label, n,
 CAST(NULL AS DOUBLE) AS pct FROM (SELECT CAST(CAST(date AS DATE) AS VARCHAR) || ' ' || action AS label, count(*) AS n
 FROM flows GROUP BY CAST(date AS DATE), action)""",
    "SELECT * FROM (" + _sec_topk("denied_ips", "ip_source", 10, "action = 'Deny'", label="ip_source", pct=False) + ")",
    """SELECT 'hourly' AS section, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS rank, label, n,
 CAST(NULL AS DOUBLE) AS pct FROM (SELECT lpad(CAST(hour(date) AS VARCHAR), 2, '0') AS label, count(*) AS n
 FROM flows GROUP BY 1)""",
    "SELECT * FROM (" + _sec_topk("ports", "dest_port", 15, pct=False) + ")",
]))


@query("report_sections", _SECTIONS_SQL, headline=True)
def q_report_sections(spark, sf):
    # Published as a table in the shared folder (the report's data), then read back.
    fl = flows(spark, sf)
    out = scratch_path(spark, "report")
    RP.publish_report(fl, out)
    return spark.read.parquet(f"{out}/sections")


@query("report_conclusion", with_flows(f"""SELECT count(*) AS total,
 (SELECT rule_id FROM flows GROUP BY rule_id ORDER BY count(*) DESC, rule_id LIMIT 1) AS top_rule,
 (SELECT {pct_sql("count(*)", "(SELECT count(*) FROM flows)")} FROM flows GROUP BY rule_id ORDER BY count(*) DESC, rule_id LIMIT 1)
   AS top_rule_pct,
 (SELECT protocol FROM flows GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1) AS top_protocol,
 (SELECT {pct_sql("count(*)", "(SELECT count(*) FROM flows)")} FROM flows GROUP BY protocol ORDER BY count(*) DESC, protocol
   LIMIT 1) AS top_protocol_pct,
 {pct_sql("count(*) FILTER (WHERE action = 'Deny')", "count(*)", 1)} AS deny_pct FROM flows"""))
def q_report_conclusion(spark, sf):
    return RP.report_conclusion(flows(spark, sf))


@query("enrich_flows", with_flows(f"""SELECT f.*, CAST(hour(date) AS INTEGER) AS hour, CAST(date AS DATE) AS day,
 CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(action = 'Deny' AS INTEGER) AS is_deny,
 CAST(protocol = 'TCP' AS INTEGER) AS is_tcp, {PORT_CATEGORY_SQL} AS port_category, CAST({PORT_BUCKET_SQL} AS INTEGER)
 AS port_bucket, coalesce(s.service, 'other') AS service FROM flows f LEFT JOIN ({SERVICES_SQL}) s ON f.dest_port = s.port"""))
def q_enrich_flows(spark, sf):
    return with_service(with_flags(with_calendar(flows(spark, sf))))


@query("tcp_rule_port_action", with_flows("""SELECT rule_id, dest_port, action, count(*) AS n FROM flows
 WHERE protocol = 'TCP' GROUP BY 1, 2, 3 ORDER BY n DESC, rule_id, dest_port, action LIMIT 20"""))
def q_tcp_rule_port_action(spark, sf):
    return topk.top_k(flows(spark, sf), ["rule_id", "dest_port", "action"], 20, where=F.col("protocol") == "TCP")


_TOP_TCP = """tr AS (SELECT rule_id FROM flows WHERE protocol = 'TCP' GROUP BY 1 ORDER BY count(*) DESC, rule_id LIMIT 10),
tp AS (SELECT dest_port FROM flows WHERE protocol = 'TCP' GROUP BY 1 ORDER BY count(*) DESC, dest_port LIMIT 10)"""


@query("tcp_rule_port_matrix", with_flows("""SELECT rule_id, dest_port, count(*) AS n FROM flows WHERE protocol = 'TCP'
 AND rule_id IN (SELECT rule_id FROM tr) AND dest_port IN (SELECT dest_port FROM tp) GROUP BY 1, 2""", extra=_TOP_TCP))
def q_tcp_rule_port_matrix(spark, sf):
    tcp = flows(spark, sf).filter(F.col("protocol") == "TCP")
    tr = topk.top_k(tcp, "rule_id", 10).select("rule_id")
    tp = topk.top_k(tcp, "dest_port", 10).select("dest_port")
    # Semi joins against the two top-10 key lists (10 rows each: a proven broadcast size).
    m = tcp.join(F.broadcast(tr), "rule_id", "left_semi").join(F.broadcast(tp), "dest_port", "left_semi")
    return m.groupBy("rule_id", "dest_port").agg(F.count(F.lit(1)).alias("n"))


@query("tcp_rule_action", with_flows("""SELECT rule_id, count(*) FILTER (WHERE action = 'Deny') AS Deny,
 count(*) FILTER (WHERE action = 'Permit') AS Permit FROM flows WHERE protocol = 'TCP'
 AND rule_id IN (SELECT rule_id FROM tr) GROUP BY 1""", extra=_TOP_TCP))
def q_tcp_rule_action(spark, sf):
    from flowlens.operators.kpi import crosstab
    tcp = flows(spark, sf).filter(F.col("protocol") == "TCP")
    tr = topk.top_k(tcp, "rule_id", 10).select("rule_id")
    return crosstab(tcp.join(F.broadcast(tr), "rule_id", "left_semi"), "rule_id", ("Deny", "Permit"))
