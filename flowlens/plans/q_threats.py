"""Attack-pattern queries and the SQL function surface."""

from __future__ import annotations

from flowlens.functions.sql import register_functions
from flowlens.operators import detect as D
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import with_flows
from flowlens.sources.tables import flows

_PORTS = "21, 22, 23, 3306, 3389, 445, 137"


@query("port_scan", with_flows("""SELECT ip_source, time_bucket(INTERVAL 1 DAY, date) AS window_start,
 count(DISTINCT dest_port) AS n_ports, count(*) AS n FROM flows GROUP BY 1, 2 HAVING count(DISTINCT dest_port) >= 3"""))
def q_port_scan(spark, sf):
    return D.port_scan(flows(spark, sf), "1 day", 3)


@query("brute_force", with_flows("""SELECT ip_source, time_bucket(INTERVAL 1 HOUR, date) AS window_start,
 count(*) AS n_hits, count(*) FILTER (WHERE action = 'Deny') AS n_denied FROM flows WHERE dest_port IN (21, 22)
 GROUP BY 1, 2 HAVING count(*) >= 2 OR count(*) FILTER (WHERE action = 'Deny') >= 2"""))
def q_brute_force(spark, sf):
    return D.brute_force(flows(spark, sf), (21, 22), "1 hour", 2)


@query("port_scan_fast", with_flows("""SELECT ip_source, time_bucket(INTERVAL 5 MINUTE, date) AS window_start,
 count(DISTINCT dest_port) AS n_ports, count(*) AS n FROM flows GROUP BY 1, 2 HAVING count(DISTINCT dest_port) >= 2"""))
def q_port_scan_fast(spark, sf):
    return D.port_scan(flows(spark, sf), "5 minutes", 2)


@query("brute_force_minute", with_flows("""SELECT ip_source, time_bucket(INTERVAL 1 MINUTE, date) AS window_start,
 count(*) AS n_hits, count(*) FILTER (WHERE action = 'Deny') AS n_denied FROM flows WHERE dest_port IN (21, 22)
 GROUP BY 1, 2 HAVING count(*) >= 1 OR count(*) FILTER (WHERE action = 'Deny') >= 1"""))
def q_brute_force_minute(spark, sf):
    return D.brute_force(flows(spark, sf), (21, 22), "1 minute", 1)


def _sequences_sql(width: str, sources: int, ports: int) -> str:
    return with_flows(f"""SELECT window_start, md5(ports) AS signature, ports, n_ports, count(*) AS n_sources FROM (
 SELECT ip_source, window_start, string_agg(CAST(dest_port AS VARCHAR), '>' ORDER BY d, f) AS ports, CAST(count(*) AS INTEGER) AS n_ports
 FROM (SELECT ip_source, time_bucket(INTERVAL {width}, date) AS window_start, dest_port, min(date) AS d,
   arg_min(flow_id, (date, flow_id)) AS f FROM flows WHERE dest_port IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
WHERE n_ports >= {ports} GROUP BY 1, 2, 3, 4 HAVING count(*) >= {sources}""")


@query("decoy_sequences", _sequences_sql("1 DAY", 2, 2))
def q_decoy_sequences(spark, sf):
    return D.decoy_sequences(flows(spark, sf), "1 day", 2, 2)


@query("decoy_sequences_minute", _sequences_sql("1 MINUTE", 1, 2))
def q_decoy_sequences_minute(spark, sf):
    return D.decoy_sequences(flows(spark, sf), "1 minute", 1, 2)


@query("ddos_spike", with_flows("""SELECT bucket, n, round(mean, 6) AS mean, round(std, 6) AS std FROM (
 SELECT bucket, n, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS std, count(n) OVER w AS k FROM (
  SELECT bucket, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS bucket
    FROM (SELECT time_bucket(INTERVAL 1 HOUR, date) AS b FROM flows)) LEFT JOIN
   (SELECT time_bucket(INTERVAL 1 HOUR, date) AS bucket, count(*) AS n FROM flows GROUP BY 1) USING (bucket))
 WINDOW w AS (ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
WHERE k >= 24 AND n > mean + 3.0 * std"""))
def q_ddos_spike(spark, sf):
    return D.ddos_spike(flows(spark, sf), "1 hour", 24, 3.0)


@query("decoy_scan", with_flows("""SELECT time_bucket(INTERVAL 1 HOUR, date) AS window_start, dest_port,
 count(DISTINCT ip_source) AS n_sources, count(*) AS n FROM flows GROUP BY 1, 2 HAVING count(DISTINCT ip_source) >= 3"""))
def q_decoy_scan(spark, sf):
    return D.decoy_scan(flows(spark, sf), "1 hour", 3)


@query("tcp_udp_risk", with_flows(f"""SELECT protocol, count(*) AS n, count(*) FILTER (WHERE action = 'Deny') AS n_deny,
 count(DISTINCT ip_source) AS n_sources, count(DISTINCT dest_port) AS n_ports,
 count(*) FILTER (WHERE dest_port IN ({_PORTS})) AS n_sensitive,
 count(*) FILTER (WHERE dest_port IN ({_PORTS}) AND action = 'Deny') AS n_sensitive_deny,
 round(count(*) FILTER (WHERE action = 'Deny') / CAST(count(*) AS DOUBLE), 6) AS deny_rate,
 round(count(*) FILTER (WHERE dest_port IN ({_PORTS})) / CAST(count(*) AS DOUBLE), 6) AS sensitive_share
FROM flows GROUP BY protocol"""))
def q_tcp_udp_risk(spark, sf):
    return D.tcp_udp_risk(flows(spark, sf))


@query("sql_functions", with_flows("""SELECT CASE WHEN dest_port IS NULL THEN NULL WHEN dest_port < 1024
 THEN 'System Ports (0-1023)' WHEN dest_port < 49152 THEN 'User Ports (1024-49151)' ELSE 'Dynamic Ports (49152-65535)' END
 AS port_category, CASE WHEN dest_port IS NULL THEN NULL WHEN dest_port <= 1023 THEN 0 WHEN dest_port <= 49151 THEN 1
 ELSE 2 END AS port_bucket, CAST(CAST('0x' || right(md5(protocol), 3) AS INTEGER) % 512 AS INTEGER) AS proto_bucket,
 count(*) AS n FROM flows GROUP BY 1, 2, 3"""))
def q_sql_functions(spark, sf):
    # The registered SQL functions used from plain Spark SQL over a temp view of the flows.
    register_functions(spark)
    flows(spark, sf).createOrReplaceTempView("flowlens_flows")
    return spark.sql("""SELECT port_category(dest_port) AS port_category, port_bucket(dest_port) AS port_bucket,
        word_bucket(protocol) AS proto_bucket, count(*) AS n FROM flowlens_flows GROUP BY 1, 2, 3""")
