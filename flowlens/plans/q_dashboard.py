"""Dashboard, key-figure and top-k queries over the flow view."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.scalar import out_of_plan, port_category, with_service
from flowlens.operators import kpi, topk
from flowlens.operators.filters import FilterSpec, apply_filter, selectivity
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import PORT_CATEGORY_SQL, SERVICES_SQL, pct_sql, with_flows
from flowlens.sources.tables import flows

# ---------------------------------------------------------------- key figures


@query("kpis", with_flows(f"""SELECT count(*) AS total,
 count(*) FILTER (WHERE action = 'Permit') AS permit,
 count(*) FILTER (WHERE action = 'Deny') AS deny,
 count(*) FILTER (WHERE action IS NULL OR action NOT IN ('Permit', 'Deny')) AS other,
 count(DISTINCT ip_source) AS n_src_ips, count(DISTINCT dest_port) AS n_dest_ports,
 round(avg(CASE WHEN action = 'Deny' THEN 1 ELSE 0 END), 6) AS deny_rate
FROM flows"""), headline=True)
def q_kpis(spark, sf):
    return kpi.kpis(flows(spark, sf))


@query("exec_summary", with_flows(f"""SELECT count(*) AS total, min(date) AS date_min, max(date) AS date_max,
 count(DISTINCT ip_source) AS n_ips, count(DISTINCT rule_id) AS n_rules,
 {pct_sql("count(*) FILTER (WHERE action = 'Permit')", "count(*)")} AS pct_permit,
 {pct_sql("count(*) FILTER (WHERE action = 'Deny')", "count(*)")} AS pct_deny
FROM flows"""))
def q_exec_summary(spark, sf):
    return kpi.exec_summary(flows(spark, sf))


# ---------------------------------------------------------------- cross-tabs and profiles


@query("protocol_action", with_flows("""SELECT protocol, count(*) FILTER (WHERE action = 'Permit') AS Permit,
 count(*) FILTER (WHERE action = 'Deny') AS Deny FROM flows GROUP BY protocol"""))
def q_protocol_action(spark, sf):
    return kpi.crosstab(flows(spark, sf), "protocol")


@query("daily_port_category", with_flows(f"""SELECT CAST(date AS DATE) AS day, {PORT_CATEGORY_SQL} AS port_category,
 count(*) AS n FROM flows GROUP BY 1, 2"""), headline=True)
def q_daily_port_category(spark, sf):
    return kpi.daily_port_category(flows(spark, sf))


@query("range_presets", with_flows("""SELECT p.preset_days, p.label, s.span_days,
 coalesce(s.span_days >= p.preset_days, false) AS enabled
FROM (SELECT CAST(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) AS BIGINT) AS span_days FROM flows) s,
 (VALUES (7, '1 semaine'), (14, '2 semaines'), (30, '1 mois'), (60, '2 mois')) AS p(preset_days, label)"""))
def q_range_presets(spark, sf):
    return kpi.range_presets(flows(spark, sf))


@query("protocol_block_rate", with_flows(f"""SELECT protocol, count(*) AS total,
 count(*) FILTER (WHERE action = 'Deny') AS denied,
 {pct_sql("count(*) FILTER (WHERE action = 'Deny')", "count(*)")} AS deny_rate
FROM flows GROUP BY protocol"""))
def q_protocol_block_rate(spark, sf):
    return kpi.block_rate(flows(spark, sf), "protocol")


@query("port_category_share", with_flows(f"""SELECT port_category, count(*) AS n,
 {pct_sql("count(*)", "(SELECT count(*) FROM flows)")} AS pct
FROM (SELECT {PORT_CATEGORY_SQL} AS port_category FROM flows) GROUP BY port_category"""))
def q_port_category_share(spark, sf):
    return kpi.share(flows(spark, sf).select(port_category().alias("port_category")), "port_category")


@query("port_category_action", with_flows(f"""SELECT port_category,
 count(*) FILTER (WHERE action = 'Permit') AS Permit, count(*) FILTER (WHERE action = 'Deny') AS Deny
FROM (SELECT {PORT_CATEGORY_SQL} AS port_category, action FROM flows) GROUP BY port_category"""))
def q_port_category_action(spark, sf):
    return kpi.crosstab(flows(spark, sf).withColumn("port_category", port_category()), "port_category")


@query("protocol_rollup", with_flows(f"""SELECT protocol, port_category, count(*) AS n,
 count(*) FILTER (WHERE action = 'Permit') AS Permit, count(*) FILTER (WHERE action = 'Deny') AS Deny,
 CAST(GROUPING(protocol, port_category) AS BIGINT) AS level
FROM (SELECT protocol, {PORT_CATEGORY_SQL} AS port_category, action FROM flows)
GROUP BY ROLLUP (protocol, port_category)"""))
def q_protocol_rollup(spark, sf):
    return kpi.protocol_rollup(flows(spark, sf))


@query("daily_actions", with_flows("""SELECT CAST(date AS DATE) AS day,
 count(*) FILTER (WHERE action = 'Permit') AS Permit, count(*) FILTER (WHERE action = 'Deny') AS Deny,
 count(*) AS total FROM flows GROUP BY 1"""))
def q_daily_actions(spark, sf):
    return kpi.daily_actions(flows(spark, sf))


@query("hourly_traffic", with_flows("""SELECT CAST(hour(date) AS INTEGER) AS hour, count(*) AS n FROM flows GROUP BY 1"""),
       headline=True)
def q_hourly_traffic(spark, sf):
    return kpi.hourly(flows(spark, sf))


@query("hourly_actions", with_flows("""SELECT CAST(hour(date) AS INTEGER) AS hour, action, count(*) AS n
FROM flows GROUP BY 1, 2"""))
def q_hourly_actions(spark, sf):
    return kpi.hourly(flows(spark, sf), by_action=True)


@query("peak_hours", with_flows("""SELECT
 (SELECT CAST(hour(date) AS INTEGER) FROM flows GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
 (SELECT CAST(hour(date) AS INTEGER) FROM flows WHERE action = 'Deny' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
   AS peak_deny_hour"""))
def q_peak_hours(spark, sf):
    return kpi.peak_hours(flows(spark, sf))


@query("timeline_actions", with_flows("""SELECT date_trunc('hour', date) AS bucket,
 count(*) FILTER (WHERE action = 'Permit') AS Permit, count(*) FILTER (WHERE action = 'Deny') AS Deny
FROM flows GROUP BY 1"""))
def q_timeline_actions(spark, sf):
    a = F.col("action")
    return (flows(spark, sf).groupBy(F.date_trunc("hour", "date").cast("timestamp_ntz").alias("bucket"))
            .agg(F.count_if(a == "Permit").alias("Permit"), F.count_if(a == "Deny").alias("Deny")))


@query("rule_action", with_flows("""SELECT rule_id, count(*) FILTER (WHERE action = 'Permit') AS Permit,
 count(*) FILTER (WHERE action = 'Deny') AS Deny FROM flows GROUP BY rule_id"""))
def q_rule_action(spark, sf):
    return kpi.crosstab(flows(spark, sf), "rule_id")


@query("ip_behaviour", with_flows("""SELECT ip_source, count(ip_destination) AS n_dest_rows,
 count(DISTINCT ip_destination) AS n_dest_distinct,
 count(*) FILTER (WHERE action = 'Deny') AS denied, count(*) FILTER (WHERE action = 'Permit') AS permitted,
 count(*) FILTER (WHERE action = 'Deny') + count(*) FILTER (WHERE action = 'Permit') AS total
FROM flows GROUP BY ip_source"""))
def q_ip_behaviour(spark, sf):
    from flowlens.operators.profiles import ip_behaviour
    return ip_behaviour(flows(spark, sf))


# ---------------------------------------------------------------- top-k


def _topk_sql(key: str, k: int, where: str = "", share: bool = False, name: str = "n") -> str:
    w = f"WHERE {where}" if where else ""
    pct = f", {pct_sql(f'count(*)', f'(SELECT count(*) FROM flows {w})')} AS pct" if share else ""
    return with_flows(f"SELECT {key}, count(*) AS {name}{pct} FROM flows {w} GROUP BY {key} "
                      f"ORDER BY {name} DESC, {key} LIMIT {k}")


@query("rule_ranking", with_flows(f"""SELECT rule_id, count(*) AS n,
 {pct_sql("count(*)", "(SELECT count(*) FROM flows)")} AS pct FROM flows GROUP BY rule_id"""), headline=True)
def q_rule_ranking(spark, sf):
    return kpi.share(flows(spark, sf), "rule_id")


@query("protocol_share", with_flows(f"""SELECT protocol, count(*) AS n,
 {pct_sql("count(*)", "(SELECT count(*) FROM flows)")} AS pct FROM flows GROUP BY protocol"""))
def q_protocol_share(spark, sf):
    return kpi.share(flows(spark, sf), "protocol")


@query("top_udp_rules", _topk_sql("rule_id", 10, "protocol = 'UDP'", share=True))
def q_top_udp_rules(spark, sf):
    return topk.top_k(flows(spark, sf), "rule_id", 10, where=F.col("protocol") == "UDP", share=True)


@query("top_tcp_rules", _topk_sql("rule_id", 5, "protocol = 'TCP'", share=True))
def q_top_tcp_rules(spark, sf):
    return topk.top_k(flows(spark, sf), "rule_id", 5, where=F.col("protocol") == "TCP", share=True)


@query("top_denied_ips", _topk_sql("ip_source", 10, "action = 'Deny'"), headline=True)
def q_top_denied_ips(spark, sf):
    return topk.top_k(flows(spark, sf), "ip_source", 10, where=F.col("action") == "Deny")


@query("top_ports", _topk_sql("dest_port", 15))
def q_top_ports(spark, sf):
    return topk.top_k(flows(spark, sf), "dest_port", 15)


@query("top_source_ips", _topk_sql("ip_source", 5))
def q_top_source_ips(spark, sf):
    return topk.top_k(flows(spark, sf), "ip_source", 5)


@query("top_denied_ports", _topk_sql("dest_port", 10, "action = 'Deny'"))
def q_top_denied_ports(spark, sf):
    return topk.top_k(flows(spark, sf), "dest_port", 10, where=F.col("action") == "Deny")


@query("top_ports_by_protocol", with_flows("""SELECT * FROM (SELECT protocol, dest_port, count(*) AS n,
 CAST(row_number() OVER (PARTITION BY protocol ORDER BY count(*) DESC, dest_port) AS INTEGER) AS rank
 FROM flows GROUP BY protocol, dest_port) WHERE rank <= 5"""), headline=True)
def q_top_ports_by_protocol(spark, sf):
    return topk.top_k_per(flows(spark, sf), "protocol", "dest_port", 5)


@query("privileged_ports", with_flows(f"""SELECT t.dest_port, t.n, coalesce(s.service, 'Autre') AS service
FROM (SELECT dest_port, count(*) AS n FROM flows WHERE dest_port < 1024 GROUP BY dest_port
      ORDER BY n DESC, dest_port LIMIT 10) t LEFT JOIN ({SERVICES_SQL}) s ON t.dest_port = s.port"""))
def q_privileged_ports(spark, sf):
    top = topk.top_k(flows(spark, sf), "dest_port", 10, where=F.col("dest_port") < 1024)
    return with_service(top, default="Autre")


@query("rule_usage_deny", with_flows("""SELECT * FROM (SELECT 'all' AS kind, rule_id, count(*) AS n FROM flows
  GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'deny' AS kind, rule_id, count(*) AS n FROM flows WHERE action = 'Deny'
  GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10)"""))
def q_rule_usage_deny(spark, sf):
    fl = flows(spark, sf)
    a = topk.top_k(fl, "rule_id", 15).select(F.lit("all").alias("kind"), "rule_id", "n")
    d = topk.top_k(fl, "rule_id", 10, where=F.col("action") == "Deny").select(F.lit("deny").alias("kind"), "rule_id", "n")
    return a.unionByName(d)


@query("suspect_ips", with_flows("""SELECT ip_source, n, round(p95, 6) AS threshold FROM (
 SELECT ip_source, count(*) AS n FROM flows WHERE action = 'Deny' GROUP BY ip_source) c,
 (SELECT quantile_cont(n, 0.95) AS p95 FROM (SELECT count(*) AS n FROM flows WHERE action = 'Deny' GROUP BY ip_source)) q
WHERE n > p95 ORDER BY n DESC, ip_source LIMIT 20"""))
def q_suspect_ips(spark, sf):
    return topk.quantile_outliers(flows(spark, sf), "ip_source", 0.95, 20, where=F.col("action") == "Deny")


@query("out_of_plan_ips", with_flows("""SELECT ip_source, count(*) AS n, min(date) AS first_seen FROM flows
WHERE NOT starts_with(ip_source, '159.84') GROUP BY ip_source ORDER BY first_seen, ip_source LIMIT 20"""))
def q_out_of_plan_ips(spark, sf):
    fl = flows(spark, sf).filter(out_of_plan("ip_source"))
    return (fl.groupBy("ip_source").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_seen"))
            .orderBy("first_seen", "ip_source").limit(20))


@query("sensitive_denies", with_flows("""SELECT * FROM flows WHERE action = 'Deny'
 AND dest_port IN (21, 22, 23, 3306, 3389, 445, 137) ORDER BY date, flow_id LIMIT 50"""))
def q_sensitive_denies(spark, sf):
    from flowlens.operators.chunks import sensitive_denies
    return sensitive_denies(flows(spark, sf), 50)


@query("recent_events", with_flows("""SELECT * FROM flows ORDER BY date DESC, flow_id DESC LIMIT 20"""))
def q_recent_events(spark, sf):
    return topk.recent(flows(spark, sf), 20)


# ---------------------------------------------------------------- filters


@query("flow_filter", with_flows("""SELECT * FROM flows WHERE protocol IN ('TCP') AND dest_port < 1024"""))
def q_flow_filter(spark, sf):
    return apply_filter(flows(spark, sf), FilterSpec(protocols=("TCP",), port_range="system"))


@query("flow_filter_custom", with_flows("""SELECT * FROM flows WHERE protocol IN ('TCP', 'UDP')
 AND dest_port BETWEEN 1000 AND 5000"""))
def q_flow_filter_custom(spark, sf):
    return apply_filter(flows(spark, sf), FilterSpec(protocols=("TCP", "UDP"), port_range="custom",
                                                     port_min=1000, port_max=5000))


@query("raw_explorer", with_flows("""SELECT * FROM flows WHERE protocol IN ('TCP', 'UDP') AND action IN ('Deny')
 ORDER BY date, flow_id LIMIT 100"""))
def q_raw_explorer(spark, sf):
    fl = apply_filter(flows(spark, sf), FilterSpec(protocols=("TCP", "UDP"), actions=("Deny",)))
    return topk.first_rows(fl, 100)


@query("filter_selectivity", with_flows(f"""SELECT count(*) FILTER (WHERE protocol IN ('UDP') AND dest_port >= 1024
 AND dest_port < 49152) AS kept, count(*) AS total,
 {pct_sql("count(*) FILTER (WHERE protocol IN ('UDP') AND dest_port >= 1024 AND dest_port < 49152)", "count(*)")} AS pct
FROM flows"""))
def q_filter_selectivity(spark, sf):
    return selectivity(flows(spark, sf), FilterSpec(protocols=("UDP",), port_range="user"))


@query("filter_options", with_flows("""SELECT DISTINCT 'protocol' AS kind, protocol AS value FROM flows
UNION ALL SELECT DISTINCT 'action' AS kind, action AS value FROM flows"""))
def q_filter_options(spark, sf):
    fl = flows(spark, sf)
    return (fl.select(F.lit("protocol").alias("kind"), F.col("protocol").alias("value")).distinct()
            .unionByName(fl.select(F.lit("action").alias("kind"), F.col("action").alias("value")).distinct()))


@query("dash_filtered_block_rate", with_flows(f"""SELECT protocol, count(*) AS total,
 count(*) FILTER (WHERE action = 'Deny') AS denied,
 {pct_sql("count(*) FILTER (WHERE action = 'Deny')", "count(*)")} AS deny_rate
FROM flows WHERE protocol IN ('TCP', 'UDP') AND dest_port >= 1024 AND dest_port < 49152 GROUP BY protocol"""))
def q_dash_filtered_block_rate(spark, sf):
    from flowlens.operators.dashboard import dashboard_panels
    spec = FilterSpec(protocols=("TCP", "UDP"), port_range="user")
    return dashboard_panels(flows(spark, sf), spec)["block_rate"]


@query("dash_filtered_privileged_ports", with_flows(f"""SELECT t.dest_port, t.n, coalesce(s.service, 'Autre') AS service
FROM (SELECT dest_port, count(*) AS n FROM flows WHERE protocol IN ('TCP') AND action IN ('Deny') AND dest_port < 1024
      GROUP BY dest_port ORDER BY n DESC, dest_port LIMIT 10) t LEFT JOIN ({SERVICES_SQL}) s ON t.dest_port = s.port"""))
def q_dash_filtered_privileged_ports(spark, sf):
    from flowlens.operators.dashboard import dashboard_panels
    spec = FilterSpec(protocols=("TCP",), actions=("Deny",))
    return dashboard_panels(flows(spark, sf), spec)["privileged_ports"]


@query("recent_events_filtered", with_flows("""SELECT * FROM flows WHERE protocol IN ('TCP') AND action IN ('Deny')
 AND rule_id IN (999) ORDER BY date DESC, flow_id DESC LIMIT 20"""))
def q_recent_events_filtered(spark, sf):
    # The saved panel's controls (action / protocol / policy / source) applied to the newest events.
    spec = FilterSpec(protocols=("TCP",), actions=("Deny",), rules=(999,))
    return topk.recent(apply_filter(flows(spark, sf), spec), 20)


@query("recent_events_by_ip", with_flows("""SELECT * FROM flows WHERE ip_source IN ('203.0.113.5', '159.84.1.8')
 ORDER BY date DESC, flow_id DESC LIMIT 20"""))
def q_recent_events_by_ip(spark, sf):
    spec = FilterSpec(ips=("203.0.113.5", "159.84.1.8"))
    return topk.recent(apply_filter(flows(spark, sf), spec), 20)


@query("daily_actions_long", with_flows("""SELECT CAST(date AS DATE) AS day, action, count(*) AS n
FROM flows GROUP BY 1, 2"""))
def q_daily_actions_long(spark, sf):
    return kpi.counts_over(flows(spark, sf).withColumn("day", F.to_date("date")), ["day", "action"])


@query("privileged_ports_permit", with_flows(f"""SELECT t.dest_port, t.n, coalesce(s.service, 'Autre') AS service
FROM (SELECT dest_port, count(*) AS n FROM flows WHERE dest_port < 1024 AND action = 'Permit' GROUP BY dest_port
      ORDER BY n DESC, dest_port LIMIT 10) t LEFT JOIN ({SERVICES_SQL}) s ON t.dest_port = s.port"""))
def q_privileged_ports_permit(spark, sf):
    top = topk.top_k(flows(spark, sf), "dest_port", 10, where=(F.col("dest_port") < 1024) & (F.col("action") == "Permit"))
    return with_service(top, default="Autre")


@query("look_back_counts", with_flows("""SELECT span, count(*) AS n, count(*) FILTER (WHERE action = 'Deny') AS n_deny FROM (
 SELECT 'all' AS span, action FROM flows
 UNION ALL SELECT '7 days', action FROM flows WHERE date >= (SELECT max(date) FROM flows) - INTERVAL 7 DAY
 UNION ALL SELECT '1 months', action FROM flows WHERE date >= (SELECT max(date) FROM flows) - INTERVAL 1 MONTH
 UNION ALL SELECT '3 months', action FROM flows WHERE date >= (SELECT max(date) FROM flows) - INTERVAL 3 MONTH)
GROUP BY span"""))
def q_look_back_counts(spark, sf):
    from flowlens.operators.filters import look_back
    fl, out = flows(spark, sf), None
    for span in ("all", "7 days", "1 months", "3 months"):
        part = look_back(fl, span).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "Deny").alias("n_deny")).select(
            F.lit(span).alias("span"), "n", "n_deny")
        out = part if out is None else out.unionByName(part)
    return out


@query("layout_kpis", with_flows("""SELECT layout, count(*) AS total, count(*) FILTER (WHERE action = 'Permit') AS permit,
 count(*) FILTER (WHERE action = 'Deny') AS deny, count(*) FILTER (WHERE action NOT IN ('Permit', 'Deny')) AS other
FROM flows, (VALUES ('L1'), ('L2'), ('L3'), ('L5')) AS t(layout) GROUP BY layout"""))
def q_layout_kpis(spark, sf):
    """Flows written to each file layout with the device's upper-case actions and read back."""
    from flowlens.session import scratch_path
    from flowlens.sources import io
    a = F.col("action")
    fl = flows(spark, sf).withColumn("action", F.when(a == "Permit", "PERMIT").when(a == "Deny", "DENY").otherwise(a))
    at = {k: scratch_path(spark, f"layout-{k}") for k in ("L1", "L2", "L3", "L5")}
    io.write_firewall_log(fl, at["L1"])
    io.write_export(fl, at["L2"])
    fl.select("date", "ip_source", "ip_destination", "protocol", "source_port", "dest_port", "rule_id", "action", "interface_in",
              "interface_out").write.option("header", True).csv(at["L3"])
    io.write_flows_json(fl, at["L5"])
    read = {"L1": io.read_firewall_log, "L2": io.read_flows_export, "L3": io.read_flows_csv, "L5": io.read_flows_json}
    out = None
    for layout, path in at.items():
        x = read[layout](spark, path).agg(
            F.count(F.lit(1)).alias("total"), F.count_if(a == "Permit").alias("permit"), F.count_if(a == "Deny").alias("deny"),
            F.count_if(~a.isin("Permit", "Deny")).alias("other")).select(F.lit(layout).alias("layout"), "*")
        out = x if out is None else out.unionByName(x)
    return out
