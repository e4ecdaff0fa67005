"""Report tables (N1-N7, A13): every chapter of the batch report as rows of one long table
``(section, rank, label, n, pct)``, plus the conclusion figures. Each section is a small
aggregate or top-k; the union is bounded by the section limits (and days / hours for the
time sections)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.topk import top_k


def _ranked(df: DataFrame, section: str, label, n: str = "n", pct: str | None = "pct", keys=None) -> DataFrame:
    """Rank a (small, already limited) section table by count desc then ``keys`` (default: label)."""
    keys = keys or []
    order = [F.col(n).desc()] + [F.col(k).asc() for k in keys] if keys else [F.col("_label")]
    w = Window.partitionBy("section").orderBy(*order)
    out = df.select(F.lit(section).alias("section"), label.cast("string").alias("_label"), F.col(n).cast("long").alias("n"),
                    (F.col(pct) if pct else F.lit(None).cast("double")).alias("pct"), *keys)
    return out.select("section", F.row_number().over(w).alias("rank"), F.col("_label").alias("label"), "n", "pct")


def report_sections(df: DataFrame, rollups: dict[str, DataFrame] | None = None) -> DataFrame:
    """All report chapters as ``(section, rank, label, n, pct)``, from the narrow ``flow_rollups``."""
    from flowlens.operators.kpi import flow_rollups
    r = rollups if rollups is not None else flow_rollups(df)
    time, c, source = r["time"], r["service"], r["source"]
    a = F.col("action")
    n = F.col("n")
    head = time.agg(F.sum(n).alias("total"), F.sum(F.when(a == "Permit", n).otherwise(0)).alias("permit"),
                    F.sum(F.when(a == "Deny", n).otherwise(0)).alias("deny"), F.min("first_seen").alias("dmin"),
                    F.max("last_seen").alias("dmax"))
    head = head.withColumn("ips", source.agg(F.count_distinct("ip_source")).scalar()).withColumn(
        "rules", c.agg(F.count_distinct("rule_id")).scalar())
    p2 = lambda c_: F.round((F.lit(100.0) * F.col(c_)) / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 2)
    def row(rank, label, n, pct=None):
        return F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"),
                        (F.lit(None) if n is None else n).cast("long").alias("n"),
                        (F.lit(None) if pct is None else pct).cast("double").alias("pct"))
    period = F.concat(F.date_format("dmin", "dd/MM/yyyy"), F.lit(" - "), F.date_format("dmax", "dd/MM/yyyy"))
    summary = head.select(F.explode(F.array(
        row(1, "total", F.col("total")), row(2, period, None), row(3, "source_ips", F.col("ips")),
        row(4, "rules", F.col("rules")), row(5, "permit", F.col("permit"), p2("permit")),
        row(6, "deny", F.col("deny"), p2("deny")))).alias("s"))
    summary = summary.select(F.lit("summary").alias("section"), F.col("s.rank").cast("int").alias("rank"),
                             F.col("s.label").alias("label"), F.col("s.n").cast("long").alias("n"), F.col("s.pct").alias("pct"))
    tcp, udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    tk = lambda *a_, frame=c, **k_: top_k(frame, *a_, weight="n", **k_)
    parts = [
        summary,
        _ranked(tk("rule_id", 10, share=True), "rules", F.col("rule_id"), keys=["rule_id"]),
        _ranked(tk("protocol", None, share=True), "protocols", F.col("protocol"), keys=["protocol"]),
        _ranked(tk("rule_id", 10, where=udp, share=True), "udp_rules", F.col("rule_id"), keys=["rule_id"]),
        _ranked(tk("rule_id", 5, where=tcp, share=True), "tcp_rules", F.col("rule_id"), keys=["rule_id"]),
        _ranked(tk(["rule_id", "dest_port", "action"], 20, where=tcp), "tcp_rule_port_action",
                F.concat_ws("/", F.col("rule_id").cast("string"), F.col("dest_port").cast("string"), F.col("action")),
                pct=None, keys=["rule_id", "dest_port", "action"]),
        _ranked(time.groupBy("day", "action").agg(F.sum(n).alias("n")), "daily",
                F.concat_ws(" ", F.col("day").cast("string"), F.col("action")), pct=None),
        _ranked(tk("ip_source", 10, frame=source, where=a == "Deny"), "denied_ips", F.col("ip_source"), pct=None,
                keys=["ip_source"]),
        _ranked(time.groupBy("hour").agg(F.sum(n).alias("n")), "hourly",
                F.lpad(F.col("hour").cast("string"), 2, "0"), pct=None),
        _ranked(tk("dest_port", 15), "ports", F.col("dest_port"), pct=None, keys=["dest_port"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_conclusion(df: DataFrame, rollups: dict[str, DataFrame] | None = None) -> DataFrame:
    """Top rule and protocol with their shares, and the deny percentage (conclusion figures).

    Without shared roll-ups, one materialised count per protocol, rule and action serves all figures: one scan of the lines.
    """
    from flowlens.session import materialize
    c = rollups["service"] if rollups is not None else materialize(
        df.groupBy("protocol", "rule_id", "action").agg(F.count(F.lit(1)).alias("n")), "rollup-conclusion")
    rule = top_k(c, "rule_id", 1, share=True, weight="n")
    proto = top_k(c, "protocol", 1, share=True, weight="n")
    head = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("action") == "Deny", F.col("n")).otherwise(0)).alias("deny"))
    r = rule.select(F.struct("rule_id", "pct")).scalar()      # one subquery per top-1 table
    p = proto.select(F.struct("protocol", "pct")).scalar()
    return head.select(
        "total",
        r["rule_id"].alias("top_rule"), r["pct"].alias("top_rule_pct"),
        p["protocol"].alias("top_protocol"), p["pct"].alias("top_protocol_pct"),
        F.round((F.lit(100.0) * F.col("deny")) / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 1).alias("deny_pct"))


def publish_report(df: DataFrame, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Write the report tables (sections + conclusion) under ``out_dir``; both use the same roll-ups."""
    from flowlens.operators.kpi import flow_rollups
    from flowlens.sources.io import publish_tables
    r = flow_rollups(df)
    return publish_tables({"sections": report_sections(df, r), "conclusion": report_conclusion(df, r)}, out_dir, fmt)
