"""Firewall rule table, rule replay (E4), per-second rate cap (G7) and unused rules.

Replay is a join on protocol (and port range) with the port/source predicates as a residual
condition; a flow can match several rules (the logging rules overlap), so the output is one row per
match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.schema import RULE_SCHEMA

# ---------------------------------------------------------------------------------------------
# The logging rule set (id, protocol, port range, excluded ports, source equal,
# source not equal, action, lines per second). The two source rules log an action without a rule id; the
# second one's 30 lines an hour are no whole number a second.
ADMIN_IP = "10.70.40.211"
RULES = (
    (1, "TCP", 22, 22, None, None, None, "Permit", 3),
    (2, "TCP", 23, 23, None, None, None, "Permit", 2),
    (3, "TCP", 20, 21, None, None, None, "Permit", 2),
    (4, "TCP", 80, 80, None, None, None, "Permit", 2),
    (5, "TCP", 3306, 3306, None, None, None, "Permit", 2),
    (6, "UDP", 0, 65535, None, None, None, "Permit", 2),
    (7, "TCP", 443, 443, None, None, None, "Permit", 2),
    (8, "TCP", 445, 445, None, None, None, "Permit", 2),
    (9, "TCP", 110, 110, None, None, None, "Permit", 2),
    (10, "TCP", 8080, 8080, None, None, None, "Permit", 2),
    (11, "TCP", 3389, 3389, None, None, None, "Permit", 2),
    (None, "TCP", 22, 22, None, ADMIN_IP, None, "ADMIN SSH", 3),
    (None, "TCP", 22, 22, None, None, ADMIN_IP, "LIMIT SSH", None),
    (999, "TCP", 0, 65535, [80, 23, 20, 21, 22, 3306, 514], None, None, "Deny", 1),
)
# ---------------------------------------------------------------------------------------------


def rules_df(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _match(f: DataFrame, r: DataFrame):
    port = f["dest_port"]
    return ((f["protocol"] == r["proto"]) & port.between(r["lo"], r["hi"])
            & ~F.coalesce(F.array_contains(r["not_ports"], port), F.lit(False))
            & (r["src_eq"].isNull() | (f["ip_source"] == r["src_eq"]))
            & (r["src_ne"].isNull() | (f["ip_source"] != r["src_ne"])))


def replay(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """All (flow, rule) matches: ``flow_id, rule_id (logged), matched_rule, matched_action``."""
    r = rules.select("proto", "lo", "hi", "not_ports", "src_eq", "src_ne",
                     F.col("rule_id").alias("matched_rule"), F.col("action").alias("matched_action"))
    f = flows.select("flow_id", "protocol", "dest_port", "ip_source", "rule_id", "action")
    return f.join(r, _match(f, r), "inner").select(
        "flow_id", "rule_id", "action", "matched_rule", "matched_action")


PORT_SPAN = 1024


def replay_counts(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches per replayed rule, and how many of those flows also match another rule.

    One plan for any number of rules: a rule's conditions see protocol, port and source only, so flows
    are first counted per such triple (before the shuffle), then joined by protocol and port range;
    Spark picks the join by the sides' sizes.
    """
    f = flows.groupBy("protocol", "dest_port", "ip_source").agg(F.count(F.lit(1)).alias("n_flows"))
    f = f.withColumn("span", F.floor(F.col("dest_port") / PORT_SPAN))
    r = rules.select("proto", "lo", "hi", "not_ports", "src_eq", "src_ne", F.col("rule_id").alias("matched_rule"),
                     F.col("action").alias("matched_action"),
                     F.explode(F.sequence(F.floor(F.col("lo") / PORT_SPAN), F.floor(F.col("hi") / PORT_SPAN))).alias("rule_span"))
    m = f.join(r, _match(f, r) & (f["span"] == r["rule_span"]))
    per = m.groupBy("protocol", "dest_port", "ip_source", "n_flows").agg(
        F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("matched_rule", "matched_action")).alias("hits"))
    return (per.select("n_flows", "k", F.explode("hits").alias("h")).groupBy("h.matched_rule", "h.matched_action")
            .agg(F.sum("n_flows").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("n_flows")).otherwise(0)).alias("n_multi")))


def rate_cap(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep the first ``per_sec`` lines per rule per second (``-m limit --limit n/sec``).

    Partitioned by (rule, second), never by rule alone, so a hot rule spreads over its seconds.
    The literal bound ``rn <= max(per_sec)`` lets Spark insert a per-task group limit before
    the shuffle, so even a (rule, second) holding millions of lines ships at most k rows per task.
    """
    caps = rules.where("rule_id is not null").select("rule_id", "per_sec")
    max_k = int(caps.agg(F.max("per_sec")).first()[0] or 0)  # rule table: a few rows
    sec = F.date_trunc("second", F.col("date"))
    w = Window.partitionBy("rule_id", "sec").orderBy("date", "flow_id")
    ranked = (flows.withColumn("sec", sec).withColumn("rn", F.row_number().over(w))
              .filter(F.col("rn") <= F.lit(max_k)))
    return (ranked.join(caps, "rule_id", "inner")
            .filter(F.col("rn") <= F.col("per_sec")).drop("sec"))


def rate_cap_counts(flows: DataFrame, rules: DataFrame) -> DataFrame:
    kept = rate_cap(flows, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_kept"))
    seen = flows.join(rules.select("rule_id"), "rule_id", "left_semi") \
        .groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_in"))
    return seen.join(kept, "rule_id", "left").na.fill(0, ["n_kept"])


def unused_rules(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with an id that no logged line names (anti join against the distinct logged rule ids)."""
    used = flows.select("rule_id").distinct()
    return rules.where("rule_id is not null").join(used, "rule_id", "left_anti").select("rule_id", "proto", "lo", "hi", "action")
