"""Rule replay, rate cap and unused rules over the flow view."""

from __future__ import annotations

from flowlens.operators import rules as R
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import rules_sql, with_flows
from flowlens.sources.tables import flows

_RULES = f"rules AS ({rules_sql()})"


@query("rule_replay", with_flows("""SELECT matched_rule, matched_action, count(*) AS n,
 count(*) FILTER (WHERE k > 1) AS n_multi FROM (
 SELECT m.*, count(*) OVER (PARTITION BY flow_id) AS k FROM (
  SELECT f.flow_id, r.rule_id AS matched_rule, r.action AS matched_action FROM flows f JOIN rules r
   ON f.protocol = r.proto AND f.dest_port BETWEEN r.lo AND r.hi
   AND NOT coalesce(list_contains(r.not_ports, f.dest_port), false)
   AND (r.src_eq IS NULL OR f.ip_source = r.src_eq) AND (r.src_ne IS NULL OR f.ip_source <> r.src_ne)) m)
GROUP BY 1, 2""", extra=_RULES), headline=True)
def q_rule_replay(spark, sf):
    return R.replay_counts(flows(spark, sf), R.rules_df(spark))


@query("rate_cap", with_flows("""SELECT i.rule_id, i.n_in, coalesce(k.n_kept, 0) AS n_kept FROM
 (SELECT rule_id, count(*) AS n_in FROM flows WHERE rule_id IN (SELECT rule_id FROM rules) GROUP BY 1) i
 LEFT JOIN (SELECT rule_id, count(*) AS n_kept FROM (
   SELECT f.rule_id, r.per_sec, row_number() OVER (PARTITION BY f.rule_id, date_trunc('second', f.date)
     ORDER BY f.date, f.flow_id) AS rn FROM flows f JOIN rules r ON f.rule_id = r.rule_id) WHERE rn <= per_sec
   GROUP BY 1) k ON i.rule_id = k.rule_id""", extra=_RULES))
def q_rate_cap(spark, sf):
    return R.rate_cap_counts(flows(spark, sf), R.rules_df(spark))


@query("unused_rules", with_flows("""SELECT rule_id, proto, lo, hi, action FROM rules
 WHERE rule_id IS NOT NULL AND rule_id NOT IN (SELECT DISTINCT rule_id FROM flows WHERE rule_id IS NOT NULL)""", extra=_RULES))
def q_unused_rules(spark, sf):
    return R.unused_rules(flows(spark, sf), R.rules_df(spark))
