"""Model tables on given scores, rules, loadings and centres.

The fitted models have no SQL equivalent, but what is done with their output has: these queries feed the same operators with
scores and parameters that SQL can state, so every row is compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import classify, clusters, iforest
from flowlens.operators.profiles import LOF_FEATURES, ip_profiles, standardize
from flowlens.operators.retrieval import folds
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import PROFILES_CTE, scaled_cte, with_flows
from flowlens.session import materialize
from flowlens.sources.tables import flows

_FLAGGED = PROFILES_CTE + """,
scored AS (SELECT ip_source, -(deny_ratio + n_distinct_ports / 1000.0) AS score FROM prof),
cut AS (SELECT score AS c FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM scored)
  WHERE rn = greatest(1, CAST(ceil(0.05 * n) AS BIGINT))),
flagged AS (SELECT ip_source, score, CASE WHEN score < (SELECT c FROM cut) THEN 'Suspect' ELSE 'Normal' END AS status FROM scored)"""


def _flagged(spark, sf):
    scored = ip_profiles(flows(spark, sf)).select(
        "ip_source", (-(F.col("deny_ratio") + F.col("n_distinct_ports") / F.lit(1000.0))).alias("score"))
    return iforest.flag_suspects(materialize(scored, "given-scores"), 0.05)


@query("given_scores_summary", with_flows("""SELECT count(*) FILTER (WHERE status = 'Suspect') AS n_suspect,
 count(*) FILTER (WHERE status = 'Normal') AS n_normal, round(avg(CAST(status = 'Suspect' AS INTEGER)), 6) AS suspect_rate
FROM flagged""", extra=_FLAGGED))
def q_given_scores_summary(spark, sf):
    return iforest.anomaly_summary(_flagged(spark, sf))


@query("given_scores_top", with_flows("""SELECT ip_source, round(score, 9) AS score, status FROM flagged
 ORDER BY flagged.score, ip_source LIMIT 15""", extra=_FLAGGED))
def q_given_scores_top(spark, sf):
    return _flagged(spark, sf).orderBy("score", "ip_source").limit(15).withColumn("score", F.round("score", 9))


@query("given_scores_histogram", with_flows("""SELECT status, CAST(least(40, floor((score - lo) / ((hi + 1e-12 - lo) / 40)) + 1) AS BIGINT)
 AS bin, count(*) AS n FROM flagged, (SELECT min(score) AS lo, max(score) AS hi FROM flagged) GROUP BY 1, 2""", extra=_FLAGGED))
def q_given_scores_histogram(spark, sf):
    return iforest.score_histogram(_flagged(spark, sf), 40)


@query("given_confusion", with_flows("""SELECT CAST(action = 'Deny' AS INTEGER) AS label, CAST(dest_port < 1024 AS INTEGER) AS prediction,
 count(*) AS n FROM flows GROUP BY 1, 2"""))
def q_given_confusion(spark, sf):
    feats = classify.classifier_features(flows(spark, sf))
    return classify.confusion(feats.withColumn("prediction", (F.col("dest_port") < 1024).cast("double")))


@query("given_models_by_fold", with_flows("""SELECT model, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std,
 round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std FROM (
 SELECT model, fold, sum(right_n) / CAST(sum(n) AS DOUBLE) AS acc,
  sum(fp * (2.0 * ctp - tp)) / (2.0 * nullif(CAST(sum(tp) AS DOUBLE) * sum(fp), 0)) AS auc FROM (
  SELECT *, sum(tp) OVER (PARTITION BY model, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp FROM per)
 GROUP BY model, fold) GROUP BY model""", extra="""s AS (SELECT flow_id, y, fold,
  unnest(['port', 'hour']) AS model, unnest([dest_port / 65535.0, hour(date) / 23.0]) AS score
  FROM (SELECT *, action = 'Deny' AS y, (row_number() OVER (PARTITION BY action = 'Deny'
    ORDER BY md5(CAST(flow_id AS VARCHAR) || '|42'), flow_id) - 1) % 5 AS fold FROM flows)),
per AS (SELECT model, fold, score, count(*) FILTER (WHERE y) AS tp, count(*) FILTER (WHERE NOT y) AS fp, count(*) AS n,
  count(*) FILTER (WHERE y = (score > 0.5)) AS right_n FROM s GROUP BY 1, 2, 3)"""))
def q_given_models_by_fold(spark, sf):
    """Cross-validation figures of two given scores (port, hour) over the five folds."""
    feats = folds(classify.classifier_features(flows(spark, sf)), "flow_id", 5, 42)
    rows = []
    for name, score in (("port", F.col("dest_port") / F.lit(65535.0)), ("hour", F.col("hour") / F.lit(23.0))):
        for f in range(5):
            part = feats.where(F.col("fold") == f).withColumn("p1", score)
            acc = part.agg(F.avg((F.col("label") == (F.col("p1") > 0.5).cast("int")).cast("double"))).first()[0]
            rows.append((name, f, acc, classify.auc_from_points(classify.roc_points(part)).first()[0]))
    return classify.fold_summary(spark.createDataFrame(rows, "model string, fold int, accuracy double, auc double"))


# Given rules over (port, TCP, port bucket, hour), as the rule tree states them.
_RULES = [
    {"rule_id": 0, "conds": [(0, "<=", 22.5), (1, "<=", 0.5)], "prediction": 1.0},
    {"rule_id": 1, "conds": [(0, "<=", 22.5), (1, ">", 0.5), (3, "<=", 11.5)], "prediction": 0.0},
    {"rule_id": 2, "conds": [(0, "<=", 22.5), (1, ">", 0.5), (3, ">", 11.5)], "prediction": 1.0},
    {"rule_id": 3, "conds": [(0, ">", 22.5), (2, "<=", 0.5)], "prediction": 0.0},
    {"rule_id": 4, "conds": [(0, ">", 22.5), (2, ">", 0.5)], "prediction": 1.0},
]
_RULES = [r | {"text": " AND ".join(f"{classify.CART_FEATURE_NAMES[f]} {op} {v:.2f}" for f, op, v in r["conds"])} for r in _RULES]
_SQL_COLS = ("dest_port", "CAST(protocol = 'TCP' AS INTEGER)", "CASE WHEN dest_port <= 1023 THEN 0 WHEN dest_port <= 49151 THEN 1 ELSE 2 END",
             "hour(date)")
_LEAF = "CASE " + " ".join("WHEN " + " AND ".join(f"{_SQL_COLS[f]} {op} {v}" for f, op, v in r["conds"]) + f" THEN {r['rule_id']}"
                           for r in _RULES) + " END"


@query("given_rule_table", with_flows("SELECT r.rule_id, r.rule, r.prediction, coalesce(x.n, 0) AS n,"
       " round(x.nd / CAST(nullif(x.n, 0) AS DOUBLE), 6) AS deny_share FROM (VALUES "
       + ", ".join(f"({r['rule_id']}, '{r['text']}', CAST({r['prediction']} AS DOUBLE))" for r in _RULES)
       + f""") AS r(rule_id, rule, prediction) LEFT JOIN (SELECT {_LEAF} AS rule_id, count(*) AS n,
 count(*) FILTER (WHERE action = 'Deny') AS nd FROM flows GROUP BY 1) x ON r.rule_id = x.rule_id"""))
def q_given_rule_table(spark, sf):
    """Leaf support and deny share of a given rule tree."""
    return classify.rule_stats(classify.classifier_features(flows(spark, sf)), _RULES)


@query("given_rules_apply", with_flows(f"""SELECT CASE WHEN leaf IN (0, 2, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rule_prediction, label,
 count(*) AS n FROM (SELECT {_LEAF} AS leaf, CAST(action = 'Deny' AS INTEGER) AS label FROM flows) GROUP BY 1, 2"""))
def q_given_rules_apply(spark, sf):
    """A given rule tree applied as predicates."""
    feats = classify.classifier_features(flows(spark, sf))
    return feats.withColumn("rule_prediction", classify.apply_rules(feats, _RULES)).groupBy("rule_prediction", "label").agg(
        F.count(F.lit(1)).alias("n"))


_LOADINGS = {1: (0.6, 0.5, 0.3, 0.5), 2: (-0.4, 0.3, 0.8, -0.3)}
_CENTRES = [[0.0, 0.0, 0.0, 0.0], [1.5, 1.5, 0.0, 0.5], [-1.0, -0.5, 0.5, -1.0], [0.0, 1.0, 3.0, 1.0]]
_Z = PROFILES_CTE + ",\n" + scaled_cte(LOF_FEATURES, "z")


def _zed(spark, sf):
    return standardize(ip_profiles(flows(spark, sf)), LOF_FEATURES)


@query("given_loadings_scores", with_flows("SELECT ip_source, " + ", ".join(
    "round(" + " + ".join(f"{c}_z * {w}" for c, w in zip(LOF_FEATURES, ws, strict=True)) + f", 6) AS pc{j}" for j, ws in _LOADINGS.items())
    + " FROM z", extra=_Z))
def q_given_loadings_scores(spark, sf):
    """Principal-component scores under given loadings."""
    loadings = spark.createDataFrame([(c, j, w) for j, ws in _LOADINGS.items() for c, w in zip(LOF_FEATURES, ws, strict=True)],
                                     "feature string, component int, loading double")
    return clusters.project(_zed(spark, sf), LOF_FEATURES, loadings, 2).select(
        "ip_source", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


_FAR = [" + ".join(f"({c}_z - {x}) * ({c}_z - {x})" for c, x in zip(LOF_FEATURES, m, strict=True)) for m in _CENTRES]
_NEAREST = f"CAST(list_position([{', '.join(_FAR)}], list_min([{', '.join(_FAR)}])) - 1 AS INTEGER)"


@query("given_centres_profiles", with_flows(f"""SELECT cluster, count(*) AS n, {', '.join(f'round(avg({c}), 3) AS {c}' for c in LOF_FEATURES)}
 FROM (SELECT p.*, a.cluster FROM prof p JOIN (SELECT ip_source, {_NEAREST} AS cluster FROM z) a ON p.ip_source = a.ip_source)
 GROUP BY cluster""", extra=_Z))
def q_given_centres_profiles(spark, sf):
    """Cluster sizes and mean profiles for given centres."""
    z = _zed(spark, sf)
    return clusters.cluster_profiles(z, clusters.assign_to(z, LOF_FEATURES, _CENTRES), LOF_FEATURES)


@query("given_centres_assign", with_flows(f"SELECT ip_source, {_NEAREST} AS cluster FROM z", extra=_Z))
def q_given_centres_assign(spark, sf):
    return clusters.assign_to(_zed(spark, sf), LOF_FEATURES, _CENTRES)
