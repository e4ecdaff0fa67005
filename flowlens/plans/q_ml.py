"""Profiles, scaling, anomaly detection, clustering and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import lof as L
from flowlens.operators.profiles import IFOREST_FEATURES, LOF_FEATURES, ip_profiles, standardize
from flowlens.plans.registry import query
from flowlens.plans.sqlbase import PROFILES_CTE, lof_ctes, principal_ctes, scaled_cte, with_flows
from flowlens.sources.tables import flows

_R6 = ("duration_min", "mean_port", "tcp_ratio", "rate_per_min", "deny_ratio")


@query("ip_profiles", with_flows("SELECT ip_source, n_distinct_ports, n_denies, n_connections, max_port, "
                                 + ", ".join(f"round({c}, 6) AS {c}" for c in _R6) + " FROM prof",
                                 extra=PROFILES_CTE), headline=True)
def q_ip_profiles(spark, sf):
    p = ip_profiles(flows(spark, sf))
    return p.withColumns({c: F.round(c, 6) for c in _R6})


@query("scaled_profiles", with_flows("SELECT ip_source, " + ", ".join(f"round({c}_z, 6) AS {c}_z" for c in IFOREST_FEATURES)
                                     + " FROM z", extra=PROFILES_CTE + ",\n" + scaled_cte(IFOREST_FEATURES, "z")))
def q_scaled_profiles(spark, sf):
    z = standardize(ip_profiles(flows(spark, sf)), IFOREST_FEATURES)
    return z.select("ip_source", *[F.round(c + "_z", 6).alias(c + "_z") for c in IFOREST_FEATURES])


@query("lof_scores", with_flows("SELECT ip_source, round(lof, 6) AS lof, is_outlier FROM lof_flag",
                                extra=lof_ctes(LOF_FEATURES)), headline=True)
def q_lof_scores(spark, sf):
    return L.lof_for_flows(flows(spark, sf)).withColumn("lof", F.round("lof", 6))


@query("lof_summary", with_flows("""SELECT count(*) AS n, round(max(lof), 6) AS max_lof,
 round(quantile_cont(lof, 0.5), 6) AS median_lof, round(quantile_cont(lof, 0.95), 6) AS p95_lof,
 count(*) FILTER (WHERE is_outlier) AS n_outliers FROM lof_flag""", extra=lof_ctes(LOF_FEATURES)))
def q_lof_summary(spark, sf):
    return L.lof_summary(L.lof_for_flows(flows(spark, sf)))


# ---------------------------------------------------------------- isolation forest

def _iforest(spark, sf, trees=100, contamination=0.05):
    from flowlens.operators.iforest import isolation_forest
    z = standardize(ip_profiles(flows(spark, sf)), IFOREST_FEATURES)
    return isolation_forest(z, [c + "_z" for c in IFOREST_FEATURES], "ip_source", trees, contamination, 42)


@query("isolation_forest")
def q_isolation_forest(spark, sf):
    return _iforest(spark, sf).withColumn("score", F.round("score", 6))


@query("anomaly_summary")
def q_anomaly_summary(spark, sf):
    from flowlens.operators.iforest import anomaly_summary
    return anomaly_summary(_iforest(spark, sf))


@query("top_anomalies")
def q_top_anomalies(spark, sf):
    return _iforest(spark, sf).orderBy("score", "ip_source").limit(15)


@query("score_histogram")
def q_score_histogram(spark, sf):
    from flowlens.operators.iforest import score_histogram
    return score_histogram(_iforest(spark, sf), 40)


# ---------------------------------------------------------------- PCA and K-Means

_KM_FEATURES = LOF_FEATURES


def _pca(spark, sf):
    from flowlens.operators.clusters import pca
    return pca(ip_profiles(flows(spark, sf)), IFOREST_FEATURES, 4)


def _pca_sql(select: str) -> str:
    """The same components found in SQL by repeated squaring of the covariance matrix."""
    ctes = ",\n".join([PROFILES_CTE, scaled_cte(IFOREST_FEATURES, "z"), principal_ctes(IFOREST_FEATURES, 4)])
    return with_flows(select, extra=ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_PROJECTED = ", ".join("round(" + " + ".join(f"z.{c}_z * p{j}.v[{i}]" for i, c in enumerate(IFOREST_FEATURES, 1)) + f", 6) AS pc{j}"
                       for j in range(1, 5))


@query("pca_scores", _pca_sql(f"SELECT z.ip_source, {_PROJECTED} FROM z "
                              + " ".join(f"JOIN pcs p{j} ON p{j}.component = {j}" for j in range(1, 5))))
def q_pca_scores(spark, sf):
    return _pca(spark, sf)[0].select("ip_source", *[F.round(f"pc{j}", 6).alias(f"pc{j}") for j in range(1, 5)])


@query("pca_variance", _pca_sql("""SELECT component, round(ratio, 6) AS explained_ratio,
 round(sum(ratio) OVER (ORDER BY component), 6) AS cumulative FROM pcs"""))
def q_pca_variance(spark, sf):
    return _pca(spark, sf)[1].select("component", *[F.round(c, 6).alias(c) for c in ("explained_ratio", "cumulative")])


@query("pca_loadings", _pca_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, component, round(v[{i}], 6) AS loading FROM pcs" for i, c in enumerate(IFOREST_FEATURES, 1))))
def q_pca_loadings(spark, sf):
    return _pca(spark, sf)[2].withColumn("loading", F.round("loading", 6))


@query("kmeans_scan")
def q_kmeans_scan(spark, sf):
    from flowlens.operators.clusters import kmeans_scan
    return kmeans_scan(ip_profiles(flows(spark, sf)), _KM_FEATURES, 8, 10)[0]


def _kmeans(spark, sf):
    # The scan already holds the best of the 10 starts for every k, so the chosen k's centres are reused.
    from flowlens.operators.clusters import assigned, kmeans_fit_scan
    prof = ip_profiles(flows(spark, sf))
    _, k, models, vec = kmeans_fit_scan(prof, _KM_FEATURES, 8, 10)
    return prof, assigned(vec, models[k], "ip_source")


@query("kmeans_assign")
def q_kmeans_assign(spark, sf):
    return _kmeans(spark, sf)[1]


@query("cluster_profiles")
def q_cluster_profiles(spark, sf):
    from flowlens.operators.clusters import cluster_profiles
    prof, assign = _kmeans(spark, sf)
    return cluster_profiles(prof, assign, _KM_FEATURES)


@query("kmeans_projection")
def q_kmeans_projection(spark, sf):
    from flowlens.operators.clusters import cluster_projection
    prof, assign = _kmeans(spark, sf)
    return cluster_projection(prof, assign, _KM_FEATURES)


# ---------------------------------------------------------------- supervised models

@query("classifier_features", with_flows("""SELECT flow_id, dest_port, CAST(protocol = 'TCP' AS INTEGER) AS is_tcp,
 CAST(CASE WHEN dest_port IS NULL THEN NULL WHEN dest_port <= 1023 THEN 0 WHEN dest_port <= 49151 THEN 1 ELSE 2 END AS INTEGER)
 AS port_bucket, CAST(hour(date) AS INTEGER) AS hour, CAST(isodow(date) - 1 AS INTEGER) AS weekday,
 CAST(action = 'Deny' AS INTEGER) AS label FROM flows"""))
def q_classifier_features(spark, sf):
    from flowlens.operators.classify import classifier_features
    return classifier_features(flows(spark, sf))


def _feats(spark, sf):
    from flowlens.operators.classify import classifier_features
    return classifier_features(flows(spark, sf))


@query("model_comparison")
def q_model_comparison(spark, sf):
    from flowlens.operators.classify import compare_models
    return compare_models(_feats(spark, sf))


@query("model_roc")
def q_model_roc(spark, sf):
    from flowlens.operators.classify import model_roc
    return model_roc(_feats(spark, sf))


@query("roc_curve", with_flows("""SELECT round(score, 9) AS score, round(ctp / P, 9) AS tpr, round(cfp / N, 9) AS fpr,
 round((SELECT sum((fp / N) * ((2.0 * ctp - tp) / (2.0 * P))) FROM cum, tot), 9) AS auc FROM cum, tot""",
    extra="""per AS (SELECT CAST(dest_port AS DOUBLE) / 65535.0 AS score,
 count(*) FILTER (WHERE action = 'Deny') AS tp, count(*) FILTER (WHERE action <> 'Deny') AS fp FROM flows GROUP BY 1),
cum AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
 sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM per),
tot AS (SELECT sum(tp) AS P, sum(fp) AS N FROM per)"""))
def q_roc_curve(spark, sf):
    from flowlens.operators.classify import auc_from_points, roc_points
    fl = flows(spark, sf)
    scored = fl.select((F.col("dest_port").cast("double") / F.lit(65535.0)).alias("p1"),
                       (F.col("action") == "Deny").cast("int").alias("label"))
    pts = roc_points(scored)
    auc = auc_from_points(pts).scalar()
    return pts.select(F.round("score", 9).alias("score"), F.round("tpr", 9).alias("tpr"),
                      F.round("fpr", 9).alias("fpr"), F.round(auc, 9).alias("auc"))


@query("roc_curve_reduced", with_flows("""SELECT round(score, 9) AS score, round(ctp / P, 9) AS tpr, round(cfp / N, 9) AS fpr FROM
 (SELECT *, lead(tp) OVER w AS ntp, lead(fp) OVER w AS nfp, row_number() OVER w AS r FROM cum WINDOW w AS (ORDER BY score DESC)), tot
WHERE r = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp""", extra="""per AS (SELECT CAST(dest_port AS DOUBLE) / 65535.0 AS score,
 count(*) FILTER (WHERE action = 'Deny') AS tp, count(*) FILTER (WHERE action <> 'Deny') AS fp FROM flows GROUP BY 1),
cum AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
 sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM per),
tot AS (SELECT sum(tp) AS P, sum(fp) AS N FROM per)"""))
def q_roc_curve_reduced(spark, sf):
    from flowlens.operators.classify import drop_intermediate, roc_points
    scored = flows(spark, sf).select((F.col("dest_port").cast("double") / F.lit(65535.0)).alias("p1"),
                                     (F.col("action") == "Deny").cast("int").alias("label"))
    return drop_intermediate(roc_points(scored)).select(*[F.round(c, 9).alias(c) for c in ("score", "tpr", "fpr")])


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    from flowlens.operators.classify import cart, confusion
    model, vec = cart(_feats(spark, sf))
    return confusion(model.transform(vec))


@query("cart_rules")
def q_cart_rules(spark, sf):
    from flowlens.operators.classify import cart_rules
    return cart_rules(_feats(spark, sf))


@query("cart_summary")
def q_cart_summary(spark, sf):
    from flowlens.operators.classify import cart_summary
    return cart_summary(_feats(spark, sf))


@query("cart_importance")
def q_cart_importance(spark, sf):
    from flowlens.operators.classify import cart_importance
    return cart_importance(_feats(spark, sf))


@query("cart_rules_apply")
def q_cart_rules_apply(spark, sf):
    from flowlens.operators.classify import cart_rules_apply
    return cart_rules_apply(_feats(spark, sf))


@query("lof_rank_curve", with_flows("""SELECT CAST(row_number() OVER (ORDER BY lof DESC, ip_source) AS INTEGER) AS rank,
 ip_source, round(lof, 6) AS lof FROM (SELECT * FROM lof_flag ORDER BY lof DESC, ip_source LIMIT 100)""",
                                    extra=lof_ctes(LOF_FEATURES)))
def q_lof_rank_curve(spark, sf):
    from pyspark.sql import Window
    top = L.lof_for_flows(flows(spark, sf)).orderBy(F.col("lof").desc(), "ip_source").limit(100)
    # rank within the 100-row slice (bounded), the head of the sorted-score curve
    w = Window.orderBy(F.col("lof").desc(), "ip_source")
    return top.select(F.row_number().over(w).alias("rank"), "ip_source", F.round("lof", 6).alias("lof"))
