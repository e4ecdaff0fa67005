"""Local Outlier Factor over per-IP profiles (E5, G4, G6, J4), without an all-pairs join.

Identical feature vectors are one row with a multiplicity, so a hot group of identical profiles (say a third of all sources) never
produces pairs; the k nearest neighbours of the distinct vectors come from ``nearest.knn`` and are exact.

Distances are rounded to 9 decimals before ranking (ties then break on the neighbour key), which keeps Spark and a SQL engine in
agreement. LOF follows the usual definition: k-distance, reach-distance max(k-dist(o), d(p, o)), lrd = 1 / (mean reach + 1e-10),
LOF = mean lrd(o) / lrd(p); outliers are those above the (1 - contamination) quantile of LOF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import nearest
from flowlens.operators.profiles import LOF_FEATURES, ip_profiles, standardize
from flowlens.operators.topk import linear_quantiles
from flowlens.session import materialize

_DIGITS = 9


def scaled_features(profiles: DataFrame, cols=LOF_FEATURES, key: str = "ip_source") -> DataFrame:
    """Standardised (population std) features rounded to 9 decimals: ``key, z0..z{d-1}``."""
    z = standardize(profiles, cols)
    return z.select(key, *[F.round(F.col(c + "_z"), _DIGITS).alias(f"z{i}") for i, c in enumerate(cols)])


def knn(points: DataFrame, k: int, key: str = "ip_source", cell: int = nearest.CELL,
        stats: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact multiplicity-aware k-NN over distinct vectors.

    Returns ``(vectors, neighbours)``: vectors ``vid, z*, mult, tie`` and neighbour rows
    ``vid, nid, dist, take`` (``take`` copies of neighbour vector ``nid``; takes sum to k).
    """
    zc = [c for c in points.columns if c.startswith("z") and c[1:].isdigit()]
    vec = (points.groupBy(*zc).agg(F.count(F.lit(1)).alias("mult"), F.min(key).alias("tie"))
           .withColumn("vid", F.xxhash64(*zc)))
    vec = materialize(vec, "lof-vectors")  # cut lineage: reused by every round
    rows, n = vec.agg(F.count(F.lit(1)), F.sum("mult")).first()
    k = min(k, max((n or 0) - 1, 0))
    if k == 0:
        return vec, points.sparkSession.createDataFrame([], "vid long, nid long, dist double, take long")
    return vec, nearest.knn(vec, zc, rows, k, cell, stats)


def lof(profiles: DataFrame, cols=LOF_FEATURES, k: int = 20, contamination: float = 0.05,
        key: str = "ip_source") -> DataFrame:
    """LOF score and outlier flag per key: ``key, lof, is_outlier``."""
    pts = materialize(scaled_features(profiles, cols, key), "lof-points")
    vec, nb = knn(pts, k, key)
    nb = materialize(nb, "lof-neighbours")  # read three times below
    kd = nb.groupBy("vid").agg(F.max("dist").alias("kdist"))
    # reach distance uses the neighbour's k-distance
    r = (nb.join(kd.select(F.col("vid").alias("nid"), F.col("kdist").alias("nkd")), "nid")
         .groupBy("vid").agg((F.sum(F.greatest("nkd", "dist") * F.col("take")) / F.sum("take")).alias("mreach")))
    lrd = r.select("vid", (F.lit(1.0) / (F.col("mreach") + F.lit(1e-10))).alias("lrd"))
    ratio = (nb.join(lrd.select(F.col("vid").alias("nid"), F.col("lrd").alias("nlrd")), "nid")
             .groupBy("vid").agg((F.sum(F.col("nlrd") * F.col("take")) / F.sum("take")).alias("mlrd"))
             .join(lrd, "vid").select("vid", (F.col("mlrd") / F.col("lrd")).alias("lof")))
    zc = [c for c in pts.columns if c.startswith("z")]
    per_key = pts.withColumn("vid", F.xxhash64(*zc)).join(ratio, "vid").select(key, "lof")
    per_key = materialize(per_key, "lof-scores")  # read for the cut-off and by the caller
    cut = F.lit(linear_quantiles(per_key, "lof", [1.0 - contamination])[0]).cast("double")
    return per_key.withColumn("is_outlier", F.col("lof") > cut)


def lof_summary(scores: DataFrame) -> DataFrame:
    """Rank-curve figures: count, max, median, p95 (linear) and number of outliers."""
    median, p95 = (F.lit(x).cast("double") for x in linear_quantiles(scores, "lof", [0.5, 0.95]))
    return scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("lof"), 6).alias("max_lof"),
                      F.round(median, 6).alias("median_lof"), F.round(p95, 6).alias("p95_lof"),
                      F.count_if("is_outlier").alias("n_outliers"))


def lof_for_flows(flows: DataFrame, k: int = 20, contamination: float = 0.05) -> DataFrame:
    return lof(ip_profiles(flows), LOF_FEATURES, k, contamination)
