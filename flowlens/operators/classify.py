"""Supervised models on flow lines (J7-J14, G5, F24, F25): features, folds, CV, ROC, CART rules."""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalar import port_bucket
from flowlens.operators.counted_fits import logistic_fits, logistic_scores, tree_scores
from flowlens.operators.profiles import standardize
from flowlens.operators.retrieval import folds, split_label
from flowlens.session import materialize

#: Port and port bucket of a flow without a port (the parser yields null for an empty field).
NO_PORT = -1
CLF_FEATURES = ("dest_port", "is_tcp", "port_bucket", "hour", "weekday")
CART_FEATURES = ("dest_port", "is_tcp", "port_bucket", "hour")
# Readable names of the rule-tree features.
CART_FEATURE_NAMES = ("Port de destination", "Protocole TCP", "Tranche de port", "Heure")


def classifier_features(df: DataFrame) -> DataFrame:
    """``flow_id, dest_port, is_tcp, port_bucket, hour, weekday, label`` (label = is_deny)."""
    return df.select("flow_id", F.coalesce("dest_port", F.lit(NO_PORT)).alias("dest_port"), (F.col("protocol") == "TCP").cast("int").alias("is_tcp"),
                     F.coalesce(port_bucket("dest_port"), F.lit(NO_PORT)).alias("port_bucket"), F.hour("date").alias("hour"),
                     F.weekday("date").alias("weekday"), (F.col("action") == "Deny").cast("int").alias("label"))


def models(n_train: int) -> dict:
    """The four compared models with the reference's settings mapped to MLlib's objective."""
    lam = lambda c: 1.0 / (c * max(n_train, 1))  # noqa: E731  C * sum(loss) + penalty  ==  mean(loss) + penalty/(C n)
    common = dict(featuresCol="features", labelCol="label")
    return {
        "logistic_l1": LogisticRegression(regParam=lam(0.1), elasticNetParam=1.0, standardization=False,
                                          maxIter=1000, **common),
        "logistic_l2": LogisticRegression(regParam=lam(1.0), elasticNetParam=0.0, standardization=False,
                                          maxIter=1000, **common),
        "cart": DecisionTreeClassifier(maxDepth=4, seed=42, maxBins=64, **common),
        "random_forest": RandomForestClassifier(numTrees=100, maxDepth=5, seed=42, maxBins=64, **common),
    }


def _vectors(feats: DataFrame, cols=CLF_FEATURES, scaled: bool = True) -> DataFrame:
    z = standardize(feats, cols) if scaled else feats
    src = [c + "_z" for c in cols] if scaled else list(cols)
    return VectorAssembler(inputCols=src, outputCol="features").transform(z)


def _p1(pred: DataFrame) -> DataFrame:
    return pred.withColumn("p1", vector_to_array("probability")[1])


def roc(scored: DataFrame, score: str = "p1", label: str = "label"):
    """``(points, auc)`` for a scored table."""
    pts = roc_points(scored, score, label)
    return pts, auc_from_points(pts)


def roc_points(scored: DataFrame, score: str = "p1", label: str = "label", parts: int | None = None,
               weight: str | None = None, by=()) -> DataFrame:
    """ROC points (one per distinct score, descending) with cumulative TP/FP rates. ``weight`` names the column that says how
    many rows a row stands for; ``by`` names columns whose values have a curve each.

    Exact distributed prefix sums: counts per distinct score, range-partitioned by score; each
    partition's totals (one row per partition) give its offset, and a window within each
    partition does the rest — no single-partition window over all scores.
    """
    rows = F.col(weight) if weight else F.lit(1)
    of = lambda c: F.coalesce(F.sum(F.when(c, rows)), F.lit(0)).cast("long")
    per = scored.groupBy(*by, F.col(score).alias("score")).agg(of(F.col(label) == 1).alias("tp"), of(F.col(label) != 1).alias("fp"))
    # Partition ids must be the same in every subtree below, so the partitioned table is
    # materialised once (a written table) instead of re-running the range shuffle per use.
    parts = parts or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = materialize(per.repartitionByRange(parts, *by, F.col("score").desc()).withColumn("pid", F.spark_partition_id()),
                      "roc-per-score")
    tot = per.groupBy(*by, "pid").agg(F.sum("tp").alias("ptp"), F.sum("fp").alias("pfp"))
    curve = Window.partitionBy(*by)
    wo = curve.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "pid", F.coalesce(F.sum("ptp").over(wo), F.lit(0)).alias("otp"),
                     F.coalesce(F.sum("pfp").over(wo), F.lit(0)).alias("ofp"),  # one row per curve and partition
                     F.sum("ptp").over(curve).alias("P"), F.sum("pfp").over(curve).alias("N"))
    by_score = Window.partitionBy(*by, "pid").orderBy(F.col("score").desc())
    wi = by_score.rowsBetween(Window.unboundedPreceding, 0)
    # the point after a partition's last one is the first of the next partition: one row per partition is exchanged
    heads = per.groupBy(*by, "pid").agg(F.max_by(F.struct("tp", "fp"), "score").alias("head"))
    heads = heads.select(*by, "pid", F.lead("head").over(curve.orderBy("pid")).alias("after"))
    cum = (per.join(F.broadcast(off.join(heads, [*by, "pid"])), [*by, "pid"])
           .withColumn("ctp", F.sum("tp").over(wi) + F.col("otp"))
           .withColumn("cfp", F.sum("fp").over(wi) + F.col("ofp"))
           .withColumn("next", F.coalesce(F.lead(F.struct("tp", "fp")).over(by_score), F.col("after"))))
    # on a straight line: the step to the next point equals the step to this one; both ends of the curve are corners
    corner = (F.col("next").isNull() | (F.col("next.tp") != F.col("tp")) | (F.col("next.fp") != F.col("fp"))
              | ((F.col("ctp") == F.col("tp")) & (F.col("cfp") == F.col("fp"))))
    return cum.select(*by, "score", "tp", "fp", (F.col("ctp") / F.nullif(F.col("P").cast("double"), F.lit(0.0))).alias("tpr"),
                      (F.col("cfp") / F.nullif(F.col("N").cast("double"), F.lit(0.0))).alias("fpr"), "ctp", "cfp", corner.alias("corner"))


def drop_intermediate(points: DataFrame) -> DataFrame:
    """The points of ``roc_points`` without those that continue the step before them in a straight line; the area is the same."""
    return points.where("corner")


def auc_from_points(points: DataFrame, by=()) -> DataFrame:
    """Trapezoid AUC (of every curve ``by``): sum of dFPR * (TPR + TPR_prev) / 2, with the previous point from cum - own.

    One aggregate: sum(fp * (2 ctp - tp)) / (2 P N).
    """
    agg = points.groupBy(*by).agg(F.sum("tp").cast("double").alias("P"), F.sum("fp").cast("double").alias("N"),
                                  F.sum(F.col("fp").cast("double") * (F.lit(2.0) * F.col("ctp") - F.col("tp"))).alias("S"))
    return agg.select(*by, (F.col("S") / (F.lit(2.0) * F.nullif(F.col("P") * F.col("N"), F.lit(0.0)))).alias("auc"))


def _parallel(tasks, workers: int = 8):
    """Run independent fits concurrently (each is its own Spark job; the cluster shares them)."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=workers) as ex:
        return list(ex.map(lambda t: t(), tasks))


def require_two_classes(feats: DataFrame, label: str = "label") -> None:
    """Guard: supervised models need both classes (raises ValueError otherwise)."""
    if feats.select(label).distinct().limit(2).count() < 2:
        raise ValueError("the target has fewer than two classes; no model can be trained")


def scored_counts(model, cells: DataFrame) -> DataFrame:
    """``p1, prediction, label, n`` of a model on rows that stand for ``n`` each."""
    return counted_scores(_p1(model.transform(cells)))


def counted_scores(pred: DataFrame, by=()) -> DataFrame:
    """``p1, prediction, label, n`` (after ``by``) of scored rows that stand for ``n`` each."""
    return pred.groupBy(*by, "p1", "prediction", "label").agg(F.sum("n").alias("n"))


def accuracies(counts: DataFrame, by=()) -> DataFrame:
    """Share of right predictions among the labelled rows of ``scored_counts``, for every ``by``."""
    right = F.coalesce(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n"))), F.lit(0))
    labelled = F.sum(F.when(F.col("label").isNotNull(), F.col("n")))
    return counts.groupBy(*by).agg((right.cast("double") / labelled).alias("accuracy"))


def accuracy(counts: DataFrame) -> float | None:
    return accuracies(counts).first()[0]


def fold_cells(feats: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold, <feature>_z..., label, n``: the distinct rows of the stratified folds, standardised, with their counts."""
    z = [c + "_z" for c in CLF_FEATURES]
    data = folds(standardize(feats, CLF_FEATURES).select("flow_id", *z, "label"), "flow_id", k, seed)
    cells = materialize(data.groupBy("fold", *z, "label").agg(F.count(F.lit(1)).alias("n")), "cv-cells")
    known = F.col("label").isin(0, 1) & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in z])
    if not cells.where(~F.coalesce(known, F.lit(False))).isEmpty():
        raise ValueError("a feature is null, or a label is not 0 or 1; no model can be trained")
    return cells.withColumn("label", F.col("label").cast("int"))


def compare_models(feats: DataFrame, k: int = 5, seed: int = 42, parallelism: int = 8) -> DataFrame:
    """k-fold CV (folds stratified by label) of the four models: mean/std of accuracy and AUC.

    One fit per (model, fold) gives both metrics. Fits and scores work on distinct feature vectors with their counts
    (``counted_fits``): the logistic fits of all folds move together, a scan of the vectors for a step; trees see binned vectors only.
    """
    require_two_classes(feats)
    z = [c + "_z" for c in CLF_FEATURES]
    cells = fold_cells(feats, k, seed)
    sizes = np.zeros((k, 2), dtype=int)
    for r in cells.groupBy("fold", "label").agg(F.sum("n").alias("n")).collect():
        sizes[r["fold"], r["label"]] = r["n"]
    train = sizes.sum(0) - sizes
    if not train.sum(1).all():
        raise ValueError("a fold holds all rows; no model can be trained")

    ests = [models(int(n)) for n in train.sum(1)]
    linear = [(name, f) for name, e in ests[0].items() if isinstance(e, LogisticRegression) for f in range(k)]
    trees = {name: _tree_settings(e, len(z)) for name, e in ests[0].items() if not isinstance(e, LogisticRegression)}
    theta, grown = _parallel([
        lambda: logistic_fits(cells, z, [_penalties(ests[f][name]) | {"out": f, "rows": train[f].tolist()} for name, f in linear]),
        lambda: tree_scores(cells, z, k, ests[0]["cart"].getMaxBins(), trees)], parallelism)

    each = ["model", "fold"]
    scores = logistic_scores(cells, z, dict(zip(linear, theta, strict=True))).unionByName(grown)
    scores = materialize(counted_scores(scores, each), "cv-scored")
    acc = {(r["model"], r["fold"]): r["accuracy"] for r in accuracies(scores, each).collect()}
    auc = {(r["model"], r["fold"]): r["auc"] for r in auc_from_points(roc_points(scores, weight="n", by=each), each).collect()}
    # a fold with one class has no AUC, one without rows no figure; they stay null
    rows = [(name, f, acc.get((name, f)), auc.get((name, f))) for f in range(k) for name in ests[0]]
    return fold_summary(feats.sparkSession.createDataFrame(rows, "model string, fold int, accuracy double, auc double"))


def _penalties(est: LogisticRegression) -> dict:
    lam, mix = est.getRegParam(), est.getElasticNetParam()
    return {"l1": lam * mix, "l2": lam * (1.0 - mix), "max_iter": est.getMaxIter()}


def _tree_settings(est, width: int) -> dict:
    """Settings of ``counted_fits.tree_scores``; a forest's nodes choose among the square root of the features, as in MLlib."""
    forest = isinstance(est, RandomForestClassifier)
    return {"trees": est.getNumTrees() if forest else 1, "depth": est.getMaxDepth(), "seed": est.getSeed(), "bootstrap": forest,
            "features": math.ceil(math.sqrt(width)) if forest else width}


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population std of ``accuracy`` and ``auc`` over each model's folds (nulls left out), best mean AUC first."""
    return (per_fold.groupBy("model").agg(F.round(F.avg("accuracy"), 6).alias("acc_mean"),
                                          F.round(F.stddev_pop("accuracy"), 6).alias("acc_std"),
                                          F.round(F.avg("auc"), 6).alias("auc_mean"),
                                          F.round(F.stddev_pop("auc"), 6).alias("auc_std"))
            .orderBy(F.desc_nulls_last("auc_mean"), "model"))


def model_roc(feats: DataFrame, seed: int = 42) -> DataFrame:
    """Per model: the corners of the ROC curve on the 30% hold-out after fitting on the 70% split, and its area."""
    require_two_classes(feats)
    data = materialize(split_label(_vectors(feats), "flow_id", 70, seed).select("features", "label", "split"),
                       "roc-input")
    train, test = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")
    n_train = train.count()

    def task(name, est):
        def run():
            pts = materialize(roc_points(_p1(est.fit(train).transform(test))), "roc-points")
            auc = auc_from_points(pts).first()[0]
            return drop_intermediate(pts).select(F.lit(name).alias("model"), "score", "fpr", "tpr", F.lit(auc).cast("double").alias("auc"))
        return run

    parts = _parallel([task(n, e) for n, e in models(n_train).items()])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------------------ CART rules

_IF = re.compile(r"^(\s*)If \(feature (\d+) (<=|>|in|not in) (.+)\)$")
_ELSE = re.compile(r"^(\s*)Else \(feature (\d+) (<=|>|in|not in) (.+)\)$")
_PRED = re.compile(r"^(\s*)Predict: ([\d.]+)$")


def tree_rules(model, names=CART_FEATURE_NAMES, cols=CART_FEATURES) -> list[dict]:
    """Root-to-leaf paths of a fitted tree (from its debug text; at most 2^depth leaves)."""
    rules, path = [], []
    for line in model.toDebugString.splitlines()[1:]:
        m = _IF.match(line) or _ELSE.match(line)
        if m:
            depth = (len(m.group(1)) - 2) // 1
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, int(m.group(2)), m.group(3), m.group(4)))
            continue
        p = _PRED.match(line)
        if p:
            conds = [(f, op, v) for _, f, op, v in path]
            rules.append({"conds": conds, "prediction": float(p.group(2))})
    for i, r in enumerate(rules):
        r["rule_id"] = i
        r["text"] = " AND ".join(f"{names[f]} {op} {float(v):.2f}" for f, op, v in r["conds"]) or "TRUE"
    return rules


def rule_predicate(conds, cols=CART_FEATURES) -> Column:
    c = F.lit(True)
    for f, op, v in conds:
        col = F.col(cols[f]).cast("double")
        c = c & ((col <= float(v)) if op == "<=" else (col > float(v)))
    return c


def cart(feats: DataFrame, depth: int = 4, min_leaf: int = 20, seed: int = 42):
    """Fit the rule tree on raw features; returns ``(model, vectors)``."""
    vec = materialize(_vectors(feats, CART_FEATURES, scaled=False), "cart-input")
    est = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, maxBins=64,
                                 featuresCol="features", labelCol="label")
    return est.fit(vec), vec


def cart_rules(feats: DataFrame, depth: int = 4, min_leaf: int = 20) -> DataFrame:
    """One row per leaf: rule text, predicted class, support and deny share (one pass of count_ifs)."""
    model, _ = cart(feats, depth, min_leaf)
    return rule_stats(feats, tree_rules(model))


def rule_stats(feats: DataFrame, rules: list[dict]) -> DataFrame:
    """Support and deny share of given rules (``rule_id``, ``text``, ``prediction``, ``conds``): one pass of count_ifs."""
    aggs = []
    for r in rules:
        p = rule_predicate(r["conds"])
        aggs += [F.count_if(p).alias(f"n{r['rule_id']}"), F.count_if(p & (F.col("label") == 1)).alias(f"d{r['rule_id']}")]
    stats = feats.agg(*aggs)
    spark = feats.sparkSession
    meta = spark.createDataFrame([(r["rule_id"], r["text"], r["prediction"]) for r in rules],
                                 "rule_id int, rule string, prediction double")
    longf = stats.select(F.explode(F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"),
                                                      F.col(f"n{r['rule_id']}").alias("n"),
                                                      F.col(f"d{r['rule_id']}").alias("nd")) for r in rules])).alias("s"))
    longf = longf.select("s.rule_id", "s.n", "s.nd")
    return (meta.join(longf, "rule_id")
            .withColumn("deny_share", F.round(F.col("nd") / F.nullif(F.col("n").cast("double"), F.lit(0.0)), 6))
            .drop("nd"))


def cart_summary(feats: DataFrame, depth: int = 4, min_leaf: int = 20) -> DataFrame:
    model, vec = cart(feats, depth, min_leaf)
    acc = model.transform(vec).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    leaves = len(tree_rules(model))
    return feats.sparkSession.createDataFrame(
        [(round(float(acc), 6), int(model.depth), leaves, int(model.numNodes))],
        "accuracy double, depth int, n_leaves int, n_nodes int")


def cart_importance(feats: DataFrame, depth: int = 4, min_leaf: int = 20) -> DataFrame:
    model, _ = cart(feats, depth, min_leaf)
    imp = model.featureImportances.toArray()
    return feats.sparkSession.createDataFrame(
        [(CART_FEATURE_NAMES[i], CART_FEATURES[i], round(float(v), 6)) for i, v in enumerate(imp)],
        "name string, feature string, importance double")


def apply_rules(feats: DataFrame, rules: list[dict]) -> Column:
    """The rule table as one CASE column giving each row's rule prediction."""
    expr = None
    for r in rules:
        p = rule_predicate(r["conds"])
        expr = F.when(p, F.lit(r["prediction"])) if expr is None else expr.when(p, F.lit(r["prediction"]))
    return expr


def cart_rules_apply(feats: DataFrame, depth: int = 4, min_leaf: int = 20) -> DataFrame:
    """Rules applied back as predicates vs the model's own predictions: counts per pair."""
    model, vec = cart(feats, depth, min_leaf)
    rules = tree_rules(model)
    out = model.transform(vec).withColumn("rule_prediction", apply_rules(feats, rules))
    return out.groupBy("rule_prediction", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label"), F.col(pred).cast("int").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))
