import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from paths import SF01
from flowlens.operators import classify as C
from flowlens.operators import detect as D
from flowlens.operators import report as RP
from flowlens.operators.clusters import kmeans_assign, pca
from flowlens.operators.profiles import IFOREST_FEATURES, LOF_FEATURES, ip_profiles
from flowlens.sources.tables import flows


def test_roc_auc_matches_rank_statistic(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(400), 2)                      # many ties
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "p1 double, label int")
    pts, auc = C.roc(df)
    got = auc.first().auc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])   # Mann-Whitney with ties
    assert abs(got - want) < 1e-12
    last = pts.orderBy("score").first()                    # lowest score closes the curve at (1, 1)
    assert abs(last.tpr - 1.0) < 1e-12 and abs(last.fpr - 1.0) < 1e-12


def test_cart_rules_partition_rows_and_agree_with_model(spark):
    feats = C.classifier_features(flows(spark, SF01))
    rules = C.cart_rules(feats).collect()
    assert sum(r.n for r in rules) == feats.count()       # leaves partition the data
    agree = C.cart_rules_apply(feats).collect()
    assert all(r.rule_prediction == r.prediction for r in agree)
    imp = C.cart_importance(feats).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-6


def test_pca_variance_and_sign_rule(spark):
    prof = ip_profiles(flows(spark, SF01))
    scores, var, load = pca(prof, IFOREST_FEATURES, 4)
    v = var.orderBy("component").collect()
    assert all(a.explained_ratio >= b.explained_ratio for a, b in zip(v, v[1:]))
    assert v[-1].cumulative <= 1.0 + 1e-9
    for comp in range(1, 5):
        ls = [r.loading for r in load.filter(F.col("component") == comp).collect()]
        assert max(ls, key=abs) > 0                        # largest loading positive
        assert abs(sum(x * x for x in ls) - 1.0) < 1e-9    # unit vectors
    assert scores.count() == prof.count()


def test_kmeans_assign_covers_every_source(spark):
    prof = ip_profiles(flows(spark, SF01))
    a = kmeans_assign(prof, LOF_FEATURES, 3, n_init=2)
    assert a.count() == prof.count()
    assert a.select("cluster").distinct().count() == 3


def test_compare_models_shape(spark):
    feats = C.classifier_features(flows(spark, SF01))
    rows = {r.model: r for r in C.compare_models(feats, k=3).collect()}
    assert set(rows) == {"logistic_l1", "logistic_l2", "cart", "random_forest"}
    assert all(0.5 <= r.acc_mean <= 1.0 and 0.5 <= r.auc_mean <= 1.0 for r in rows.values())


def test_report_sections_consistent(spark):
    fl = flows(spark, SF01)
    secs = RP.report_sections(fl)
    daily = secs.filter(F.col("section") == "daily").agg(F.sum("n")).first()[0]
    hourly = secs.filter(F.col("section") == "hourly").agg(F.sum("n")).first()[0]
    total = secs.filter((F.col("section") == "summary") & (F.col("label") == "total")).first().n
    assert daily == hourly == total == 10000
    protos = secs.filter(F.col("section") == "protocols").collect()
    assert abs(sum(r.pct for r in protos) - 100.0) < 0.05
    c = RP.report_conclusion(fl).first()
    assert c.top_rule == 6 and c.top_protocol == "TCP" and c.deny_pct == 44.5


def _fl(spark, rows):
    return spark.createDataFrame(rows, "date timestamp_ntz, ip_source string, dest_port int, action string, protocol string")


def test_detectors_on_fixtures(spark):
    t = dt.datetime(2026, 1, 1, 10, 0, 0)
    scan = [(t + dt.timedelta(seconds=i), "6.6.6.6", 1000 + i, "Deny", "TCP") for i in range(12)]
    brute = [(t + dt.timedelta(seconds=5 * i), "7.7.7.7", 22, "Deny", "TCP") for i in range(6)]
    decoy = [(t, f"9.9.9.{i}", 8080, "Deny", "TCP") for i in range(5)]
    df = _fl(spark, scan + brute + decoy)
    ps = D.port_scan(df, "5 minutes", 10).collect()
    assert [(r.ip_source, r.n_ports) for r in ps] == [("6.6.6.6", 12)]
    bf = D.brute_force(df, (21, 22), "1 minute", 5).collect()
    assert [(r.ip_source, r.n_hits) for r in bf] == [("7.7.7.7", 6)]
    dc = D.decoy_scan(df, "1 minute", 5).collect()
    assert [(r.dest_port, r.n_sources) for r in dc] == [(8080, 5)]
    # a spike after a flat day: 24 hours of 2 lines, then 50 lines in one hour
    base = [(t + dt.timedelta(hours=h, minutes=m), "1.1.1.1", 80, "Permit", "TCP") for h in range(24) for m in (0, 30)]
    spike = [(t + dt.timedelta(hours=24, seconds=i), "1.1.1.1", 80, "Permit", "TCP") for i in range(50)]
    sp = D.ddos_spike(_fl(spark, base + spike), "1 hour", 24, 3.0).collect()
    assert len(sp) == 1 and sp[0].n == 50


def test_reduced_roc_keeps_the_area(spark):
    rng = np.random.default_rng(4)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 60, 900), rng.integers(0, 2, 900))] + [(float(100 + i), 1) for i in range(50)]
    rows += [(-1.0 - i, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "p1 double, label int")
    pts = C.roc_points(df, parts=7)
    full, few = (sorted(((r.cfp, r.ctp) for r in x.collect())) for x in (pts, C.drop_intermediate(pts)))

    def area(p):
        p = np.array([(0, 0)] + p, float)
        return np.sum(np.diff(p[:, 0]) * (p[1:, 1] + p[:-1, 1]) / 2)

    # by definition: an inner point goes when the step after it equals the step to it
    steps = np.diff(np.array([(0, 0)] + full), axis=0)
    want = [p for i, p in enumerate(full) if i in (0, len(full) - 1) or (steps[i] != steps[i + 1]).any()]
    assert few == want and len(few) < len(full) and area(few) == area(full)
    one = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p1 double, label int")
    assert C.drop_intermediate(C.roc_points(one)).count() == 1


def test_decoy_sequences_need_the_same_order(spark):
    import datetime as dt
    at = lambda m, s: dt.datetime(2026, 1, 1, 10, m, s)
    rows = []
    for src, ports in (("a", (22, 80, 443)), ("b", (22, 80, 443)), ("c", (80, 22, 443)), ("d", (22, 80))):
        rows += [(at(0, 10 + i), src, p) for i, p in enumerate(ports)]
    rows += [(at(0, 30), "a", 22), (at(0, 40), "a", None), (at(1, 5), "c", 22), (at(1, 6), "c", 80), (at(1, 7), "c", 443)]
    rows += [(at(2, 0), s, p) for s in ("a", "b") for p in (1, 2)]  # one instant: the flow_id decides
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "flow_id long, date timestamp_ntz, ip_source string, dest_port int")
    got = {(r.window_start, r.ports): (r.n_sources, r.n_ports) for r in D.decoy_sequences(df, "1 minute", 2, 2).collect()}
    assert got == {(at(0, 0), "22>80>443"): (2, 3), (at(2, 0), "1>2"): (2, 2)}


def test_kmeans_starts_together_equal_single_fits(spark):
    from flowlens.operators import clusters as K
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (120, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))] + [np.zeros((100, 3))])
    df = spark.createDataFrame([(f"ip{i}", *map(float, r)) for i, r in enumerate(x)], "ip_source string, a double, b double, c double")
    jobs: list = []
    scan, k_best, models, vec = K.kmeans_fit_scan(df, ["a", "b", "c"], 4, 3, 42, jobs=jobs)
    points = np.array([r.x for r in vec.collect()])
    starts = K._starts(vec, range(2, 5), 3, 42, "ip_source")
    assert jobs[0] == jobs[-1] == len(starts) == 9 and len(jobs) <= K.MAX_ITER  # one scan moves all of them
    cost = {}
    for (k, r), c in starts.items():  # each start by itself, in numpy
        for it in range(300):
            own = ((points[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([points[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            done = (((new - c) ** 2).sum(1) <= 1e-8).all()
            c = new
            if done:
                break
        assert it + 2 <= len(jobs)
        cost[k] = min(cost.get(k, np.inf), ((points[:, None] - c) ** 2).sum(2).min(1).sum())
    for r in scan.collect():
        assert abs(r.inertia - cost[r.k]) < 1e-8 * cost[r.k]
        ml = K.assigned(vec, models[r.k], "ip_source").join(vec, "ip_source").select(array_to_vector("x").alias("features"), "cluster")
        want = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(ml)
        assert abs(r.silhouette - want) < 1e-9
    assert k_best == 3


def test_scoring_counts_stand_for_their_rows(spark):
    from pyspark.sql import functions as F

    from flowlens.operators.classify import accuracy, auc_from_points, roc_points, scored_counts

    class Half:  # a model whose score is its first feature
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector
            return df.withColumn("probability", array_to_vector(F.array(1 - F.col("x"), F.col("x")))).withColumn(
                "prediction", (F.col("x") >= 0.5).cast("double"))

    rows = spark.createDataFrame([(x, y) for x, y, n in [(0.25, 0, 5), (0.25, 1, 2), (0.5, 1, 4), (0.5, 0, 3), (0.75, 1, 6)]
                                  for _ in range(n)], "x double, label int")
    counts = scored_counts(Half(), rows.groupBy("x", "label").agg(F.count(F.lit(1)).alias("n")))
    assert counts.count() == 5 and accuracy(counts) == 15 / 20
    cols = ("score", "tp", "fp", "tpr", "fpr", "ctp", "cfp")
    plain, weighted = roc_points(rows, score="x"), roc_points(counts, weight="n")
    assert sorted(plain.select(*cols).collect()) == sorted(weighted.select(*cols).collect())
    assert dict(plain.dtypes) == dict(weighted.dtypes)
    assert auc_from_points(plain).first() == auc_from_points(weighted).first()
    assert accuracy(counts.limit(0)) is None


def _labelled_flows(spark, n=900, seed=5):
    """Feature rows with repeats, more ports than bins and both classes in every leaf."""
    rng = np.random.default_rng(seed)
    port = np.where(rng.random(n) < 0.5, rng.choice([22, 80, 443, 3306], n), rng.integers(0, 65536, n))
    tcp, hour, day = rng.integers(0, 2, n), rng.integers(0, 24, n), rng.integers(0, 7, n)
    deny = rng.random(n) < 1 / (1 + np.exp(1.5 - port / 15000 + 0.8 * tcp - 0.05 * hour))
    rows = [(int(p), int(t), 0 if p <= 1023 else 1 if p <= 49151 else 2, int(h), int(d), int(y))
            for p, t, h, d, y in zip(port, tcp, hour, day, deny)] * 2
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "flow_id long, " + ", ".join(f"{c} int" for c in C.CLF_FEATURES) + ", label int")


def _cells_and_rows(spark, k=3):
    from flowlens.session import materialize
    from pyspark.ml.feature import VectorAssembler
    cells = C.fold_cells(_labelled_flows(spark), k)
    z = [c + "_z" for c in C.CLF_FEATURES]
    rows = cells.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("_", "n")
    return cells, z, VectorAssembler(inputCols=z, outputCol="features").transform(materialize(rows, "rows"))


def test_model_comparison_takes_few_jobs(spark):
    feats = _labelled_flows(spark)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    rows = C.compare_models(feats, k=3).collect()
    assert {r.model for r in rows} == {"logistic_l1", "logistic_l2", "cart", "random_forest"}
    assert all(0.6 < r.auc_mean < 1 for r in rows)
    assert jobs() - before < 120  # with a job for every iteration of every fit it took 402


def test_logistic_fits_reach_the_minimum_in_few_scans(spark):
    from flowlens.operators.counted_fits import logistic_fits
    from pyspark.ml.classification import LogisticRegression
    cells, z, rows = _cells_and_rows(spark)
    want, fits = [], []
    for f in range(3):
        train = rows.filter(F.col("fold") != f).cache()
        n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
        for lam, l1 in ((10 / sum(n.values()), 1.0), (40 / sum(n.values()), 1.0), (1 / sum(n.values()), 0.0)):
            fits.append({"out": f, "rows": [n[0], n[1]], "l1": lam * l1, "l2": lam * (1 - l1), "max_iter": 1000})
            m = LogisticRegression(regParam=lam, elasticNetParam=l1, standardization=False, maxIter=5000, tol=1e-13).fit(train)
            want.append([*m.coefficients, m.intercept])
    scans: list = []
    assert np.abs(np.array(logistic_fits(cells, z, fits, scans)) - want).max() < 2e-5
    assert len(scans) <= 20 and scans[0] == 9  # one scan moves all of them


def test_single_tree_equals_mllib(spark):
    from flowlens.operators.counted_fits import tree_scores
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    cells, z, rows = _cells_and_rows(spark)
    forest = {"trees": 60, "depth": 5, "features": 3, "bootstrap": True, "seed": 1}
    trees = {f"cart{d}": {"trees": 1, "depth": d, "features": 5, "bootstrap": False, "seed": 1} for d in (2, 4, 6)} | {"forest": forest}
    got = tree_scores(cells, z, 3, 16, trees)
    for f in range(3):
        train, test = rows.filter(F.col("fold") != f).cache(), rows.filter(F.col("fold") == f).cache()
        ests = {f"cart{d}": DecisionTreeClassifier(maxDepth=d, maxBins=16, seed=1) for d in (2, 4, 6)}
        for name, est in (ests | {"forest": RandomForestClassifier(numTrees=60, maxDepth=5, maxBins=16, seed=1)}).items():
            counts = C.scored_counts(est.fit(train), test.withColumn("n", F.lit(1)))
            mine = C.counted_scores(got.filter((F.col("fold") == f) & (F.col("model") == name)))
            key = lambda r: (round(r.p1, 9), r.prediction, r.label, r.n)
            if name != "forest":
                assert sorted(map(key, mine.collect())) == sorted(map(key, counts.collect()))
            else:  # other draws of the same bootstrap
                one, two = (C.auc_from_points(C.roc_points(x, weight="n")).first()[0] for x in (mine, counts))
                assert abs(one - two) < 0.02 and abs(C.accuracy(mine) - C.accuracy(counts)) < 0.03


def test_models_of_odd_folds(spark):
    import pytest
    feats = _labelled_flows(spark, 40)
    with pytest.raises(ValueError, match="null"):
        C.compare_models(feats.withColumn("hour", F.when(F.col("flow_id") != 3, F.col("hour"))), k=3)
    # a class of one row: the folds without it have no AUC, the fit without it knows one class only
    rare = feats.withColumn("label", (F.col("flow_id") == 7).cast("int")).withColumn("is_tcp", F.lit(1))
    for r in C.compare_models(rare, k=4).collect():
        assert 0.9 < r.acc_mean < 1 and r.auc_std == 0 and r.auc_mean == 0.5
    with pytest.raises(ValueError):
        C.compare_models(rare, k=1)


def test_roc_of_many_curves_equals_each_alone(spark):
    rng = np.random.default_rng(8)
    rows = [(m, f, float(rng.integers(0, 40)), int(rng.integers(0, 2)), int(rng.integers(1, 5))) for m in "ab" for f in (0, 1) for _ in range(150)]
    df = spark.createDataFrame(rows + [("c", 0, 1.0, 1, 2)], "model string, fold int, p1 double, label int, n int")
    each = ["model", "fold"]
    pts = C.roc_points(df, parts=5, weight="n", by=each)
    auc = {(r.model, r.fold): r.auc for r in C.auc_from_points(pts, each).collect()}
    assert len(auc) == 5 and auc.pop(("c", 0)) is None  # one class: no area
    for (m, f), a in auc.items():
        mine = (F.col("model") == m) & (F.col("fold") == f)
        one = C.roc_points(df.filter(mine), weight="n")
        assert sorted(pts.filter(mine).drop(*each).collect()) == sorted(one.collect())
        assert abs(C.auc_from_points(one).first().auc - a) < 1e-12
