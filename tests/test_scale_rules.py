"""Nothing is capped, switched by size or lost: inputs beyond the limits that once were, and the shared-folder rule."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowlens import session
from flowlens.operators import chunks, classify, iforest, lof, report, retrieval, rules, topk
from flowlens.operators.kpi import flow_rollups
from flowlens.schema import FLOW_SCHEMA, RULE_SCHEMA
from flowlens.sources import io


def _flows(spark, n, **cols):
    base = {"date": F.timestamp_add("SECOND", F.col("id"), F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz"),
            "ip_source": F.concat(F.lit("10.0.0."), F.col("id") % 50), "ip_destination": F.lit("10.1.0.1"),
            "protocol": F.lit("TCP"), "source_port": F.lit(1), "dest_port": (F.col("id") % 2000).cast("int"),
            "rule_id": (F.col("id") % 5).cast("int"), "action": F.when(F.col("id") % 3 == 0, "Deny").otherwise("Permit"),
            "interface_in": F.lit("a"), "interface_out": F.lit("")} | cols
    return spark.range(n).select(F.col("id").alias("flow_id"), *[c.alias(k) for k, c in base.items()])


def test_all_protocols_are_listed(spark):
    df = _flows(spark, 900, protocol=F.concat(F.lit("P"), (F.col("id") % 300).cast("string")))
    assert report.report_sections(df).where("section = 'protocols'").count() == 300
    text = chunks.build_chunks(df).where("kind = 'summary'").first().text
    daily = chunks.build_chunks(df, per="day").where("kind = 'summary'").first().text
    assert all(f"'P{i}': 3" in text and f"'P{i}': 3" in daily for i in range(300))


def test_rollups_are_narrow(spark):
    r = flow_rollups(_flows(spark, 1000))
    assert {k: len([c for c in v.columns if c not in ("n", "first_seen", "last_seen")]) for k, v in r.items()} == {
        "time": 3, "service": 4, "source": 2}


def test_ten_thousand_rules(spark):
    many = [(i, "TCP", i % 3000, i % 3000, None, None, None, "Permit", 1) for i in range(10_001)]
    many += [(20_000, "TCP", 0, 65535, None, "10.0.0.1", None, "Admin", 1), (20_001, "TCP", 5, 9, None, None, "10.0.0.1", "Other", 1)]
    df = _flows(spark, 2000)
    got = {(r.matched_rule, r.matched_action): (r.n, r.n_multi) for r in rules.replay_counts(df, spark.createDataFrame(many, RULE_SCHEMA)).collect()}
    assert got[20_000, "Admin"] == (40, 40)
    assert got[20_001, "Other"] == (5, 5)
    assert got[9_999, "Permit"][0] == 1 and (2_500, "Permit") not in got and got[0, "Permit"] == (1, 1)


def test_forest_samples_all_rows_at_any_size(spark):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    nodes, psi = iforest.fit_trees(df, ["a", "b"], "k", trees=10)
    assert psi == 256 and nodes[nodes.node == 0]["tree"].nunique() == 10
    out = iforest.isolation_forest(df.limit(5000), ["a", "b"], "k", trees=10, contamination=0.05)
    scores = sorted(r.score for r in out.collect())
    assert out.where("status = 'Suspect'").count() == sum(s < scores[249] for s in scores)


def test_order_statistic(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 4, 2, 9, 7, 3, 8, 6]] + [(None,)], "v double")
    assert [topk.order_statistic(df, "v", q) for q in (0.0, 0.1, 0.5, 0.95, 1.0)] == [1.0, 1.0, 4.0, 9.0, 9.0]
    assert topk.order_statistic(df.limit(0), "v", 0.5) is None


@pytest.mark.parametrize("layout", ["L1", "L2", "L3", "L5"])
def test_layouts_give_the_flow_schema(spark, tmp_path, layout):
    """One line per layout: upper-case action, empty rule, empty interface, missing time."""
    p = tmp_path / layout
    if layout == "L1":
        p.write_text(";1.1.1.1;2.2.2.2;tcp;80;;DENY;eth0;\n")
        got = io.read_firewall_log(spark, str(p))
    elif layout == "L2":
        p.write_text(";1.1.1.1;2.2.2.2;tcp;5;80;;DENY;eth0;;6\n")
        got = io.read_flows_export(spark, str(p))
    elif layout == "L3":
        p.write_text("action,date,ip_source,ip_destination,protocol,dest_port,rule_id,interface_in\nDENY,,1.1.1.1,2.2.2.2,tcp,80,,eth0\n")
        got = io.read_flows_csv(spark, str(p))
    else:
        p.write_text(json.dumps({"ipsrc": "1.1.1.1", "ipdst": "2.2.2.2", "dstport": "80", "proto": "tcp", "action": "DENY",
                                 "policyid": "", "interface_in": "eth0"}) + "\n")
        got = io.read_flows_json(spark, str(p))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in FLOW_SCHEMA]
    r = got.first()
    assert (r.protocol, r.dest_port, r.rule_id, r.action, r.interface_in, r.interface_out) == ("TCP", 80, 999, "Deny", "eth0", "")
    assert r.source_port == (5 if layout == "L2" else None) and r.date is not None


def test_null_ports_and_one_class_folds(spark):
    df = _flows(spark, 200, dest_port=F.when(F.col("id") % 4 > 0, (F.col("id") % 2000).cast("int")))
    feats = classify.classifier_features(df)
    assert feats.where(f"dest_port = {classify.NO_PORT}").count() == 50
    got = classify.compare_models(feats, k=2)
    assert got.count() == 4
    means = [r.auc_mean for r in got.collect()]
    assert means == sorted(means, reverse=True)
    one = spark.createDataFrame([(0.5, 1), (0.7, 1)], "p1 double, label int")
    assert classify.auc_from_points(classify.roc_points(one)).first()[0] is None


def test_fingerprint_counts_repeats(spark):
    fp = lambda *x: retrieval.fingerprint(spark.createDataFrame([(v,) for v in x], "v string")).first()
    assert fp("A", "A", "C") != fp("B", "B", "C")
    assert fp("A", "C", "B") == fp("C", "B", "A")


def test_index_is_partitioned_and_errors_show(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    p = str(tmp_path / "idx")
    first = {tuple(r) for r in retrieval.build_index(df, "id", "text", p).select("id", "dim", "weight").collect()}
    assert first == {tuple(r) for r in retrieval.embed(df, "id", "text").select("id", "dim", "weight").collect()}
    assert any(x.name.startswith("dim=") for x in (tmp_path / "idx" / "index").iterdir())
    (tmp_path / "idx" / "_fingerprint").joinpath("x.json").write_text("{not json")
    retrieval.build_index(df.limit(1), "id", "text", p)
    assert spark.read.parquet(p + "/index").select("id").distinct().count() == 1


class _FakeConf(dict):
    def get(self, k, d=None):
        return dict.get(self, k, d)

    def set(self, k, v):
        self[k] = v


class _FakeContext:
    applicationId = "x"

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, d):
        self.folder = d


class _FakeSession:
    def __init__(self, master, conf=None, folder=None):
        self.conf, self.sparkContext = _FakeConf(conf or {}), _FakeContext(master, folder)


def test_shared_folder_rule(monkeypatch):
    monkeypatch.setattr(session, "ship_package", lambda *a: None)
    assert session.work_dir(_FakeSession("yarn", {"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    assert session.work_dir(_FakeSession("yarn", folder="hdfs://a/b")) == "hdfs://a/b"
    assert "flowlens-ckpt-" in session.work_dir(_FakeSession("local[4]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.work_dir(_FakeSession(master))


def test_embedding_needs_no_exchange(spark):
    df = spark.createDataFrame([(1, "b a b  B"), (2, None), (3, "")], "id long, text string")
    e = retrieval.embed(df, "id", "text")
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    assert sorted(round(r.weight, 6) for r in e.collect()) == [0.316228, 0.948683]


def test_lof_leaves_no_vector_out(spark):
    df = spark.range(1200).select(F.concat(F.lit("k"), "id").alias("ip_source"), F.exp(2 * F.randn(1)).alias("z0"), F.exp(2 * F.randn(2)).alias("z1"))
    vec, nb = lof.knn(df, 7, "ip_source")
    per = nb.groupBy("vid").agg(F.sum("take").alias("k"))
    assert per.where("k = 7").count() == vec.count() == 1200


def test_linear_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [4, 1, 3, 2]], "v double")
    assert topk.linear_quantiles(df, "v", [0.0, 0.5, 0.95, 1.0]) == pytest.approx([1.0, 2.5, 3.85, 4.0])
    assert topk.linear_quantiles(df.limit(0), "v", [0.5]) == [None]
