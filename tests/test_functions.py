import hashlib

from pyspark.sql import functions as F

from flowlens.functions import (PORT_CATEGORY_LABELS, out_of_plan, pct, port_bucket, port_category,
                                register_functions, with_service, word_bucket)


def test_port_category_and_bucket_edges(spark):
    ports = [0, 1023, 1024, 49151, 49152, 65535, None]
    df = spark.createDataFrame([(p,) for p in ports], "dest_port int")
    rows = df.select("dest_port", port_category().alias("c"), port_bucket().alias("b")).collect()
    got = {r.dest_port: (r.c, r.b) for r in rows}
    sys_l, usr_l, dyn_l = PORT_CATEGORY_LABELS
    assert got[0] == (sys_l, 0)          # port 0 is bucket 0 (trap T4)
    assert got[1023] == (sys_l, 0)
    assert got[1024] == (usr_l, 1)
    assert got[49151] == (usr_l, 1)
    assert got[49152] == (dyn_l, 2)
    assert got[65535] == (dyn_l, 2)
    assert got[None] == (None, None)     # null port -> null bucket


def test_word_bucket_matches_128bit_md5_mod(spark):
    words = ["hello", "firewall", "éçà", "ip", "ports", "x" * 50, "Ünïcode"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.b for r in df.select("w", word_bucket("w").alias("b")).collect()}
    for w in words:
        assert got[w] == int(hashlib.md5(w.encode()).hexdigest(), 16) % 512


def test_sql_functions_registered(spark):
    register_functions(spark)
    r = spark.sql("SELECT port_category(22) AS c, port_bucket(50000) AS b, word_bucket('hello') AS w").first()
    assert r.c == PORT_CATEGORY_LABELS[0] and r.b == 2
    assert r.w == int(hashlib.md5(b"hello").hexdigest(), 16) % 512


def test_pct_is_null_on_empty_total_and_half_up(spark):
    df = spark.createDataFrame([(1, 0), (1, 8)], "n long, t long")
    rows = df.select(pct("n", "t").alias("p")).collect()
    assert rows[0].p is None            # trap T8: no division by zero
    assert rows[1].p == 12.5
    # half-up rounding (trap T14): 0.125 -> 0.13
    assert spark.range(1).select(F.round(F.lit(0.125), 2)).first()[0] == 0.13


def test_out_of_plan_and_service(spark):
    df = spark.createDataFrame([("159.84.1.2", 22), ("203.0.113.5", 9999)], "ip_source string, dest_port int")
    rows = with_service(df.withColumn("oop", out_of_plan()), default="Autre").orderBy("dest_port").collect()
    assert [r.oop for r in rows] == [False, True]
    assert [r.service for r in rows] == ["SSH", "Autre"]
