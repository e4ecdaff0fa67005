from pyspark.sql import functions as F

from paths import SF001
from flowlens.operators import normalize as N
from flowlens.sources.tables import flows, raw_lines

FIXTURE_LINES = [
    "2026-03-02T10:00:00 fw ulog: action=PERMIT RULE=1 IN=eth0 OUT= MAC=aa:bb SRC=159.84.146.9 DST=159.84.146.2 LEN=60 TOS=00 PREC=0x00 TTL=64 ID=1 DF PROTO=TCP SPT=40000 DPT=22 SEQ=1 ACK=0 WINDOW=1024 SYN",
    "2026-03-02T10:00:01 fw ulog: action=DENY RULE=999 IN=eth0 OUT= MAC=aa:bb SRC=203.0.113.5 DST=159.84.146.2 LEN=60 TOS=00 PREC=0x00 TTL=64 ID=2 PROTO=TCP SPT=40001 DPT=445 WINDOW=1024 SYN",
    "2026-03-02T10:00:02 fw ulog: action=PERMIT RULE=6 IN=eth0 OUT= MAC=aa:bb SRC=159.84.146.9 DST=159.84.146.2 LEN=33 TOS=00 PREC=0x00 TTL=64 ID=3 PROTO=udp SPT=40002 DPT=53 LEN=13",
    "2026-03-02T10:00:03 fw ulog: action=PERMIT RULE= IN=eth0 OUT= SRC=159.84.146.9 DST=159.84.146.2 PROTO=TCP DPT=",
    "2026-03-02T10:00:04 fw ulog: action=ADMIN SSH IN=eth0 OUT= SRC=10.70.40.211 DST=159.84.146.2 PROTO=TCP DPT=22",
    "2026-03-02T10:00:05 fw kernel: link up",
]


def _lines(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(FIXTURE_LINES)], "id int, value string")


def test_parse_fixture_lines(spark):
    rows = {r.id: r for r in N.parse_raw(_lines(spark), keep=("id",)).collect()}
    r0 = rows[0]
    assert (r0.action, r0.rule_id, r0.dest_port, r0.protocol, r0.interface_out) == ("Permit", 1, 22, "TCP", "")
    assert str(r0.date) == "2026-03-02 10:00:00"
    assert rows[1].action == "Deny" and rows[1].rule_id == 999
    assert rows[2].protocol == "UDP" and rows[2].dest_port == 53          # LEN twice (T13); upper-cased
    assert rows[3].rule_id == 999 and rows[3].dest_port is None           # empty RULE -> 999 (T12); port null
    assert rows[4].action == "ADMIN"
    assert rows[5].ip_source is None and rows[5].rule_id == 999


def test_line_classes(spark):
    rows = {r.id: r.parse_class for r in N.parse_raw(_lines(spark), keep=("id",)).collect()}
    assert rows[0] == 2226   # DF + SEQ
    assert rows[1] == 2222   # no DF + WINDOW
    assert rows[2] == 2224   # UDP trailing LEN
    assert rows[5] is None


def test_accept_and_quarantine_partition_the_input(spark):
    lines = _lines(spark)
    acc = N.accept(lines).select("id").collect()
    q = N.quarantine(lines).select("id", "reason").collect()
    assert sorted(r.id for r in acc) == [0, 1, 2, 3]
    assert {r.id: r.reason for r in q} == {4: "no_rule", 5: "not_firewall"}   # T11 kept, not lost


def test_parse_of_rendered_flows_round_trips(spark):
    fl = flows(spark, SF001)
    parsed = N.parse_raw(raw_lines(spark, SF001), keep=("flow_id",)).drop("parse_class", "mac")
    cols = [c for c in fl.columns]
    assert parsed.select(*cols).exceptAll(fl.select(*cols)).count() == 0
    assert fl.select(*cols).exceptAll(parsed.select(*cols)).count() == 0


def test_normalize_action_exact_only(spark):
    df = spark.createDataFrame([("PERMIT",), ("DENY",), ("Deny",), ("permit",), ("LIMIT",)], "a string")
    got = [r[0] for r in df.select(N.normalize_action(F.col("a"))).collect()]
    assert got == ["Permit", "Deny", "Deny", "permit", "LIMIT"]
