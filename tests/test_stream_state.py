"""Streams that carry state from delivery to delivery, and the fan-out's commit records."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlens.plans.q_stream import deliver_in_turn, sink_contents
from flowlens.session import scratch_path
from flowlens.sources import io
from flowlens.streaming import jobs as S

T0 = dt.datetime(2026, 1, 1, 12, 0)
FLOW = ("date timestamp_ntz, ip_source string, ip_destination string, protocol string, dest_port int, rule_id int, action string, "
        "interface_in string, interface_out string")


def flow(minute, src="a", action="Deny", port=22):
    return (T0 + dt.timedelta(minutes=minute), src, "z", "TCP", port, 999, action, "eth0", "eth1")


def deliver(spark, deliveries, run):
    deliver_in_turn(spark, [spark.createDataFrame(d, FLOW) for d in deliveries], run)


def test_late_line_changes_an_open_window_only(spark):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    # watermark after the second delivery: minute 50; the third brings a line of an open window and one of a closed one
    deliver(spark, [[flow(1), flow(52, action="Permit")], [flow(60)], [flow(53, "late"), flow(2, "too late")], [flow(61)]],
            lambda src: S.run_update(S.timeline(S.stream_json(spark, src)), out, ck))
    got = {r.window_start.replace(tzinfo=None): (r.Permit, r.Deny)
           for r in S.latest(spark, out, ["window_start", "window_end"]).collect()}
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert got == {at(0): (0, 1), at(50): (1, 1), at(60): (0, 2)}


def test_sliding_window_grows_over_deliveries(spark):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    deliver(spark, [[flow(5)], [flow(6, action="Permit")], [flow(7)]],
            lambda src: S.run_update(S.deny_rate(S.stream_json(spark, src)), out, ck))
    got = {r.window_start.replace(tzinfo=None): (r.n, r.n_deny) for r in S.latest(spark, out, ["window_start", "ip_source"]).collect()}
    assert got[T0] == (3, 2) and got[T0 + dt.timedelta(minutes=6)] == (2, 1) and got[T0 - dt.timedelta(minutes=4)] == (1, 1)


def test_session_spans_deliveries_and_late_line_joins_two(spark):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    deliver(spark, [[flow(1), flow(20, "b")], [flow(22, "b"), flow(26, "b")], [flow(24, "b")], [flow(90, "x")], [flow(91, "x")]],
            lambda src: S.run_append(S.sessions(S.stream_json(spark, src)), out, ck))
    got = sorted((r.ip_source, r.n, int((r.session_end - r.session_start).total_seconds() // 60))
                 for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 3), ("b", 4, 9)]


def test_duplicate_of_a_later_delivery_is_dropped(spark):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    deliver(spark, [[flow(1), flow(9)], [flow(9), flow(9, "b")], [flow(9), flow(30)], [flow(1)]],
            lambda src: S.run_append(S.dedup(S.stream_json(spark, src), ["date", "ip_source"]), out, ck))
    got = sorted((r.date.replace(tzinfo=None), r.ip_source) for r in spark.read.parquet(out).collect())
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert got == [(at(1), "a"), (at(9), "a"), (at(9), "b"), (at(30), "a")]


def _lines(spark, n):
    src = scratch_path(spark, "raw")
    for part in range(3):
        rows = [(f"2026-01-0{part + 1}T10:00:{i % 60:02d} fw ulog: action={'DENY' if i % 3 else 'PERMIT'} RULE={i % 5} IN=eth0 OUT= "
                 f"SRC=10.0.0.{i % 9} DST=1.1.1.1 PROTO=TCP SPT=1 DPT={i}",) for i in range(part * n, part * n + n)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{src}/p={part}")
    return src


def test_failure_between_two_sinks_is_replayed_once(spark, monkeypatch):
    src, table = _lines(spark, 40), "fw_replay"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    delivery, ck = S.Delivery(spark, scratch_path(spark, "out"), table), scratch_path(spark, "ck")
    plain = io.write_daily_index
    fails = [2]

    def breaks(df, path, *a, **k):
        fails[0] -= 1
        if fails[0] == 0:  # the second batch's index: rows are written, then the job dies before its record
            plain(df, path, *a, **k)
            raise RuntimeError("index server gone")
        plain(df, path, *a, **k)

    monkeypatch.setattr(io, "write_daily_index", breaks)
    stream = lambda: S.stream_lines(spark, src, max_files=1)
    with pytest.raises(StreamingQueryException, match="index server gone"):
        S.fan_out(stream(), delivery, ck)
    assert delivery.read("raw").count() == 80 and delivery.read("daily_index").count() == 40  # the partial write is not seen
    S.fan_out(stream(), delivery, ck)
    got = {r.sink: (r.n_rows, r.content) for r in sink_contents(delivery).collect()}
    assert {n for n, _ in got.values()} == {120} and got["firewall_log"] == got["fw_table"]
    before = {s: delivery.records(s).count() for s in S.SINKS}
    assert set(before.values()) == {3}
    for s in S.SINKS:
        delivery.compact(s)
    assert {s: delivery.records(s).count() for s in S.SINKS} == {"raw": 1, "firewall_log": 1, "fw_table": 3, "daily_index": 1}
    assert {r.sink: (r.n_rows, r.content) for r in sink_contents(delivery).collect()} == got
    assert delivery.read("daily_index").select("day").distinct().count() == 3
    spark.sql(f"DROP TABLE {table}")


def test_arrival_time_is_the_same_in_every_sink(spark):
    src, table = scratch_path(spark, "raw"), "fw_arrival"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.createDataFrame([("fw ulog: action=DENY RULE= IN=eth0 OUT= SRC=1 DST=2 PROTO=TCP SPT=1 DPT=2",)], "value string").write.text(src)
    delivery = S.Delivery(spark, scratch_path(spark, "out"), table)
    S.fan_out(S.stream_lines(spark, src), delivery, scratch_path(spark, "ck"))
    day = delivery.read("daily_index").select(F.date_format("date", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert day == delivery.read("fw_table").select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")).first()[0]
    with pytest.raises(ValueError, match="nothing committed"):
        S.Delivery(spark, scratch_path(spark, "out"), table).read("raw")
    spark.sql(f"DROP TABLE {table}")


def test_records_are_read_once_however_many_batches(spark, monkeypatch):
    src, table = _lines(spark, 20), "fw_once"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    out, ck, reads = scratch_path(spark, "out"), scratch_path(spark, "ck"), []
    plain = S.Delivery.records
    monkeypatch.setattr(S.Delivery, "records", lambda self, sink: reads.append(sink) or plain(self, sink))
    S.fan_out(S.stream_lines(spark, src, max_files=1), S.Delivery(spark, out, table), ck)
    assert sorted(reads) == sorted(("parsed", *S.SINKS))
    again = S.Delivery(spark, out, table)  # another writer finds what the first one committed, compacted or not
    again.compact("raw")
    again.resume(["raw", "daily_index"])
    assert all(again.has(s, b) for s in ("raw", "daily_index") for b in range(3)) and not again.has("raw", 3)
    assert again.record("raw", 1)[1] == 60 and again.record("daily_index", 1)[1] == 20
    days = again.read("daily_index")
    assert days.count() == 60 and dict(days.dtypes)["day"] == "date" and "write" not in days.columns
    assert len(days.inputFiles()) >= 3
    spark.sql(f"DROP TABLE {table}")
