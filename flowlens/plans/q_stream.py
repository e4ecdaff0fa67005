"""Streaming queries: each writes its input files from the driver tables into the shared work
folder, runs the stream to completion with ``availableNow`` and returns the sink read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlens.plans.registry import query
from flowlens.plans.sqlbase import ACCEPT_SQL, RAW_MIXED_SQL, parsed_sql, with_flows
from flowlens.session import materialize, scratch_path
from flowlens.sources import io
from flowlens.sources.tables import flows, raw_lines
from flowlens.streaming import jobs as S


#: Source of the record that closes the last sessions; no real source has it.
HEARTBEAT = "(heartbeat)"


def _raw_files(spark, sf) -> str:
    """Raw mixed lines with a leading ISO timestamp, as text files (as many as Spark's shuffle width)."""
    path = scratch_path(spark, "stream-raw")
    lines = raw_lines(spark, sf, mixed=True).select(
        F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.col("value")).alias("value"))
    lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value").write.text(path)
    return path


#: Deliveries that a streaming query gets one after another, in order of time.
SLICES = 4


def _slices(spark, sf, again: bool = False, heartbeat: bool = False):
    """The flows in ``SLICES`` deliveries by time (cut at whole seconds). With ``again``, each delivery repeats the one before;
    with ``heartbeat``, a last record a day after the last event, marked by its source ``HEARTBEAT``, lets the watermark close
    every real session."""
    fl = flows(spark, sf).withColumn("date", F.date_trunc("second", "date").cast("timestamp_ntz"))
    lo, hi = fl.agg(F.min("date"), F.max("date")).first()
    if lo is None:
        return [fl]
    cuts = [(lo + (hi - lo) * i / SLICES).replace(microsecond=0) for i in range(SLICES)]
    at = sum(((F.col("date") >= F.lit(c).cast("timestamp_ntz")).cast("int") for c in cuts[1:]), F.lit(0))
    out = [fl.where((at == i) | ((at == i - 1) if again else F.lit(False))) for i in range(SLICES)]
    if heartbeat:
        out.append(fl.agg((F.max("date") + F.expr("INTERVAL 1 DAY")).alias("date")).select(
            "date", F.lit(HEARTBEAT).alias("ip_source"), *[F.lit(None).cast(t).alias(c) for c, t in [
                ("ip_destination", "string"), ("protocol", "string"), ("dest_port", "int"), ("rule_id", "int"), ("action", "string"),
                ("interface_in", "string"), ("interface_out", "string")]]))
    return out


def deliver_in_turn(spark, slices, run) -> None:
    """Write each delivery as JSON lines into one watched folder and let ``run(folder)`` take it up: the stream restarts from its
    checkpoint for each, so windows, sessions and keys live on in its state."""
    src = scratch_path(spark, "stream-json")
    for i, part in enumerate(slices):
        io.write_flows_json(part, f"{src}/part={i}", mode="overwrite")
        run(src)


_STREAM_PARSED = parsed_sql(f"(SELECT flow_id, date_trunc('second', date) AS date, value FROM raw WHERE {ACCEPT_SQL})", "")


@query("stream_ingest", with_flows(_STREAM_PARSED, extra=f"raw AS ({RAW_MIXED_SQL})"), headline=True)
def q_stream_ingest(spark, sf):
    src = _raw_files(spark, sf)
    out, ck = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-ck")
    S.run_append(S.ingest(S.stream_lines(spark, src, max_files=2)), out, ck)
    return spark.read.parquet(out)


_CONTENT = ("date", "ip_source", "ip_destination", "protocol", "dest_port", "rule_id", "action", "interface_in", "interface_out")


def _print_sql(sink: str, row: str, src: str) -> str:
    return (f"SELECT '{sink}' AS sink, count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) AS HUGEINT))"
            f" AS VARCHAR) AS content FROM {src}")


def _fanout_sql() -> str:
    ts = "strftime(date, '%Y-%m-%d %H:%M:%S')"
    row = "concat_ws('|', " + ", ".join(ts if c == "date" else f"coalesce(CAST({c} AS VARCHAR), '')" for c in _CONTENT) + ")"
    line = "strftime(date, '%Y-%m-%dT%H:%M:%S') || ' ' || value"
    day = f"strftime(date, '%Y-%m-%d') || '|' || {row}"
    return with_flows("\nUNION ALL ".join([
        _print_sql("raw", line, f"raw WHERE {ACCEPT_SQL}"), _print_sql("firewall_log", row, "parsed"),
        _print_sql("fw_table", row, "parsed"), _print_sql("daily_index", day, "parsed")]),
        extra=f"raw AS ({RAW_MIXED_SQL}),\nparsed AS ({_STREAM_PARSED})")


def _content(df, sink: str, *cols):
    """Rows and an order-free fingerprint of their text."""
    row = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return df.agg(F.lit(sink).alias("sink"), F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("content"))


def sink_contents(delivery: S.Delivery):
    """``sink, n_rows, content`` of the four sinks, as their readers see them."""
    ts = F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    rest = [F.col(c) for c in _CONTENT[1:]]
    table = delivery.read("fw_table")
    l4 = [F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), *[F.col(c) for c in (
        "ipsrc", "ipdst", "proto", "dstport", "policyid", "action", "interface_in", "interface_out")]]
    res = _content(delivery.read("raw"), "raw", F.col("value"))
    res = res.unionByName(_content(delivery.read("firewall_log"), "firewall_log", F.col("date"), *rest))
    res = res.unionByName(_content(table, "fw_table", *l4))
    return res.unionByName(_content(delivery.read("daily_index"), "daily_index", F.col("day"), ts, *rest))


@query("stream_fanout", _fanout_sql())
def q_stream_fanout(spark, sf):
    """Fan-out stopped after its second batch and resumed from the checkpoint (the batch is replayed), then compacted."""
    src = _raw_files(spark, sf)
    out, ck = scratch_path(spark, "fanout-out"), scratch_path(spark, "fanout-ck")
    table = "fw_" + out.rsplit("-", 1)[1]
    delivery = S.Delivery(spark, out, table)
    try:
        try:
            S.fan_out(S.stream_lines(spark, src, max_files=3), delivery, ck, max_batches=2)
        except StreamingQueryException as e:
            if "Stopped" not in str(e):
                raise
            S.fan_out(S.stream_lines(spark, src, max_files=3), delivery, ck)
        S.each_at_once(spark, delivery.compact, S.SINKS)
        return materialize(sink_contents(delivery), "fanout-contents")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("stream_timeline", with_flows("""SELECT time_bucket(INTERVAL 5 MINUTE, d) AS window_start,
 time_bucket(INTERVAL 5 MINUTE, d) + INTERVAL 5 MINUTE AS window_end,
 count(*) FILTER (WHERE action = 'Permit') AS Permit, count(*) FILTER (WHERE action = 'Deny') AS Deny
FROM (SELECT date_trunc('second', date) AS d, action FROM flows) GROUP BY 1, 2"""))
def q_stream_timeline(spark, sf):
    out, ck = scratch_path(spark, "timeline-out"), scratch_path(spark, "timeline-ck")
    deliver_in_turn(spark, _slices(spark, sf), lambda src: S.run_update(S.timeline(S.stream_json(spark, src)), out, ck))
    res = S.latest(spark, out, ["window_start", "window_end"])
    return res.select(_ntz("window_start"), _ntz("window_end"), "Permit", "Deny")


@query("stream_deny_rate", with_flows("""SELECT ws AS window_start, ip_source, count(*) AS n,
 count(*) FILTER (WHERE action = 'Deny') AS n_deny,
 round(count(*) FILTER (WHERE action = 'Deny') / CAST(count(*) AS DOUBLE), 6) AS deny_rate
FROM (SELECT time_bucket(INTERVAL 1 MINUTE, date_trunc('second', date)) - to_minutes(k) AS ws, ip_source, action
      FROM flows, range(0, 10) AS r(k)) GROUP BY 1, 2"""))
def q_stream_deny_rate(spark, sf):
    out, ck = scratch_path(spark, "denyrate-out"), scratch_path(spark, "denyrate-ck")
    deliver_in_turn(spark, _slices(spark, sf), lambda src: S.run_update(S.deny_rate(S.stream_json(spark, src)), out, ck))
    res = S.latest(spark, out, ["window_start", "ip_source"])
    return res.select(_ntz("window_start"), "ip_source", "n", "n_deny", "deny_rate")


@query("stream_sessions", with_flows("""SELECT ip_source, min(d) AS session_start, max(d) + INTERVAL 3 MINUTE AS session_end,
 count(*) AS n, count(*) FILTER (WHERE action = 'Deny') AS n_deny FROM (
 SELECT *, sum(CASE WHEN prev IS NULL OR d - prev >= INTERVAL 3 MINUTE THEN 1 ELSE 0 END)
   OVER (PARTITION BY ip_source ORDER BY d ROWS UNBOUNDED PRECEDING) AS sid FROM (
  SELECT ip_source, action, date_trunc('second', date) AS d,
   lag(date_trunc('second', date)) OVER (PARTITION BY ip_source ORDER BY date_trunc('second', date)) AS prev FROM flows))
GROUP BY ip_source, sid"""))
def q_stream_sessions(spark, sf):
    # Session windows support append mode only: sessions are emitted once the watermark passes
    # their end, and the heartbeat record closes the last ones of this finite input.
    out, ck = scratch_path(spark, "sessions-out"), scratch_path(spark, "sessions-ck")
    deliver_in_turn(spark, _slices(spark, sf, heartbeat=True),
                    lambda src: S.run_append(S.sessions(S.stream_json(spark, src)), out, ck))
    res = spark.read.parquet(out).filter(~F.col("ip_source").eqNullSafe(HEARTBEAT))
    return res.select("ip_source", _ntz("session_start"), _ntz("session_end"), "n", "n_deny")


@query("stream_dedup", with_flows("""SELECT DISTINCT date_trunc('second', date) AS date, ip_source, ip_destination,
 protocol, dest_port, rule_id, action FROM flows"""))
def q_stream_dedup(spark, sf):
    # Every line comes again in the next delivery (at-least-once forwarding): what the state still holds is dropped as a
    # duplicate, older lines as late.
    out, ck = scratch_path(spark, "dedup-out"), scratch_path(spark, "dedup-ck")
    keys = ["date", "ip_source", "ip_destination", "protocol", "dest_port", "rule_id", "action"]
    deliver_in_turn(spark, _slices(spark, sf, again=True), lambda src: S.run_append(
        S.dedup(S.stream_json(spark, src).select(*keys), keys), out, ck))
    return spark.read.parquet(out).select(_ntz("date"), *keys[1:])
