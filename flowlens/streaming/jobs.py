"""Streaming operators.

The same parse / accept / normalise functions as batch run on ``readStream`` input. Aggregations
carry a watermark so state is dropped once windows close. Aggregate sinks are written per micro-batch
with the batch id in the path, so a replayed batch overwrites its own output; the fan-out keeps a commit
record per batch and sink (``Delivery``): at-least-once input gives exactly-once rows.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.normalize import accept, parse_raw
from flowlens.schema import L45_SCHEMA
from flowlens.sources import io


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw line stream from a folder of text files (a Kafka source has the same shape)."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def stream_json(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """L5 JSON-lines stream with the canonical columns; ``date`` as a (UTC) timestamp, the time of
    arrival where a line has none."""
    from flowlens.operators.normalize import to_flows
    r = spark.readStream.schema(L45_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = to_flows(r.json(path), "L5")
    return df.withColumn("date", F.col("date").cast("timestamp"))


def ingest(lines: DataFrame) -> DataFrame:
    """Continuous parse -> accept -> normalise; event time defaults to arrival time."""
    acc = accept(lines).withColumn("_ingest", F.current_timestamp())
    return parse_raw(acc, ingest_col="_ingest")


def timeline(stream: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Tumbling Permit / Deny counts (the live form of the timeline panel)."""
    a = F.col("action")
    return (stream.withWatermark("date", watermark).groupBy(F.window("date", width).alias("w"))
            .agg(F.count_if(a == "Permit").alias("Permit"), F.count_if(a == "Deny").alias("Deny"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "Permit", "Deny"))


def deny_rate(stream: DataFrame, width: str = "10 minutes", slide: str = "1 minute",
              watermark: str = "10 minutes") -> DataFrame:
    """Sliding per-source line count, denies and deny rate."""
    return (stream.withWatermark("date", watermark)
            .groupBy(F.window("date", width, slide).alias("w"), "ip_source")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "Deny").alias("n_deny"))
            .select(F.col("w.start").alias("window_start"), "ip_source", "n", "n_deny",
                    F.round(F.col("n_deny") / F.col("n"), 6).alias("deny_rate")))


def sessions(stream: DataFrame, gap: str = "3 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Activity sessions per source (a new session after ``gap`` of silence)."""
    return (stream.withWatermark("date", watermark)
            .groupBy(F.session_window("date", gap).alias("s"), "ip_source")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "Deny").alias("n_deny"))
            .select("ip_source", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n", "n_deny"))


def dedup(stream: DataFrame, keys, watermark: str = "10 minutes") -> DataFrame:
    """Drop duplicate deliveries of the same line that arrive within the watermark delay."""
    return stream.withWatermark("date", watermark).dropDuplicatesWithinWatermark(list(keys))


# ------------------------------------------------------------------------------ sinks

def run_append(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append sink; ``availableNow`` processes what is there and stops (tests, backfills)."""
    q = (stream.writeStream.format(fmt).outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_update(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Update-mode aggregate sink: each micro-batch's changed rows go to ``out/_batch=<id>``.

    Rewriting a batch id replaces its folder (idempotent replay); readers take the newest
    version of each key with ``latest``.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, out: str, keys) -> DataFrame:
    """Newest version of each key written by ``run_update``."""
    df = spark.read.parquet(out)
    vals = [c for c in df.columns if c not in keys and c != "_batch"]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("v"))
    return best.select(*keys, *[F.col("v." + c).alias(c) for c in vals])


class Delivery:
    """Where the sinks of a fan-out write, and which of their writes count.

    A batch goes to every sink. After a sink's write a commit record ``commits/<sink>/<first>-<last>`` says where the rows lie
    (first and last batch, place, rows); readers follow the records and nothing else. So a write that failed half-way is never
    seen, a batch that is replayed skips the sinks that have its record, and ``compact`` swaps many small writes for one by a
    single new record. A running fan-out is the only writer: it takes the records up when it starts (``resume``) and adds its
    own, so a batch costs the same however many came before it.
    """

    def __init__(self, spark: SparkSession, out: str, table: str):
        self.spark, self.out, self.table = spark, out.rstrip("/"), table
        self._known: dict[str, dict] = {}

    def records(self, sink: str) -> DataFrame | None:
        """(first, last, place, rows) of the sink's records in force; none if there are none."""
        try:
            every = self.spark.read.schema("first long, last long, place string, rows long").parquet(f"{self.out}/commits/{sink}/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        wider = every.select(F.col("first").alias("f"), F.col("last").alias("l"))
        # a record whose batches a wider one covers has been compacted
        return every.join(wider, (F.col("f") <= F.col("first")) & (F.col("l") >= F.col("last"))
                          & (F.col("l") - F.col("f") > F.col("last") - F.col("first")), "left_anti")

    def resume(self, sinks) -> None:
        """Take up the records that stand; later ones of this writer are added as they are committed."""
        for sink in sinks:
            got = self.records(sink)
            self._known[sink] = {(r.first, r.last): (r.place, r.rows) for r in got.collect()} if got is not None else {}

    def record(self, sink: str, batch: int):
        """(place, rows) of the record that holds a batch; none if the sink does not have it."""
        if sink not in self._known:
            self.resume([sink])
        known = self._known[sink]
        if (batch, batch) in known:
            return known[batch, batch]
        return next((v for (first, last), v in known.items() if first < last and first <= batch <= last), None)

    def has(self, sink: str, batch: int) -> bool:
        return self.record(sink, batch) is not None

    def commit(self, sink: str, first: int, last: int, place: str, rows: int) -> None:
        one = self.spark.range(0, 1, 1, 1).select(F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"),
                                                  F.lit(place).alias("place"), F.lit(rows).cast("long").alias("rows"))
        one.write.mode("overwrite").parquet(f"{self.out}/commits/{sink}/{first}-{last}")
        if sink in self._known:
            self._known[sink][first, last] = (place, rows)

    def _place(self, sink: str, first: int, last: int) -> str:
        return f"{self.out}/{sink}/write={first}-{last}-{uuid.uuid4().hex[:8]}"

    def write(self, sink: str, df: DataFrame, first: int, last: int) -> str:
        """Write rows of the batches first..last to a place of their own; the table takes them as a partition."""
        if sink == "fw_table":
            io.append_fw_table(df, self.table, last)
            return str(last)
        place = self._place(sink, first, last)
        if sink == "parsed":
            df.write.parquet(place)
        elif sink == "raw":
            io.write_raw(df, place)
        elif sink == "firewall_log":
            io.write_firewall_log(df, place)
        elif sink == "daily_index":
            io.write_daily_index(df.drop("value"), place)
        else:
            raise ValueError(f"unknown sink {sink!r}")
        return place

    def deliver(self, sink: str, df: DataFrame, batch: int, rows: int) -> None:
        if not self.has(sink, batch):
            self.commit(sink, batch, batch, self.write(sink, df, batch, batch), rows)

    def read(self, sink: str) -> DataFrame:
        """The committed rows of a sink."""
        got = self.records(sink)
        places = [r.place for r in got.select("place", "first").orderBy("first").collect()] if got is not None else []
        if not places:
            raise ValueError(f"nothing committed to {sink!r}")
        if sink == "fw_table":
            return self.spark.read.table(self.table).where(F.col("batch_id").isin([int(p) for p in places])).drop("batch_id")
        if sink == "raw":
            return self.spark.read.text(places)
        if sink == "firewall_log":
            return io.read_l1_raw(self.spark, places)
        # one table of all places, each with its own day folders
        return self.spark.read.option("basePath", f"{self.out}/{sink}").parquet(*places).drop("write")

    def compact(self, sink: str) -> None:
        """Write all committed batches of a sink as one, with its files as large as Spark's shuffle makes them; the new record
        takes over from the old ones when it stands. The table is left to its own maintenance."""
        got = self.records(sink)
        span = got.agg(F.min("first"), F.max("last"), F.sum("rows"), F.count(F.lit(1))).first() if got is not None else None
        if span is None or span[3] < 2 or sink == "fw_table":
            return
        rows = self.read(sink)
        place = self._place(sink, span[0], span[1])
        if sink == "raw":
            io.write_raw(rows.hint("rebalance"), place)
        elif sink == "firewall_log":
            rows.hint("rebalance").write.option("sep", ";").option("header", False).csv(place)
        else:
            rows.hint("rebalance", "day").write.partitionBy("day").parquet(place)
        self.commit(sink, span[0], span[1], place, span[2])


SINKS = ("raw", "firewall_log", "fw_table", "daily_index")


def fan_out(stream: DataFrame, delivery: Delivery, checkpoint: str, sinks=SINKS, max_batches: int | None = None) -> None:
    """Same accepted lines to every sink per micro-batch: raw text, L1 firewall log, table, day index.

    The parsed batch is written once and read by all sinks at the same time, so an arrival time filled in for a missing one is the same everywhere;
    a replay takes the batch as first written. Delivery to a sink that has the batch's commit record is skipped.
    ``max_batches`` stops after so many batches (a planned restart).
    """
    spark = delivery.spark
    delivery.resume(["parsed", *sinks])

    def write(df: DataFrame, batch_id: int) -> None:
        if not delivery.has("parsed", batch_id):
            place = delivery.write("parsed", df, batch_id, batch_id)
            delivery.commit("parsed", batch_id, batch_id, place, spark.read.schema(df.schema).parquet(place).count())
        place, rows = delivery.record("parsed", batch_id)
        batch = spark.read.schema(df.schema).parquet(place)
        each_at_once(spark, lambda sink: delivery.deliver(sink, batch, batch_id, rows), sinks)
        if max_batches is not None and batch_id + 1 >= max_batches:
            raise Stopped(f"after batch {batch_id}")

    parsed = parse_raw(accept(stream).withColumn("_ingest", F.current_timestamp()), ingest_col="_ingest",
                       keep=("value",))
    q = (parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def each_at_once(spark: SparkSession, run, sinks) -> None:
    """``run(sink)`` for all sinks side by side. All are waited for; then the first error, if any, is raised."""
    with ThreadPoolExecutor(max_workers=max(1, len(sinks))) as ex:
        for done in [ex.submit(inheritable_thread_target(spark)(run), sink) for sink in sinks]:
            done.result()


class Stopped(RuntimeError):
    """A fan-out was stopped by ``max_batches``; its last batch counts as not finished and is replayed."""
