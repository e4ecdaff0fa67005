"""Operator 4: mixing sources to target weights by a low-discrepancy source schedule. DataFrame functions only.

Golden-ratio points map through the sources' cumulative target shares to a schedule of slots, so every stretch of the mix
holds each source nearly in proportion. Slots are ranked per source and joined with that source's equal-token blocks: its
documents in shuffled order, end to end, repeated up to ``CAP`` times, cut every ``BLOCK`` words. A source takes exactly its
target, rounded to words: slots beyond its last block are dropped, and the few that the schedule is short of follow at its end.

Running totals (document positions, slot ranks) are taken in two levels, within small buckets and over bucket totals, so a
source that holds most rows is spread over many tasks. The table of sources is one row per source.

Defined cases: a null text has size 0; documents of size 0 and sources without words take 0; a null source is one source,
last in order; rows that share a doc_id, repeated ones included, are separate documents; null doc_ids are ordered like an
empty id; an empty table gives no rows; other input columns are not read (``mix`` carries them along).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.stages import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 8192
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a bucket, about.
BUCKET_ROWS = 16384
#: Golden-ratio steps modulo 2**31.
_MODULUS = 1 << 31
_GOLDEN = 1327217885
_CELLS = 4096


def _before(df: DataFrame, keys: list[str], bucket: str, order: list[Column], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows before each one within ``keys``; ``bucket`` is a prefix of the order."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("__sum"))
    over = F.expr(f"coalesce(sum(__sum) over (partition by {', '.join(keys)} order by {bucket} "
                  "rows between unbounded preceding and 1 preceding), 0)")
    base = totals.select(*keys, bucket, over.alias("__base"))
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__in", F.coalesce(F.sum(amount).over(w), F.lit(0)))
            .join(base, [*keys, bucket]).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of every row; ``key`` hashes doc_id, text and source."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64("doc_id", "text", "source").alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s, source, source_size, target, quota, lo, hi): each source's target, in words, and its part of the unit interval.

    Water-filling in closed form: sources in order of cap per weight; the first that stays under its cap when all before it
    are full sets the level.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wheel = F.array(*[F.lit(w) for w in weights])
    x = per.withColumn("s", F.expr("row_number() over (order by source asc nulls last)").cast("long"))
    x = x.withColumn("w", F.element_at(wheel, (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * cap).withColumn("total", F.expr("sum(source_size) over ()"))
    x = x.withColumn("ratio", F.col("cap") / F.col("w"))
    x = x.withColumn("full", F.expr("sum(cap) over (order by ratio, s) - cap")).withColumn(
        "open", F.expr("sum(w) over (order by ratio desc, s desc)"))
    x = x.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    x = x.withColumn("level", F.expr("min(case when level <= ratio then struct(ratio, s, level) end) over ()")["level"])
    x = x.withColumn("target", F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    x = x.withColumn("quota", F.least(F.round("target").cast("long"), F.col("cap")))
    hi = F.expr("sum(quota) over (order by s) / greatest(sum(quota) over (), 1)")
    return x.withColumn("hi", hi).withColumn("lo", F.expr("lag(hi, 1, 0.0D) over (order by s)")).select(
        "s", "source", "source_size", "target", "quota", "lo", "hi")


def schedule(spark, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, s, rank): the source of each slot and the block it takes there."""
    need = sources.select("s", "lo", "hi", F.ceil(F.col("quota") / block).cast("long").alias("blocks")).where("blocks > 0")
    total = need.agg(F.sum("blocks"), F.max("s")).first()
    slots, n_sources = total[0] or 0, total[1] or 0
    x = spark.range(slots).select(F.col("id").alias("slot"), (
        F.pmod(F.pmod(F.col("id"), F.lit(_MODULUS)) * _GOLDEN + _MODULUS // 2, F.lit(_MODULUS)) / _MODULUS).alias("point"))
    x = x.withColumn("cell", F.floor(F.col("point") * _CELLS).cast("long"))
    cells = need.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * _CELLS).cast("long"), F.least(F.floor(F.col("hi") * _CELLS), F.lit(_CELLS - 1)).cast("long"))))
    x = x.join(cells, "cell").where("point >= lo and point < hi").select(
        "slot", "s", "blocks", F.floor(F.col("slot") / BUCKET_ROWS).alias("bucket"), F.lit(1).alias("one"))
    ranked = _before(x, ["s"], "bucket", [F.col("slot")], "one", "rank")
    ranked = materialize(ranked.where("rank < blocks").select("slot", "s", "rank"), "slots")
    short = need.join(ranked.groupBy("s").agg(F.count(F.lit(1)).alias("have")), "s", "left").withColumn(
        "have", F.coalesce("have", F.lit(0))).where("have < blocks")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)))
    return ranked.unionByName(short.select(
        (slots + F.col("s") + n_sources * (F.col("rank") - F.col("have"))).alias("slot"), "s", "rank"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents with their position, sources, mix). The mix is one row per slot and document: ``slot``, ``s``,
    ``place`` (first word in the slot), ``start`` (the document's position in its source), ``word`` (the document's first word
    taken there) and ``words``."""
    spark = docs.sparkSession
    sized = materialize(sizes(docs), "sizes")
    sources = materialize(targets(sized, weights, cap), "sources")
    rows = sized.count()
    digits = max(3, len(f"{rows // BUCKET_ROWS:x}"))
    full = sized.where("size > 0").withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    full = full.withColumn("bucket", F.substring("order", 1, digits))
    full = full.join(sources.select("s", F.col("source").alias("__source"), "quota", "source_size"),
                     F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = _before(full, ["s"], "bucket", [F.col("order"), F.col("doc_id"), F.col("size"), F.col("key")], "size", "start")
    placed = materialize(placed.select("doc_id", "key", "s", "size", "start", "quota", "source_size"), "placed")
    runs = placed.withColumn("begin", F.explode(F.transform(F.array(*[F.lit(e) for e in range(cap)]),
                                                            lambda e: e * F.col("source_size") + F.col("start"))))
    runs = runs.where("begin < quota").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    cut = runs.withColumn("rank", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")))
    lo, hi = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    blocks = cut.select("s", "rank", "start", "doc_id", "key", "size", (lo - F.col("rank") * block).alias("place"),
                        (lo - F.col("begin")).alias("word"), (hi - lo).alias("words"))
    mix = blocks.join(schedule(spark, sources, block), ["s", "rank"])
    return placed, sources, mix


def op4_mixing(docs: DataFrame) -> DataFrame:
    """The contract's digest: what the mix takes of each document."""
    placed, sources, mix = mixture(docs)
    cols = ["doc_id", "key", "size", "s", "start"]
    both = placed.select(*cols, F.lit(0).cast("long").alias("words")).unionByName(mix.select(*cols, "words"))
    full = both.groupBy(*cols).agg(F.sum("words").alias("taken")).join(sources.select("s", "source_size", "target"), "s")
    empty = sizes(docs).where("size = 0").join(
        sources.select(F.col("source").alias("__source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__source")))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(*out).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(*out))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it is."""
    parts = F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    return F.array_join(F.slice(parts, F.lit(1), (n + lead).cast("int")), "")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents of the mix: whole copies as often as they are taken, a last part copy cut after its last word taken.

    All columns are kept; ``n_chars``, if there, follows the text."""
    cols = docs.columns
    _, _, parts = mixture(docs, weights, cap)
    took = parts.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("key").alias("__key")).agg(
        F.sum("words").alias("__taken"), F.max("size").alias("__size"))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col("text").alias("__text"),
                        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"),
                        F.xxhash64("doc_id", "text", "source").alias("__key"))
    x = plain.join(took, ["__id", "__key"]).dropDuplicates(["__id", "__key"])
    x = x.withColumn("__left", F.explode(F.expr("transform(sequence(0L, (__taken - 1) div __size), i -> __taken - i * __size)")))
    text = F.when(F.col("__left") >= F.col("__size"), F.col("__text")).otherwise(_first_words(F.col("__text"), F.col("__left")))
    x = x.withColumn("__text", text)
    named = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return x.select(*[named.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])


def oracle(weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> str:
    """DuckDB SQL of ``op4_mixing``: the same targets by resharing step by step, positions over whole sources."""
    wheel = reduce(lambda a, b: f"{a}, {b}", weights)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM p),
w AS (SELECT *, ([{wheel}])[(s - 1) % {len(weights)} + 1] AS w, sum(source_size) OVER ()::DOUBLE AS total FROM s),
f AS (SELECT 0 AS step, *, false AS fixed FROM w
  UNION ALL
  SELECT step + 1, source, source_size, s, w, total,
    fixed OR (total - coalesce(sum({cap} * source_size) FILTER (WHERE fixed) OVER (), 0)) * w / (sum(w) FILTER (WHERE NOT fixed) OVER ())
             > {cap} * source_size
  FROM f WHERE step < 100),
t AS (SELECT source, source_size, CASE WHEN fixed THEN ({cap} * source_size)::DOUBLE
    ELSE (total - coalesce(sum({cap} * source_size) FILTER (WHERE fixed) OVER (), 0)) * w / (sum(w) FILTER (WHERE NOT fixed) OVER ())
  END AS target FROM f WHERE step = 100),
o AS (SELECT doc_id, size, source_size, target, least(round(target)::BIGINT, {cap} * source_size) AS quota,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ({' + '.join(f'greatest(0, least(size, quota - ({e} * source_size + start)))' for e in range(cap))})::BIGINT AS taken FROM o"""
