"""Operator 5: resolving WARC not-modified revisits.

A revisit stands for an earlier full response of the same canonical URL. Records meet in an as-of join: the latest full
response strictly before the revisit. Its validators are then checked (entity tags by weak comparison; without a pair of tags,
the modification dates), and the permitted headers of the revisit replace the response's, as a cache does on status 304.

The as-of join takes two levels, within time buckets and over bucket totals, and moves no payload, so a URL that holds a third
of all records is spread over many tasks. Payloads are joined by record afterwards, for resolved revisits only.

Defined cases: a URL without ``://`` stands for itself (``opaque:`` and the URL up to its fragment), so it meets equal URLs only; a
null or empty URL, one without host and path, and a null time match nothing; a response without payload still counts, its payload stays null; null
headers are none; of several responses at one time the largest record_id counts; repeated rows are resolved each; without
validators on either side the revisit is ``unverified`` and not resolved; an empty table gives no rows; other input columns
are not read.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified response that replace the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell resources apart.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
#: Records of a time bucket, about, and the most buckets (their edges travel with the plan; beyond it they grow).
BUCKET_ROWS, MOST_BUCKETS = 16384, 4096


def canonical(url: Column) -> Column:
    """Host in lower case without www. and default port, path without last slash, sorted parameters; no scheme, no fragment. A URL
    without ``://`` after ``opaque:``; null if nothing is left."""
    u = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^www[.]|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    known = F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(u == "", None).when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.nullif(known, F.lit(""))).otherwise(
        F.concat(F.lit("opaque:"), u))


def _lower_keys(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit of ``records`` (record_id long, url string, time long, kind 'response' or 'revisit', headers
    map<string,string>, payload string) with ``canonical_url``, ``resolution`` (resolved, mismatch, unverified or missing),
    ``target_id``, merged ``headers`` and ``payload``."""
    slim = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "time", "url", canonical(F.col("url")).alias("c"), (F.col("kind") == "response").alias("full"),
        _lower_keys(F.col("headers")).alias("h"))
    buckets = min(MOST_BUCKETS, slim.count() // BUCKET_ROWS + 1)
    cuts = [i / buckets for i in range(1, buckets)]
    edges = (slim.agg(F.percentile_approx("time", cuts, 10000)).first()[0] or []) if cuts else []
    usable = slim.where("c is not null and time is not null")
    # the buckets' edges are searched by halving, whatever their number
    spans = [float("-inf"), *sorted({float(e) for e in edges} or {0.0}), float("inf")]
    usable = Bucketizer(splits=spans, inputCol="at", outputCol="bucket").transform(usable.withColumn("at", F.col("time").cast("double")))
    usable = usable.drop("at")
    # a response at the revisit's own time is not earlier: revisits stand first among equals
    w = Window.partitionBy("c", "bucket").orderBy("time", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = usable.withColumn("near", F.max(F.when(F.col("full"), F.struct("time", "record_id"))).over(w)).where(~F.col("full"))
    last = usable.where("full").groupBy("c", "bucket").agg(F.max(F.struct("time", "record_id")).alias("last"))
    spots = last.unionByName(near.select("c", "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    spots = spots.groupBy("c", "bucket").agg(F.max("last").alias("last"))
    before = spots.withColumn("carry", F.max("last").over(
        Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("c", "bucket", "carry")
    joined = near.join(before, ["c", "bucket"], "left").withColumn("at", F.coalesce("near", "carry"))
    stray = slim.where("not full and (c is null or time is null)").withColumn("target_id", F.lit(None).cast("long"))
    asked = joined.withColumn("target_id", F.col("at.record_id")).select("record_id", "time", "url", "c", "h", "target_id").unionByName(
        stray.select("record_id", "time", "url", "c", "h", "target_id"))
    stored = slim.where("full").select(F.col("record_id").alias("target_id"), F.col("h").alias("stored"))
    x = asked.join(stored.dropDuplicates(["target_id"]), "target_id", "left")
    tag = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    new, old = F.col("h"), F.col("stored")
    checked = (F.when(F.col("target_id").isNull(), "missing")
               .when(tag(new).isNotNull() & tag(old).isNotNull(), F.when(tag(new) == tag(old), "resolved").otherwise("mismatch"))
               .when(new["last-modified"].isNotNull() & old["last-modified"].isNotNull(),
                     F.when(new["last-modified"] == old["last-modified"], "resolved").otherwise("mismatch"))
               .otherwise("unverified"))
    x = x.withColumn("resolution", checked)
    allowed = F.map_filter("h", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    x = x.withColumn("headers", F.when(F.col("resolution") == "resolved", merged).otherwise(F.col("h")))
    good = x.where("resolution = 'resolved'").join(
        records.where("kind = 'response'").select(F.col("record_id").alias("target_id"), "payload").dropDuplicates(["target_id"]),
        "target_id")
    rest = x.where("resolution <> 'resolved'").withColumn("payload", F.lit(None).cast("string"))
    out = ["record_id", "time", "url", F.col("c").alias("canonical_url"), "resolution", "target_id", "headers", "payload"]
    return good.select(*out).unionByName(rest.select(*out))


#: How the query derives captures from ``pages``: each page is a full response at the time of its number, and a revisit comes
#: LATER (plus a page's own delay) after it. By the page's number modulo 8: 3 and 7 carry an outdated tag, 1 no tag but the
#: modification date (outdated at 9 of 16), 2 no validator, and 6 comes at the time of its own response, so only an earlier page
#: of the same URL can answer it. The modification date counts in steps of DATED pages.
LATER, DELAY, SPREAD, DATED = 1000, 7919, 5000, 40


def captures(pages: DataFrame) -> DataFrame:
    """Responses and revisits derived from ``pages`` (page_id, url, html)."""
    etag = F.md5("html")
    pid = F.col("page_id")
    kind = F.pmod(pid, F.lit(8))
    dated = lambda p: F.floor(p / DATED).cast("string")
    response = pages.select((2 * pid).alias("record_id"), "url", pid.alias("time"), F.lit("response").alias("kind"), F.create_map(
        F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Last-Modified"), dated(pid), F.lit("Date"),
        pid.cast("string")).alias("headers"), F.col("html").alias("payload"))
    when = F.when(kind == 6, pid).otherwise(pid + LATER + F.pmod(pid * DELAY, F.lit(SPREAD)))
    plain = [F.lit("Date"), when.cast("string"), F.lit("Content-Length"), F.lit("0")]
    tag = F.concat(F.lit("W/"), F.when(kind.isin(3, 7), F.lit("old")).otherwise(etag))
    date = F.when(F.pmod(pid, F.lit(16)) == 9, F.lit("before")).otherwise(dated(pid))
    headers = (F.when(kind == 1, F.create_map(F.lit("Last-Modified"), date, *plain)).when(kind == 2, F.create_map(*plain))
               .otherwise(F.create_map(F.lit("ETag"), tag, *plain)))
    revisit = pages.select((2 * pid + 1).alias("record_id"), "url", when.alias("time"), F.lit("revisit").alias("kind"),
                           headers.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


def op5_warc_revisit(pages: DataFrame) -> DataFrame:
    """Every revisit of the captures derived from ``pages``: what it resolves to."""
    x = resolve(captures(pages))
    return x.select(((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "canonical_url", "resolution",
                    (F.col("target_id") / 2).cast("long").alias("target_page_id"),
                    F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(
                        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
                    .alias("merged_headers"), F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"))


def oracle() -> str:
    """DuckDB SQL of ``op5_warc_revisit``."""
    return f"""
WITH u AS (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, html, u,
    regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[.]|:80$|:443$', '', 'g')
    || regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
              lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params FROM u),
c AS (SELECT page_id, html, md5(html) AS tag, CAST(page_id // {DATED} AS VARCHAR) AS dated,
    CASE WHEN u = '' THEN NULL WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
      nullif(base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '') ELSE 'opaque:' || u END AS c,
    CASE WHEN page_id % 8 = 6 THEN page_id ELSE page_id + {LATER} + (page_id * {DELAY}) % {SPREAD} END AS t,
    CASE WHEN page_id % 8 IN (1, 2) THEN NULL WHEN page_id % 8 IN (3, 7) THEN 'old' ELSE md5(html) END AS sent,
    CASE WHEN page_id % 16 = 9 THEN 'before' WHEN page_id % 8 = 1 THEN CAST(page_id // {DATED} AS VARCHAR) END AS since FROM p),
j AS (SELECT r.page_id, r.c, r.t, r.sent, r.since, max(f.page_id) AS target
    FROM c r LEFT JOIN c f ON r.c = f.c AND f.page_id < r.t GROUP BY ALL),
k AS (SELECT j.*, f.html, f.tag, f.dated, CASE WHEN target IS NULL THEN 'missing'
    WHEN j.sent IS NOT NULL AND f.tag IS NOT NULL THEN CASE WHEN j.sent = f.tag THEN 'resolved' ELSE 'mismatch' END
    WHEN j.since IS NOT NULL THEN CASE WHEN j.since = f.dated THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS resolution FROM j LEFT JOIN c f ON f.page_id = j.target)
SELECT page_id, c AS canonical_url, resolution, target AS target_page_id,
  CASE WHEN resolution = 'resolved' THEN 'content-type=text/html;date=' || t || ';etag='
         || CASE WHEN page_id % 8 = 1 THEN coalesce(tag, '') ELSE 'W/' || sent END || ';last-modified=' || dated
       ELSE 'content-length=0;date=' || t || CASE WHEN page_id % 8 IN (1, 2) THEN '' ELSE ';etag=' || coalesce('W/' || sent, '') END
         || CASE WHEN page_id % 8 = 1 THEN ';last-modified=' || since ELSE '' END END AS merged_headers,
  CASE WHEN resolution = 'resolved' THEN length(html) END AS payload_chars,
  CASE WHEN resolution = 'resolved' THEN md5(html) END AS payload_md5 FROM k"""
