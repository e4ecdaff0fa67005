"""Raw-line parsing and normalisation.

One ``regexp_extract`` per key (first occurrence wins), because raw UDP lines carry ``LEN=``
twice and ``DF`` has no ``=``: building a map from the line would fail on duplicate keys.
All of it is narrow (per-row) work: no shuffle, runs the same in batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.schema import FLOW_COLUMNS, FLOW_SCHEMA, LAYOUT_RENAMES

DEFAULT_RULE = 999
# Leading ISO timestamp of a syslog line, when present.
_TS_PREFIX = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"

# Line templates of the pattern database (class ids are the reference's rule ids):
# 2222 TCP without DF ending in WINDOW, 2223 TCP with DF ending in WINDOW, 2224 UDP with a trailing
# LEN, 2226 TCP with DF and SEQ, 2227 TCP without DF and SEQ.
LINE_CLASSES = (2222, 2223, 2224, 2226, 2227)


def kv(value, key: str, padded: bool = False) -> Column:
    """Value of ``KEY=`` (first occurrence); null when the key is absent, '' when empty.

    ``regexp_substr`` on the line with a leading space finds `` KEY=...`` in one pass (a literal
    prefix, so the regex engine skips ahead) and yields NULL when the key is absent. With
    ``padded`` the column already starts with that space.
    """
    v = F.col(value) if isinstance(value, str) else value
    line = v if padded else F.concat(F.lit(" "), v)
    hit = F.regexp_substr(line, F.lit(" " + key + r"=\S*"))
    return F.substring(hit, len(key) + 3, 1 << 30)


def to_int(c: Column, lo: int | None = None, hi: int | None = None) -> Column:
    """Lenient int cast: '' or garbage -> null; out of [lo, hi] -> null."""
    x = c.try_cast("int")
    if lo is not None:
        x = F.when((x >= lo) & (x <= hi), x)
    return x


def normalize_action(c: Column) -> Column:
    """Exact ``PERMIT`` -> ``Permit`` and ``DENY`` -> ``Deny``; anything else unchanged."""
    return F.when(c == "PERMIT", F.lit("Permit")).when(c == "DENY", F.lit("Deny")).otherwise(c)


def default_rule(c: Column) -> Column:
    """Missing or empty rule id -> 999 (the clean-up rule)."""
    return F.coalesce(to_int(F.nullif(c, F.lit(""))), F.lit(DEFAULT_RULE))


def _class_parts(v: Column) -> dict:
    """What follows ``DPT=`` (WINDOW / LEN / SEQ), the ``DF`` flag and the header test."""
    return {"_trailer": F.regexp_extract(v, r" DPT=\S* (WINDOW|LEN|SEQ)=", 1),
            "_df": v.contains(" DF ") | v.endswith(" DF"),
            "_head": v.contains("action=") & v.contains(" RULE=")}


def _class_from(trailer: Column, df_flag: Column, head: Column) -> Column:
    return (F.when(~head, F.lit(None).cast("int"))
            .when((trailer == "WINDOW") & ~df_flag, 2222).when((trailer == "WINDOW") & df_flag, 2223)
            .when(trailer == "LEN", 2224)
            .when((trailer == "SEQ") & df_flag, 2226).when((trailer == "SEQ") & ~df_flag, 2227))


def line_class(value="value") -> Column:
    """Template id of a raw line (2222/2223/2224/2226/2227 or null): one regex finds what follows
    ``DPT=``; the ``DF`` flag and the header are plain substring tests."""
    v = F.col(value) if isinstance(value, str) else value
    p = _class_parts(v)
    return _class_from(p["_trailer"], p["_df"], p["_head"])


def accepted(value="value") -> Column:
    """Forwarding filter: contains ``RULE=`` and ``action=PERMIT`` or ``action=DENY``."""
    v = F.col(value) if isinstance(value, str) else value
    return v.contains("RULE=") & (v.contains("action=PERMIT") | v.contains("action=DENY"))


def reject_reason(value="value") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return (F.when(~v.contains("action="), "not_firewall")
            .when(~v.contains("RULE="), "no_rule")
            .when(~(v.contains("action=PERMIT") | v.contains("action=DENY")), "other_action"))


def parse_raw(lines: DataFrame, value: str = "value", ingest_col: str | None = None,
              keep: tuple = ()) -> DataFrame:
    """Raw lines -> canonical flow columns + ``parse_class`` (+ ``mac``).

    ``date`` comes from a leading ISO timestamp, else from ``ingest_col`` (arrival time), else
    from an existing ``date`` column. Protocol is upper-cased, ports are range-checked ints,
    an empty or missing rule id becomes 999 and the action is normalised.
    """
    v = F.col(value)
    fallbacks = []
    if ingest_col:
        fallbacks.append(F.col(ingest_col).cast("timestamp_ntz"))
    if "date" in lines.columns:
        fallbacks.append(F.col("date").cast("timestamp_ntz"))
    # the padded line is built once (a column), not once per key: smaller generated code
    lines = lines.withColumn("_line", F.concat(F.lit(" "), v))
    ln = F.col("_line")
    raw = {
        "ip_source": kv(ln, "SRC", True), "ip_destination": kv(ln, "DST", True), "_proto": kv(ln, "PROTO", True),
        "_spt": kv(ln, "SPT", True), "_dpt": kv(ln, "DPT", True), "_rule": kv(ln, "RULE", True),
        "_action": kv(ln, "action", True), "interface_in": kv(ln, "IN", True), "interface_out": kv(ln, "OUT", True),
        "mac": kv(ln, "MAC", True),
    }
    extra = [F.col(c) for c in keep]
    # Two projections: extract each key once, then cast / range-check the extracted strings
    # (Catalyst does not merge them back because the extractions are not cheap to repeat).
    step = lines.select(*extra, F.regexp_extract(v, _TS_PREFIX, 1).alias("_ts"),
                        *[f.alias(f"_fb{i}") for i, f in enumerate(fallbacks)],
                        *[c.alias(n) for n, c in raw.items()],
                        *[c.alias(n) for n, c in _class_parts(v).items()])
    ts = F.coalesce(F.try_to_timestamp(F.col("_ts"), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                    F.try_to_timestamp(F.col("_ts"), F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")
    date = F.coalesce(ts, *[F.col(f"_fb{i}") for i in range(len(fallbacks))])
    return step.select(
        *[F.col(c) for c in keep], date.alias("date"), "ip_source", "ip_destination",
        F.upper("_proto").alias("protocol"),
        to_int(F.col("_spt"), 0, 65535).alias("source_port"),
        to_int(F.col("_dpt"), 0, 65535).alias("dest_port"),
        default_rule(F.col("_rule")).alias("rule_id"),
        normalize_action(F.col("_action")).alias("action"),
        "interface_in", "interface_out",
        _class_from(F.col("_trailer"), F.col("_df"), F.col("_head")).alias("parse_class"), "mac")


def accept(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.filter(F.coalesce(accepted(value), F.lit(False)))


def quarantine(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines the forwarding filter drops, kept with a reason instead of silently lost."""
    return (lines.filter(~F.coalesce(accepted(value), F.lit(False)))
            .withColumn("reason", F.coalesce(reject_reason(value), F.lit("null_line"))))


def to_canonical(df: DataFrame, layout: str) -> DataFrame:
    """Rename a layout's columns to canonical names (missing columns are added as nulls)."""
    ren = LAYOUT_RENAMES[layout]
    out = df.withColumnsRenamed(ren) if ren else df
    return out.select(*[F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA],
                      *[c for c in out.columns if c not in FLOW_COLUMNS])


def cast_types(df: DataFrame, date_fmt: str | None = None) -> DataFrame:
    """Text columns -> canonical types, leniently (bad values become null, never an error)."""
    def ts(c):
        if date_fmt:
            return F.try_to_timestamp(F.col(c).cast("string"), F.lit(date_fmt)).cast("timestamp_ntz")
        return F.col(c).cast("string").try_cast("timestamp_ntz")
    casts = {
        "date": ts("date"),
        "source_port": to_int(F.col("source_port").cast("string"), 0, 65535),
        "dest_port": to_int(F.col("dest_port").cast("string"), 0, 65535),
        "rule_id": to_int(F.nullif(F.col("rule_id").cast("string"), F.lit(""))),
        "protocol": F.upper(F.col("protocol")),
    }
    return df.withColumns({k: v for k, v in casts.items() if k in df.columns})


def with_defaults(df: DataFrame, ingest_col: str | None = None, arrival: bool = False) -> DataFrame:
    """Missing rule -> 999, missing event time -> arrival time (``ingest_col``, or with ``arrival``
    the time of the read), action normalised."""
    out = df.withColumn("rule_id", default_rule(F.col("rule_id").cast("string")))
    out = out.withColumn("action", normalize_action(F.col("action")))
    if ingest_col:
        out = out.withColumn("date", F.coalesce(F.col("date"), F.col(ingest_col).cast("timestamp_ntz")))
    if arrival:
        out = out.withColumn("date", F.coalesce(F.col("date"), F.current_timestamp().cast("timestamp_ntz")))
    return out


def to_flows(df: DataFrame, layout: str) -> DataFrame:
    """A layout's text columns as exactly ``FLOW_SCHEMA``: canonical names, types, defaults (an empty
    interface is '')."""
    out = with_defaults(cast_types(to_canonical(df, layout)), arrival=True)
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("interface_in", "interface_out")})
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA])
