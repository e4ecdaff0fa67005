"""Knowledge-base chunks (K1, F22): report tables rendered to one text row each.

Each chunk is a small aggregate (a top-k or a one-row summary) whose pieces are combined with
scalar subqueries, so no chunk ever needs a join and no raw rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalar import out_of_plan, service_name
from flowlens.operators.retrieval import sample_rows

# ---------------------------------------------------------------------------------------------
# Chunk headings and labels as the assistant writes them.
T_SUMMARY = "RESUME GLOBAL LOGS FIREWALL"
T_TOP_IPS = "TOP IP SOURCES ACTIVES"
T_TOP_DENIED_IPS = "TOP IP SOURCES BLOQUEES"
T_PORTS = "PORTS CIBLES"
T_DENIED_PORTS = "PORTS BLOQUES"
T_RULES = "REGLES FIREWALL"
T_DENY_RULES = "REGLES DENY"
T_TIME = "ANALYSE TEMPORELLE"
T_SUSPECTS = "IP SUSPECTES"
T_OUT_OF_PLAN = "IP HORS PLAN"
T_SENSITIVE = "CONNEXIONS SUSPECTES PORTS SENSIBLES"
T_SAMPLE = "ECHANTILLON LOGS"
T_BLOCKED = " blocages"
T_PROTOCOLS = "Protocoles: "
T_PERIOD = "Periode: "
T_PEAK = "Pic total: "
T_DENY_PEAK = "Pic deny: "
SENSITIVE_PORTS = (21, 22, 23, 3306, 3389, 445, 137)
UNKNOWN_SERVICE = "?"
# ---------------------------------------------------------------------------------------------

def sensitive_denies(df: DataFrame, n: int = 50) -> DataFrame:
    """Denied lines on sensitive ports, first n in event order."""
    return (df.filter((F.col("action") == "Deny") & F.col("dest_port").isin(*SENSITIVE_PORTS))
            .orderBy("date", "flow_id").limit(n))


def render_row(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.concat_ws(" ", F.date_format(c("date"), "yyyy-MM-dd HH:mm:ss"), c("ip_source"), c("ip_destination"),
                       c("protocol"), c("source_port").cast("string"), c("dest_port").cast("string"),
                       c("rule_id").cast("string"), c("action"), c("interface_in"), c("interface_out"))


def _joined(top: DataFrame, item: Column, sort: list[Column], sep: str) -> Column:
    """Scalar subquery: the items of a (small, already limited) frame joined in ``sort`` order."""
    agg = top.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sort)], item.alias("item")))),
        lambda s: s["item"]), sep))
    return F.coalesce(agg.scalar(), F.lit(""))


def _top(counts: DataFrame, key: str, k: int | None, where: Column | None = None) -> DataFrame:
    base = counts if where is None else counts.filter(where)
    every = base.groupBy(key).agg(F.sum("n").alias("n"))
    return every if k is None else every.orderBy(F.col("n").desc(), F.col(key)).limit(k)


def dict_text(df: DataFrame, key: str, k: int | None, where: Column | None = None, quote: bool = True) -> Column:
    """``{key: n, ...}`` of the top-k (or all) keys, most frequent first (a Python dict's text form).

    With no ``k`` the keys must be few by nature: the protocols, of which IP has 256 numbers."""
    top = _top(df, key, k, where)
    kt = F.concat(F.lit("'"), F.col(key), F.lit("'")) if quote else F.col(key).cast("string")
    item = F.concat(kt, F.lit(": "), F.col("n").cast("string"))
    return F.concat(F.lit("{"), _joined(top, item, [-F.col("n"), F.col(key)], ", "), F.lit("}"))


def _pct1(num: str, den: str) -> Column:
    v = F.round((F.lit(100.0) * F.col(num)) / F.nullif(F.col(den).cast("double"), F.lit(0.0)), 1)
    return F.coalesce(F.format_string("%.1f", v), F.lit("n/a"))


def _chunk(i: int, kind: str, text: Column, base: DataFrame) -> DataFrame:
    return base.select(F.lit(i).alias("chunk_id"), F.lit(kind).alias("kind"), text.alias("text"))


def build_chunks(df: DataFrame, sample_n: int = 300, seed: int = 42,
                 rollups: dict[str, DataFrame] | None = None, per: str | None = None) -> DataFrame:
    """The eight knowledge-base chunks of a flow table: ``chunk_id, kind, text``.

    With ``per="day"`` one chunk set per event day is built instead (``build_daily_chunks``).

    All counts come from the narrow ``flow_rollups``; only the sensitive-port lines and the sample
    read raw rows (each a per-task top-k).
    """
    from flowlens.operators.kpi import flow_rollups
    if per == "day":
        return build_daily_chunks(df)
    if per is not None:
        raise ValueError(f"unsupported chunk grouping {per!r}")
    r = rollups if rollups is not None else flow_rollups(df)
    time, service, source, raw = r["time"], r["service"], r["source"], df
    a = F.col("action")
    deny = a == "Deny"
    n = F.col("n")

    head = time.agg(F.sum(n).alias("total"), F.sum(F.when(a == "Permit", n).otherwise(0)).alias("p"),
                  F.sum(F.when(deny, n).otherwise(0)).alias("d"), F.min("first_seen").alias("dmin"),
                  F.max("last_seen").alias("dmax"))
    c0 = _chunk(0, "summary", F.concat(
        F.lit(T_SUMMARY + "\nTotal: "), F.format_number("total", 0), F.lit(" | Permit: "), F.format_number("p", 0),
        F.lit(" ("), _pct1("p", "total"), F.lit("%) | Deny: "), F.format_number("d", 0), F.lit(" ("),
        _pct1("d", "total"), F.lit("%)\n" + T_PROTOCOLS), dict_text(service, "protocol", None)), head)

    c1 = _chunk(1, "ips", F.concat(
        F.lit(T_TOP_IPS + "\n"), dict_text(source, "ip_source", 20), F.lit("\n\n" + T_TOP_DENIED_IPS + "\n"),
        dict_text(source, "ip_source", 20, deny)), head)

    def port_lines(where):
        top = _top(service, "dest_port", 20, where)
        item = F.concat(F.lit("Port "), F.col("dest_port").cast("string"), F.lit("("),
                        service_name("dest_port", UNKNOWN_SERVICE), F.lit("): "), F.col("n").cast("string"))
        return _joined(top, item, [-F.col("n"), F.col("dest_port")], "\n")
    c2 = _chunk(2, "ports", F.concat(F.lit(T_PORTS + "\n"), port_lines(None), F.lit("\n" + T_DENIED_PORTS + "\n"),
                                     port_lines(deny)), head)

    c3 = _chunk(3, "rules", F.concat(
        F.lit(T_RULES + "\n"), dict_text(service, "rule_id", 15, quote=False), F.lit("\n\n" + T_DENY_RULES + "\n"),
        dict_text(service, "rule_id", 10, deny, quote=False)), head)

    hours = time.groupBy(F.col("hour").alias("h")).agg(F.sum(n).alias("n"), F.sum(F.when(deny, n).otherwise(0)).alias("nd"))
    peak = hours.agg(F.max_by("h", F.struct(F.col("n"), -F.col("h")))).scalar()
    peak_d = hours.filter(F.col("nd") > 0).agg(F.max_by("h", F.struct(F.col("nd"), -F.col("h")))).scalar()
    hour_lines = _joined(hours, F.concat(F.lit("  "), F.col("h").cast("string"), F.lit("h: "), F.col("n").cast("string")),
                         [F.col("h")], "\n")
    ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    c4 = _chunk(4, "time", F.concat(
        F.lit(T_TIME + "\n" + T_PERIOD), ts(F.col("dmin")), F.lit(" -> "), ts(F.col("dmax")),
        F.lit("\n" + T_PEAK), peak.cast("string"), F.lit("h | " + T_DENY_PEAK),
        F.coalesce(peak_d.cast("string"), F.lit("N/A")), F.lit("h\n"), hour_lines), head)

    dcounts = source.filter(deny).groupBy("ip_source").agg(F.sum(n).alias("n"))
    cut = dcounts.select(F.percentile(F.col("n").cast("double"), F.lit(0.95))).scalar()
    sus = dcounts.filter(F.col("n") > cut).orderBy(F.col("n").desc(), "ip_source").limit(20)
    sus_lines = _joined(sus, F.concat(F.col("ip_source"), F.lit(": "), F.col("n").cast("string"), F.lit(T_BLOCKED)),
                        [-F.col("n"), F.col("ip_source")], "\n")
    ext = (source.filter(out_of_plan("ip_source")).groupBy("ip_source").agg(F.min("first_seen").alias("first"))
           .orderBy("first", "ip_source").limit(20))
    ext_lines = _joined(ext, F.col("ip_source"), [F.col("first"), F.col("ip_source")], "\n")
    c5 = _chunk(5, "suspects", F.concat(F.lit(T_SUSPECTS + "\n"), sus_lines, F.lit("\n" + T_OUT_OF_PLAN + "\n"),
                                        ext_lines), head)

    sens = sensitive_denies(raw, 50)
    sens_head = sens.agg(F.count(F.lit(1)).alias("k"))
    c6 = _chunk(6, "sensitive", F.concat(
        F.lit(T_SENSITIVE + "\n"),
        _joined(sens, render_row(), [F.col("date"), F.col("flow_id")], "\n")), sens_head.filter(F.col("k") > 0))

    samp = sample_rows(raw, "flow_id", sample_n, seed).withColumn(
        "_h", F.md5(F.concat_ws("|", F.col("flow_id").cast("string"), F.lit(str(seed)))))
    c7 = _chunk(7, "sample", F.concat(F.lit(T_SAMPLE + " 0:\n"),
                                      _joined(samp, render_row(), [F.col("_h"), F.col("flow_id")], "\n")), head)
    out = c0
    for c in (c1, c2, c3, c4, c5, c6, c7):
        out = out.unionByName(c)
    return out


# ------------------------------------------------------------------------------ per-day chunks

def _day_items(df: DataFrame, key: str, k: int | None, item_fn, where: Column | None = None, sep: str = ", ") -> DataFrame:
    """Per day: the top-k (or all) keys by line count rendered with ``item_fn`` and joined in rank order.

    Lines are counted per (day, key) before the shuffle; the window sees these counts only, and a
    bounded rank is pre-limited per task."""
    from pyspark.sql import Window
    base = df if where is None else df.filter(where)
    c = base.groupBy(F.to_date("date").alias("day"), key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("day").orderBy(F.col("n").desc(), F.col(key))
    top = c.withColumn("rk", F.row_number().over(w))
    top = top if k is None else top.filter(F.col("rk") <= F.lit(k))
    return top.groupBy("day").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("rk"), item_fn().alias("item")))), lambda s: s["item"]), sep).alias("t"))


def _day_lines(rows: DataFrame, order: list[Column], k: int, item: Column) -> DataFrame:
    """Per day: the first ``k`` rows in ``order``, rendered and joined; the bound is applied in each task before the shuffle."""
    from pyspark.sql import Window
    top = rows.withColumn("rk", F.row_number().over(Window.partitionBy("day").orderBy(*order))).where(F.col("rk") <= F.lit(k))
    return top.groupBy("day").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rk", item.alias("item")))), lambda s: s["item"]), "\n").alias("t"))


def _daily_lines(df: DataFrame, sample_n: int = 300, seed: int = 42) -> dict[str, DataFrame]:
    """Per day: sources denied more often than 95 percent of the day's denied sources, sources outside the plan by first sight,
    denied lines on sensitive ports, and a hash sample of lines."""
    n = F.col("n")
    rows = df.withColumn("day", F.to_date("date"))
    denied = rows.where(F.col("action") == "Deny").groupBy("day", "ip_source").agg(F.count(F.lit(1)).alias("n"))
    # as in ``topk.quantile_outliers``, a day's percentile keeps one entry per distinct count
    cut = denied.groupBy("day").agg(F.percentile(n.cast("double"), F.lit(0.95)).alias("cut"))
    suspects = denied.join(cut, "day").where(n > F.col("cut"))
    outside = rows.where(out_of_plan("ip_source")).groupBy("day", "ip_source").agg(F.min("date").alias("first"))
    sensitive = rows.where((F.col("action") == "Deny") & F.col("dest_port").isin(*SENSITIVE_PORTS))
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.col("flow_id").cast("string"), F.lit(str(seed)))))
    return {
        "suspects": _day_lines(suspects, [n.desc(), F.col("ip_source")], 20,
                               F.concat("ip_source", F.lit(": "), n.cast("string"), F.lit(T_BLOCKED))),
        "outside": _day_lines(outside, [F.col("first"), F.col("ip_source")], 20, F.col("ip_source")),
        "sensitive": _day_lines(sensitive, [F.col("date"), F.col("flow_id")], 50, render_row()),
        "sample": _day_lines(hashed, [F.col("_h"), F.col("flow_id")], sample_n, render_row()),
    }


def build_daily_chunks(df: DataFrame) -> DataFrame:
    """The eight chunk kinds per event day: ``day, chunk_id, kind, text``; a day without denied lines on sensitive ports has no
    such chunk. Every piece is its own narrow count, or bounded list of lines, per day; no step holds a day in one task."""
    a, n = F.col("action"), F.col("n")
    deny = a == "Deny"
    c = df.groupBy(F.to_date("date").alias("day"), F.hour("date").alias("hour"), "action").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    head = c.groupBy("day").agg(F.sum(n).alias("total"), F.sum(F.when(a == "Permit", n).otherwise(0)).alias("p"),
                                F.sum(F.when(deny, n).otherwise(0)).alias("d"), F.min("first_seen").alias("dmin"),
                                F.max("last_seen").alias("dmax"))
    quoted = lambda key: (lambda: F.concat(F.lit("'"), F.col(key), F.lit("': "), F.col("n").cast("string")))
    plain = lambda key: (lambda: F.concat(F.col(key).cast("string"), F.lit(": "), F.col("n").cast("string")))
    port_item = lambda: F.concat(F.lit("Port "), F.col("dest_port").cast("string"), F.lit("("),
                                 service_name("dest_port", UNKNOWN_SERVICE), F.lit("): "), F.col("n").cast("string"))
    pieces = {
        "proto": _day_items(df, "protocol", None, quoted("protocol")),
        "ips": _day_items(df, "ip_source", 20, quoted("ip_source")),
        "ips_d": _day_items(df, "ip_source", 20, quoted("ip_source"), deny),
        "ports": _day_items(df, "dest_port", 20, port_item, sep="\n"),
        "ports_d": _day_items(df, "dest_port", 20, port_item, deny, sep="\n"),
        "rules": _day_items(df, "rule_id", 15, plain("rule_id")),
        "rules_d": _day_items(df, "rule_id", 10, plain("rule_id"), deny),
    }
    hours = c.groupBy("day", "hour").agg(F.sum(n).alias("n"), F.sum(F.when(deny, n).otherwise(0)).alias("nd"))
    hp = hours.groupBy("day").agg(
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak"),
        F.max_by(F.when(F.col("nd") > 0, F.col("hour")), F.struct(F.col("nd"), -F.col("hour"))).alias("peak_d"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("hour"), F.concat(
            F.lit("  "), F.col("hour").cast("string"), F.lit("h: "), F.col("n").cast("string")).alias("item")))),
            lambda s: s["item"]), "\n").alias("hour_lines"))
    pieces |= _daily_lines(df)
    t = head
    for name, p in pieces.items():
        t = t.join(p.withColumnRenamed("t", name), "day", "left")
    t = t.join(hp, "day", "left")
    g = lambda name: F.coalesce(F.col(name), F.lit(""))
    day = F.col("day").cast("string")
    ts = lambda col: F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    texts = [
        (0, "summary", F.concat(F.lit(T_SUMMARY + " "), day, F.lit("\nTotal: "), F.format_number("total", 0),
                                F.lit(" | Permit: "), F.format_number("p", 0), F.lit(" ("), _pct1("p", "total"),
                                F.lit("%) | Deny: "), F.format_number("d", 0), F.lit(" ("), _pct1("d", "total"),
                                F.lit("%)\n" + T_PROTOCOLS + "{"), g("proto"), F.lit("}"))),
        (1, "ips", F.concat(F.lit(T_TOP_IPS + " "), day, F.lit("\n{"), g("ips"),
                            F.lit("}\n\n" + T_TOP_DENIED_IPS + "\n{"), g("ips_d"), F.lit("}"))),
        (2, "ports", F.concat(F.lit(T_PORTS + " "), day, F.lit("\n"), g("ports"), F.lit("\n" + T_DENIED_PORTS + "\n"),
                              g("ports_d"))),
        (3, "rules", F.concat(F.lit(T_RULES + " "), day, F.lit("\n{"), g("rules"), F.lit("}\n\n" + T_DENY_RULES + "\n{"),
                              g("rules_d"), F.lit("}"))),
        (4, "time", F.concat(F.lit(T_TIME + " "), day, F.lit("\n" + T_PERIOD), ts(F.col("dmin")), F.lit(" -> "),
                             ts(F.col("dmax")), F.lit("\n" + T_PEAK), F.col("peak").cast("string"),
                             F.lit("h | " + T_DENY_PEAK), F.coalesce(F.col("peak_d").cast("string"), F.lit("N/A")),
                             F.lit("h\n"), g("hour_lines"))),
        (5, "suspects", F.concat(F.lit(T_SUSPECTS + " "), day, F.lit("\n"), g("suspects"), F.lit("\n" + T_OUT_OF_PLAN + "\n"),
                                 g("outside"))),
        (6, "sensitive", F.concat(F.lit(T_SENSITIVE + " "), day, F.lit("\n"), F.col("sensitive"))),
        (7, "sample", F.concat(F.lit(T_SAMPLE + " "), day, F.lit(":\n"), g("sample"))),
    ]
    arr = F.array(*[F.struct(F.lit(i).alias("chunk_id"), F.lit(kind).alias("kind"), txt.alias("text"))
                    for i, kind, txt in texts])
    return t.select("day", F.explode(arr).alias("c")).where("c.text is not null").select("day", "c.chunk_id", "c.kind", "c.text")
