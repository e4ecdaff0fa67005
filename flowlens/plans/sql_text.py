"""Oracle SQL for the text side: knowledge-base chunks, embeddings and retrieval."""

from __future__ import annotations

from flowlens.functions.scalar import SERVICES
from flowlens.operators import chunks as C


def s(text: str) -> str:
    """A SQL string expression for ``text`` (newlines as chr(10))."""
    parts = text.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) if text else "''"


def _service(col: str, default: str) -> str:
    whens = " ".join(f"WHEN {col} = {p} THEN '{n}'" for p, n in SERVICES)
    return f"(CASE {whens} ELSE '{default}' END)"


def dict_sql(key: str, k: int | None, where: str = "", quote: bool = True) -> str:
    w = f"WHERE {where}" if where else ""
    kt = f"'''' || {key} || ''''" if quote else f"CAST({key} AS VARCHAR)"
    return (f"('{{' || coalesce((SELECT string_agg(item, ', ' ORDER BY n DESC, {key}) FROM (SELECT {key}, count(*) AS n,"
            f" {kt} || ': ' || CAST(count(*) AS VARCHAR) AS item FROM flows {w} GROUP BY {key}"
            f" ORDER BY n DESC, {key}{'' if k is None else f' LIMIT {k}'})), '') || '}}')")


def port_lines_sql(where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    item = (f"'Port ' || CAST(dest_port AS VARCHAR) || '(' || {_service('dest_port', C.UNKNOWN_SERVICE)} || '): '"
            f" || CAST(n AS VARCHAR)")
    return (f"coalesce((SELECT string_agg({item}, chr(10) ORDER BY n DESC, dest_port) FROM (SELECT dest_port, count(*) AS n"
            f" FROM flows {w} GROUP BY dest_port ORDER BY n DESC, dest_port LIMIT 20)), '')")


ROW_SQL = ("concat_ws(' ', strftime(date, '%Y-%m-%d %H:%M:%S'), ip_source, ip_destination, protocol,"
           " CAST(source_port AS VARCHAR), CAST(dest_port AS VARCHAR), CAST(rule_id AS VARCHAR), action,"
           " interface_in, interface_out)")


def pct1_sql(n: str, total: str) -> str:
    return f"coalesce(printf('%.1f', round(100.0 * {n} / CAST(NULLIF({total}, 0) AS DOUBLE), 1)), 'n/a')"


def kb_cte(sample_n: int = 300, seed: int = 42) -> str:
    deny = "action = 'Deny'"
    head = ("(SELECT count(*) AS total, count(*) FILTER (WHERE action = 'Permit') AS p,"
            " count(*) FILTER (WHERE action = 'Deny') AS d, min(date) AS dmin, max(date) AS dmax FROM flows) h")
    c0 = (f"SELECT 0 AS chunk_id, 'summary' AS kind, {s(C.T_SUMMARY + chr(10) + 'Total: ')} || format('{{:,}}', total)"
          f" || ' | Permit: ' || format('{{:,}}', p) || ' (' || {pct1_sql('p', 'total')} || '%) | Deny: '"
          f" || format('{{:,}}', d) || ' (' || {pct1_sql('d', 'total')} || '%)' || chr(10) || 'Protocoles: '"
          f" || {dict_sql('protocol', None)} AS text FROM {head}")
    c1 = (f"SELECT 1, 'ips', {s(C.T_TOP_IPS + chr(10))} || {dict_sql('ip_source', 20)} || "
          f"{s(chr(10) + chr(10) + C.T_TOP_DENIED_IPS + chr(10))} || {dict_sql('ip_source', 20, deny)}")
    c2 = (f"SELECT 2, 'ports', {s(C.T_PORTS + chr(10))} || {port_lines_sql()} || {s(chr(10) + C.T_DENIED_PORTS + chr(10))}"
          f" || {port_lines_sql(deny)}")
    c3 = (f"SELECT 3, 'rules', {s(C.T_RULES + chr(10))} || {dict_sql('rule_id', 15, quote=False)} || "
          f"{s(chr(10) + chr(10) + C.T_DENY_RULES + chr(10))} || {dict_sql('rule_id', 10, deny, quote=False)}")
    hours = "(SELECT hour(date) AS h, count(*) AS n, count(*) FILTER (WHERE action = 'Deny') AS nd FROM flows GROUP BY 1)"
    c4 = (f"SELECT 4, 'time', {s(C.T_TIME + chr(10) + 'Periode: ')} || strftime(dmin, '%Y-%m-%d %H:%M:%S') || ' -> '"
          f" || strftime(dmax, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Pic total: '"
          f" || CAST((SELECT h FROM {hours} ORDER BY n DESC, h LIMIT 1) AS VARCHAR) || 'h | Pic deny: '"
          f" || coalesce(CAST((SELECT h FROM {hours} WHERE nd > 0 ORDER BY nd DESC, h LIMIT 1) AS VARCHAR), 'N/A')"
          f" || 'h' || chr(10) || coalesce((SELECT string_agg('  ' || CAST(h AS VARCHAR) || 'h: ' || CAST(n AS VARCHAR),"
          f" chr(10) ORDER BY h) FROM {hours}), '') FROM {head}")
    dcounts = "(SELECT ip_source, count(*) AS n FROM flows WHERE action = 'Deny' GROUP BY ip_source)"
    sus = (f"coalesce((SELECT string_agg(ip_source || ': ' || CAST(n AS VARCHAR) || ' blocages', chr(10)"
           f" ORDER BY n DESC, ip_source) FROM (SELECT * FROM {dcounts} WHERE n > (SELECT quantile_cont(n, 0.95)"
           f" FROM {dcounts}) ORDER BY n DESC, ip_source LIMIT 20)), '')")
    ext = ("coalesce((SELECT string_agg(ip_source, chr(10) ORDER BY first, ip_source) FROM (SELECT ip_source,"
           " min(date) AS first FROM flows WHERE NOT starts_with(ip_source, '159.84') GROUP BY ip_source"
           " ORDER BY first, ip_source LIMIT 20)), '')")
    c5 = f"SELECT 5, 'suspects', {s(C.T_SUSPECTS + chr(10))} || {sus} || {s(chr(10) + C.T_OUT_OF_PLAN + chr(10))} || {ext}"
    ports = ", ".join(str(p) for p in C.SENSITIVE_PORTS)
    sens = (f"(SELECT * FROM flows WHERE action = 'Deny' AND dest_port IN ({ports}) ORDER BY date, flow_id LIMIT 50)")
    c6 = (f"SELECT 6, 'sensitive', {s(C.T_SENSITIVE + chr(10))} || coalesce((SELECT string_agg({ROW_SQL}, chr(10)"
          f" ORDER BY date, flow_id) FROM {sens}), '') FROM (SELECT count(*) AS k FROM {sens}) WHERE k > 0")
    hexpr = f"md5(CAST(flow_id AS VARCHAR) || '|{seed}')"
    samp = f"(SELECT *, {hexpr} AS _h FROM flows ORDER BY _h, flow_id LIMIT {sample_n})"
    c7 = (f"SELECT 7, 'sample', {s(C.T_SAMPLE + ' 0:' + chr(10))} || coalesce((SELECT string_agg({ROW_SQL}, chr(10)"
          f" ORDER BY _h, flow_id) FROM {samp}), '') FROM {head}")
    return "kb AS (" + "\nUNION ALL ".join([c0, c1, c2, c3, c4, c5, c6, c7]) + ")"


def embed_cte(name: str, src: str, id_expr: str, text_col: str = "text") -> str:
    """``name`` CTE ``(id, dim, weight)`` computed like ``retrieval.embed``."""
    return (f"{name}_w AS (SELECT {id_expr} AS id, unnest(string_split_regex(lower({text_col}), '\\s+')) AS word FROM {src}),\n"
            f"{name}_c AS (SELECT id, CAST(CAST('0x' || right(md5(word), 3) AS INTEGER) % 512 AS INTEGER) AS dim,"
            f" count(*) AS cnt FROM {name}_w WHERE word <> '' GROUP BY 1, 2),\n"
            f"{name} AS (SELECT id, dim, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY id)) AS weight FROM {name}_c)")


def topn_cte(name: str, qemb: str, iemb: str, ids_sql: str, qids_sql: str, n: int) -> str:
    """Top-n per query with zero-score fill from the full id list (id order)."""
    return (f"{name}_s AS (SELECT q.id AS qid, i.id AS id, sum(i.weight * q.weight) AS score FROM {iemb} i"
            f" JOIN {qemb} q ON i.dim = q.dim GROUP BY 1, 2),\n"
            f"{name}_all AS (SELECT a.qid, b.id, coalesce(s.score, 0.0) AS score FROM ({qids_sql}) a CROSS JOIN ({ids_sql}) b"
            f" LEFT JOIN {name}_s s ON s.qid = a.qid AND s.id = b.id),\n"
            f"{name} AS (SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY"
            f" round(score, 9) DESC, id) AS INTEGER) AS rank FROM {name}_all) WHERE rank <= {n})")


def _day_items_sql(key: str, k: int | None, item: str, where: str = "", sep: str = "', '") -> str:
    w = f"WHERE {where}" if where else ""
    return (f"(SELECT day, string_agg(item, {sep} ORDER BY rk) AS t FROM (SELECT day, {item} AS item,"
            f" row_number() OVER (PARTITION BY day ORDER BY n DESC, {key}) AS rk FROM (SELECT CAST(date AS DATE) AS day,"
            f" {key}, count(*) AS n FROM flows {w} GROUP BY 1, 2)){'' if k is None else f' WHERE rk <= {k}'} GROUP BY day)")


def daily_kb_sql() -> str:
    deny = "action = 'Deny'"
    quote = "''''"

    def q(key):
        return f"{quote} || {key} || {quote} || ': ' || CAST(n AS VARCHAR)"

    def p(key):
        return f"CAST({key} AS VARCHAR) || ': ' || CAST(n AS VARCHAR)"

    port = (f"'Port ' || CAST(dest_port AS VARCHAR) || '(' || {_service('dest_port', C.UNKNOWN_SERVICE)} || '): '"
            f" || CAST(n AS VARCHAR)")
    pieces = {
        "proto": _day_items_sql("protocol", None, q("protocol")),
        "ips": _day_items_sql("ip_source", 20, q("ip_source")),
        "ips_d": _day_items_sql("ip_source", 20, q("ip_source"), deny),
        "ports": _day_items_sql("dest_port", 20, port, sep="chr(10)"),
        "ports_d": _day_items_sql("dest_port", 20, port, deny, sep="chr(10)"),
        "rules": _day_items_sql("rule_id", 15, p("rule_id")),
        "rules_d": _day_items_sql("rule_id", 10, p("rule_id"), deny),
    }
    day_flows = "(SELECT *, CAST(date AS DATE) AS day FROM flows)"
    dcounts = f"(SELECT day, ip_source, count(*) AS n FROM {day_flows} WHERE {deny} GROUP BY 1, 2)"

    def lines(rows, order, k, item):
        return (f"(SELECT day, string_agg({item}, chr(10) ORDER BY rk) AS t FROM (SELECT *, row_number() OVER (PARTITION BY day"
                f" ORDER BY {order}) AS rk FROM {rows}) WHERE rk <= {k} GROUP BY day)")
    ports = ", ".join(str(x) for x in C.SENSITIVE_PORTS)
    pieces["suspects"] = lines(f"(SELECT c.* FROM {dcounts} c JOIN (SELECT day, quantile_cont(n, 0.95) AS cut FROM {dcounts}"
                               " GROUP BY 1) q ON c.day = q.day WHERE n > cut)", "n DESC, ip_source", 20,
                               f"ip_source || ': ' || CAST(n AS VARCHAR) || {s(C.T_BLOCKED)}")
    pieces["outside"] = lines(f"(SELECT day, ip_source, min(date) AS first FROM {day_flows} WHERE NOT starts_with(ip_source, '159.84')"
                              " GROUP BY 1, 2)", "first, ip_source", 20, "ip_source")
    pieces["sensitive"] = lines(f"(SELECT * FROM {day_flows} WHERE {deny} AND dest_port IN ({ports}))", "date, flow_id", 50, ROW_SQL)
    pieces["sample"] = lines(f"(SELECT *, md5(CAST(flow_id AS VARCHAR) || '|42') AS _h FROM {day_flows})", "_h, flow_id", 300, ROW_SQL)
    head = ("(SELECT CAST(date AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE action = 'Permit') AS p,"
            " count(*) FILTER (WHERE action = 'Deny') AS d, min(date) AS dmin, max(date) AS dmax FROM flows GROUP BY 1)")
    hours = ("(SELECT CAST(date AS DATE) AS day, hour(date) AS h, count(*) AS n,"
             " count(*) FILTER (WHERE action = 'Deny') AS nd FROM flows GROUP BY 1, 2)")
    hp = (f"(SELECT day, arg_max(h, n * 100 - h) AS peak, arg_max(h, nd * 100 - h) FILTER (WHERE nd > 0) AS peak_d,"
          f" string_agg('  ' || CAST(h AS VARCHAR) || 'h: ' || CAST(n AS VARCHAR), chr(10) ORDER BY h) AS hour_lines"
          f" FROM {hours} GROUP BY day)")
    joins = " ".join(f"LEFT JOIN {sql} {name} ON {name}.day = h.day" for name, sql in pieces.items())

    def g(name):
        return f"coalesce({name}.t, '')"

    def ts(c):
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

    day = "CAST(h.day AS VARCHAR)"
    lb, rb = "'{'", "'}'"
    texts = [
        (0, "summary", f"{s(C.T_SUMMARY + ' ')} || {day} || chr(10) || 'Total: ' || format('{{:,}}', total) || ' | Permit: '"
                       f" || format('{{:,}}', p) || ' (' || {pct1_sql('p', 'total')} || '%) | Deny: ' || format('{{:,}}', d)"
                       f" || ' (' || {pct1_sql('d', 'total')} || '%)' || chr(10) || 'Protocoles: ' || {lb} || {g('proto')}"
                       f" || {rb}"),
        (1, "ips", f"{s(C.T_TOP_IPS + ' ')} || {day} || chr(10) || {lb} || {g('ips')} || {rb} || chr(10) || chr(10)"
                   f" || {s(C.T_TOP_DENIED_IPS)} || chr(10) || {lb} || {g('ips_d')} || {rb}"),
        (2, "ports", f"{s(C.T_PORTS + ' ')} || {day} || chr(10) || {g('ports')} || chr(10) || {s(C.T_DENIED_PORTS)}"
                     f" || chr(10) || {g('ports_d')}"),
        (3, "rules", f"{s(C.T_RULES + ' ')} || {day} || chr(10) || {lb} || {g('rules')} || {rb} || chr(10) || chr(10)"
                     f" || {s(C.T_DENY_RULES)} || chr(10) || {lb} || {g('rules_d')} || {rb}"),
        (4, "time", f"{s(C.T_TIME + ' ')} || {day} || chr(10) || 'Periode: ' || {ts('dmin')} || ' -> ' || {ts('dmax')}"
                    f" || chr(10) || 'Pic total: ' || CAST(peak AS VARCHAR) || 'h | Pic deny: '"
                    f" || coalesce(CAST(peak_d AS VARCHAR), 'N/A') || 'h' || chr(10) || coalesce(hour_lines, '')"),
        (5, "suspects", f"{s(C.T_SUSPECTS + ' ')} || {day} || chr(10) || {g('suspects')} || chr(10) || {s(C.T_OUT_OF_PLAN)} || chr(10)"
                        f" || {g('outside')}"),
        (6, "sensitive", f"{s(C.T_SENSITIVE + ' ')} || {day} || chr(10) || sensitive.t"),
        (7, "sample", f"{s(C.T_SAMPLE + ' ')} || {day} || ':' || chr(10) || {g('sample')}"),
    ]
    base = f"FROM {head} h {joins} LEFT JOIN {hp} hp ON hp.day = h.day"
    return "\nUNION ALL ".join(f"SELECT h.day AS day, {i} AS chunk_id, '{kind}' AS kind, {txt} AS text {base}"
                              + (" WHERE sensitive.t IS NOT NULL" if kind == "sensitive" else "") for i, kind, txt in texts)
