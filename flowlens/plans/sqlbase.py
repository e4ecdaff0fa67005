"""Shared SQL fragments for the DuckDB oracle (the same text also runs in Spark SQL)."""

FLOWS_SQL = """SELECT event_id AS flow_id, ts AS date,
 CASE WHEN user_id % 5 = 0 THEN concat('203.0.113.', CAST(user_id % 256 AS VARCHAR))
      ELSE concat('159.84.', CAST(user_id % 7 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) END AS ip_source,
 concat('159.84.146.', CAST(event_id % 32 AS VARCHAR)) AS ip_destination,
 CASE WHEN event_id % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
 CAST(1024 + (event_id * 31) % 64512 AS INT) AS source_port,
 CAST(CASE event_id % 10 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 21 WHEN 4 THEN 53 WHEN 5 THEN 3306
   WHEN 6 THEN 23 ELSE (event_id * 7919) % 65536 END AS INT) AS dest_port,
 CAST(CASE event_type WHEN 'error' THEN 999 WHEN 'click' THEN 1 WHEN 'view' THEN 4 WHEN 'signup' THEN 6 ELSE 7 END AS INT) AS rule_id,
 CASE WHEN event_type = 'error' OR event_id % 10 >= 7 THEN 'Deny' ELSE 'Permit' END AS action,
 'eth0' AS interface_in, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'eth1' END AS interface_out
FROM events"""

RAW_SQL = """SELECT flow_id, date, concat('fw ulog: action=', upper(action), ' RULE=', CAST(rule_id AS VARCHAR), ' IN=', interface_in,
 ' OUT=', interface_out, ' MAC=aa:bb SRC=', ip_source, ' DST=', ip_destination, ' LEN=60 TOS=00 PREC=0x00 TTL=64 ID=',
 CAST(flow_id AS VARCHAR), CASE WHEN flow_id % 2 = 0 THEN ' DF' ELSE '' END, ' PROTO=', protocol,
 ' SPT=', CAST(source_port AS VARCHAR), ' DPT=', CAST(dest_port AS VARCHAR),
 CASE WHEN protocol = 'UDP' THEN ' LEN=40' ELSE ' WINDOW=1024 SYN' END) AS value FROM flows"""

PORT_CATEGORY_SQL = """CASE WHEN dest_port IS NULL THEN NULL WHEN dest_port < 1024 THEN 'System Ports (0-1023)'
 WHEN dest_port < 49152 THEN 'User Ports (1024-49151)' ELSE 'Dynamic Ports (49152-65535)' END"""

PORT_BUCKET_SQL = """CASE WHEN dest_port IS NULL THEN NULL WHEN dest_port <= 1023 THEN 0
 WHEN dest_port <= 49151 THEN 1 ELSE 2 END"""

# Service names (same fixed list as flowlens.functions.scalar.SERVICES).
SERVICES_SQL = """SELECT * FROM (VALUES (20, 'FTP-Data'), (21, 'FTP'), (22, 'SSH'), (23, 'Telnet'), (25, 'SMTP'),
 (53, 'DNS'), (80, 'HTTP'), (110, 'POP3'), (143, 'IMAP'), (443, 'HTTPS'), (445, 'SMB'), (3306, 'MySQL'),
 (3389, 'RDP'), (8080, 'HTTP-Alt')) AS t(port, service)"""


def with_flows(body: str, raw: bool = False, extra: str = "") -> str:
    """Prefix a query with the ``flows`` (and optionally ``raw``) CTEs."""
    ctes = [f"flows AS ({FLOWS_SQL})"]
    if raw:
        ctes.append(f"raw AS ({RAW_SQL})")
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body


def pct_sql(n: str, total: str, digits: int = 2) -> str:
    return f"round(100.0 * CAST({n} AS DOUBLE) / CAST(NULLIF({total}, 0) AS DOUBLE), {digits})"

RAW_MIXED_SQL = """SELECT flow_id, date, CASE WHEN dest_port = 22 AND action = 'Deny' THEN concat('fw ulog: action=LIMIT SSH IN=',
 interface_in, ' OUT=', interface_out, ' SRC=', ip_source, ' DST=', ip_destination, ' PROTO=', protocol,
 ' DPT=', CAST(dest_port AS VARCHAR)) ELSE concat('fw ulog: action=', upper(action), ' RULE=', CAST(rule_id AS VARCHAR),
 ' IN=', interface_in, ' OUT=', interface_out, ' MAC=aa:bb SRC=', ip_source, ' DST=', ip_destination,
 ' LEN=60 TOS=00 PREC=0x00 TTL=64 ID=', CAST(flow_id AS VARCHAR), CASE WHEN flow_id % 2 = 0 THEN ' DF' ELSE '' END,
 ' PROTO=', protocol, ' SPT=', CAST(source_port AS VARCHAR), ' DPT=', CAST(dest_port AS VARCHAR),
 CASE WHEN protocol = 'UDP' THEN ' LEN=40' ELSE ' WINDOW=1024 SYN' END) END AS value FROM flows"""


def kv_sql(key: str, v: str = "value") -> str:
    return (f"(CASE WHEN regexp_matches({v}, '(?:^|\\s){key}=') "
            f"THEN regexp_extract({v}, '(?:^|\\s){key}=(\\S*)', 1) END)")


def port_int_sql(expr: str) -> str:
    return f"(CASE WHEN TRY_CAST({expr} AS INTEGER) BETWEEN 0 AND 65535 THEN TRY_CAST({expr} AS INTEGER) END)"


def parsed_sql(src: str = "raw", extra_cols: str = "flow_id, ") -> str:
    """Spark's ``parse_raw`` in SQL (date carried from the source row)."""
    action = kv_sql("action")
    df_flag = "regexp_matches(value, '\\sDF(\\s|$)')"
    after = lambda k: f"regexp_matches(value, '\\sDPT=\\S*\\s{k}=')"
    head = "(regexp_matches(value, 'action=') AND regexp_matches(value, '\\sRULE='))"
    cls = (f"CASE WHEN NOT {head} THEN NULL WHEN {after('WINDOW')} AND NOT {df_flag} THEN 2222 "
           f"WHEN {after('WINDOW')} AND {df_flag} THEN 2223 WHEN {after('LEN')} THEN 2224 "
           f"WHEN {after('SEQ')} AND {df_flag} THEN 2226 WHEN {after('SEQ')} AND NOT {df_flag} THEN 2227 END")
    return (f"SELECT {extra_cols}date, {kv_sql('SRC')} AS ip_source, {kv_sql('DST')} AS ip_destination,"
            f" upper({kv_sql('PROTO')}) AS protocol, {port_int_sql(kv_sql('SPT'))} AS source_port,"
            f" {port_int_sql(kv_sql('DPT'))} AS dest_port,"
            f" coalesce(TRY_CAST(NULLIF({kv_sql('RULE')}, '') AS INTEGER), 999) AS rule_id,"
            f" CASE WHEN {action} = 'PERMIT' THEN 'Permit' WHEN {action} = 'DENY' THEN 'Deny' ELSE {action} END AS action,"
            f" {kv_sql('IN')} AS interface_in, {kv_sql('OUT')} AS interface_out,"
            f" CAST({cls} AS INTEGER) AS parse_class, {kv_sql('MAC')} AS mac FROM {src}")


ACCEPT_SQL = "(contains(value, 'RULE=') AND (contains(value, 'action=PERMIT') OR contains(value, 'action=DENY')))"


def rules_sql() -> str:
    from flowlens.operators.rules import RULES

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(str(x) for x in v) + "]"
        if isinstance(v, str):
            return f"'{v}'"
        return str(v)
    rows = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in RULES)
    return (f"SELECT rule_id, proto, lo, hi, CAST(not_ports AS INTEGER[]) AS not_ports, CAST(src_eq AS VARCHAR) AS src_eq,"
            f" CAST(src_ne AS VARCHAR) AS src_ne, action, per_sec FROM (VALUES {rows})"
            f" AS t(rule_id, proto, lo, hi, not_ports, src_eq, src_ne, action, per_sec)")


PROFILES_CTE = """prof0 AS (SELECT ip_source, count(DISTINCT dest_port) AS n_distinct_ports,
 count(*) FILTER (WHERE action = 'Deny') AS n_denies, count(date) AS n_connections,
 greatest(CAST(epoch_us(max(date)) - epoch_us(min(date)) AS DOUBLE) / 60000000.0, 1.0) AS duration_min,
 avg(dest_port) AS mean_port, max(dest_port) AS max_port,
 avg(CASE WHEN protocol = 'TCP' THEN 1 ELSE 0 END) AS tcp_ratio FROM flows GROUP BY ip_source),
prof AS (SELECT *, n_connections / duration_min AS rate_per_min,
 n_denies / CAST(NULLIF(n_connections, 0) AS DOUBLE) AS deny_ratio FROM prof0)"""


def scaled_cte(cols, name: str = "z", digits: int | None = None) -> str:
    """``name`` CTE with ``ip_source`` and z-scores (population std; 0 where std is 0)."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    zs = []
    for i, c in enumerate(cols):
        e = f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END"
        zs.append(f"round({e}, {digits}) AS z{i}" if digits is not None else f"{e} AS {c}_z")
    return (f"{name}_stats AS (SELECT {stats} FROM prof),\n"
            f"{name} AS (SELECT ip_source, {', '.join(zs)} FROM prof, {name}_stats)")


def lof_ctes(cols, k: int = 20, contamination: float = 0.05) -> str:
    d = len(cols)
    dist = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(d))
    return ",\n".join([
        PROFILES_CTE,
        scaled_cte(cols, "z", 9),
        f"""pairs AS (SELECT a.ip_source AS p, b.ip_source AS o, round(sqrt({dist}), 9) AS d
 FROM z a JOIN z b ON a.ip_source <> b.ip_source)""",
        f"""knn AS (SELECT p, o, d FROM (SELECT p, o, d, row_number() OVER (PARTITION BY p ORDER BY d, o) AS rn
 FROM pairs) WHERE rn <= {k})""",
        "kd AS (SELECT p, max(d) AS kdist FROM knn GROUP BY p)",
        """lrd AS (SELECT knn.p, 1.0 / (avg(greatest(kd.kdist, knn.d)) + 1e-10) AS lrd FROM knn JOIN kd ON knn.o = kd.p
 GROUP BY knn.p)""",
        """lofs AS (SELECT knn.p AS ip_source, avg(l2.lrd) / l1.lrd AS lof FROM knn JOIN lrd l2 ON knn.o = l2.p
 JOIN lrd l1 ON knn.p = l1.p GROUP BY knn.p, l1.lrd)""",
        f"""lof_flag AS (SELECT ip_source, lof, lof > (SELECT quantile_cont(lof, {1.0 - contamination}) FROM lofs) AS is_outlier
 FROM lofs)""",
    ])


def principal_ctes(cols, k: int, squarings: int = 16) -> str:
    """``pcs`` CTE (component, v: unit vector, ratio) of the z-scores in ``z``; needs WITH RECURSIVE.

    A covariance matrix squared over and over becomes the projector on its first eigenvector, whose column with the largest
    diagonal is that vector; taking its part out of the matrix leaves the next one. Nothing is fitted.
    """
    d = len(cols)
    at = lambda i, j: i * d + j + 1
    cells = [(i, j) for i in range(d) for j in range(d)]
    cov = ", ".join(f"covar_pop({cols[i]}_z, {cols[j]}_z)" for i, j in cells)
    square = ", ".join("(" + " + ".join(f"m[{at(i, n)}] * m[{at(n, j)}]" for n in range(d)) + ")" for i, j in cells)
    trace = " + ".join(f"m[{at(i, n)}] * m[{at(n, i)}]" for i in range(d) for n in range(d))
    diagonal = ", ".join(f"m[{at(i, i)}]" for i in range(d))
    column = ", ".join(f"m[{i * d} + top]" for i in range(d))
    norm = "sqrt(" + " + ".join(f"u[{i + 1}] * u[{i + 1}]" for i in range(d)) + ")"
    unit = ", ".join(f"u[{i + 1}] / {norm}" for i in range(d))
    weight = " + ".join(f"v[{i + 1}] * c[{at(i, j)}] * v[{j + 1}]" for i, j in cells)
    rest = ", ".join(f"c[{at(i, j)}] - lam * v[{i + 1}] * v[{j + 1}]" for i, j in cells)
    total = " + ".join(f"m[{at(i, i)}]" for i in range(d))
    scaled = ", ".join(f"q[{n + 1}] / t" for n in range(d * d))
    size = ", ".join(f"abs(v[{i + 1}])" for i in range(d))
    signed = ", ".join(f"v[{i + 1}] * sgn" for i in range(d))
    return f"""cov AS (SELECT [{cov}] AS m FROM z),
powers AS (SELECT 1 AS component, 0 AS n, m AS c, m FROM cov UNION ALL
 SELECT component + CAST(n = {squarings} AS INTEGER), CASE WHEN n = {squarings} THEN 0 ELSE n + 1 END,
  CASE WHEN n = {squarings} THEN [{rest}] ELSE c END, CASE WHEN n = {squarings} THEN [{rest}] ELSE [{scaled}] END
 FROM (SELECT *, {weight} AS lam FROM (SELECT *, [{unit}] AS v FROM (SELECT *, [{column}] AS u
  FROM (SELECT *, list_position([{diagonal}], list_max([{diagonal}])) AS top, [{square}] AS q, {trace} AS t FROM powers))))
 WHERE component < {k} OR n < {squarings}),
pcs AS (SELECT component, [{signed}] AS v, lam / (SELECT {total} FROM cov) AS ratio FROM (SELECT *,
  CASE WHEN v[list_position([{size}], list_max([{size}]))] < 0 THEN -1.0 ELSE 1.0 END AS sgn, {weight} AS lam
 FROM (SELECT *, [{unit}] AS v FROM (SELECT *, [{column}] AS u
  FROM (SELECT *, list_position([{diagonal}], list_max([{diagonal}])) AS top FROM powers WHERE n = {squarings})))))"""
