"""Scalar column functions.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Port categories (RFC 6056 ranges), as labelled on the dashboard:
PORT_CATEGORY_LABELS = (
    "System Ports (0-1023)",
    "User Ports (1024-49151)",
    "Dynamic Ports (49152-65535)",
)
# Service names of well-known ports: union of the dashboard's and the assistant's dictionaries.
SERVICES = (
    (20, "FTP-Data"), (21, "FTP"), (22, "SSH"), (23, "Telnet"), (25, "SMTP"), (53, "DNS"),
    (80, "HTTP"), (110, "POP3"), (143, "IMAP"), (443, "HTTPS"), (445, "SMB"), (3306, "MySQL"),
    (3389, "RDP"), (8080, "HTTP-Alt"),
)
# Address-plan prefix of the protected network; sources outside it are "out of plan".
PLAN_PREFIXES = ("159.84",)
# Width of the hashed bag-of-words embedding.
EMBED_DIMS = 512
# ---------------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def port_category(port="dest_port") -> Column:
    """System / User / Dynamic label; null port gives null."""
    p = _c(port)
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p < 1024, F.lit(PORT_CATEGORY_LABELS[0]))
            .when(p < 49152, F.lit(PORT_CATEGORY_LABELS[1]))
            .otherwise(F.lit(PORT_CATEGORY_LABELS[2])))


def port_bucket(port="dest_port") -> Column:
    """0 for 0-1023, 1 for 1024-49151, 2 above; null port gives null (port 0 is bucket 0)."""
    p = _c(port)
    return (F.when(p.isNull(), F.lit(None).cast("int"))
            .when(p <= 1023, F.lit(0)).when(p <= 49151, F.lit(1)).otherwise(F.lit(2)))


def is_deny(action="action") -> Column:
    return (_c(action) == F.lit("Deny")).cast("int")


def is_tcp(protocol="protocol") -> Column:
    return (_c(protocol) == F.lit("TCP")).cast("int")


def safe_ratio(num, den) -> Column:
    """num / den as double, null when den is 0 or null."""
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def pct(num, den, digits: int = 2) -> Column:
    """Percent of total rounded half-up to ``digits`` decimals (null on an empty total)."""
    return F.round((F.lit(100.0) * _c(num).cast("double")) / F.nullif(_c(den).cast("double"), F.lit(0.0)), digits)


def out_of_plan(ip="ip_source", prefixes=PLAN_PREFIXES) -> Column:
    """True when the address starts with none of the address-plan prefixes."""
    c = _c(ip)
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | c.startswith(p)
    return ~cond


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add hour, day (date) and weekday (Monday = 0)."""
    d = F.col(date_col)
    return df.withColumns({"hour": F.hour(d), "day": F.to_date(d), "weekday": F.weekday(d)})


def with_flags(df: DataFrame) -> DataFrame:
    """Add is_deny, is_tcp, port_category and port_bucket."""
    return df.withColumns({
        "is_deny": is_deny(), "is_tcp": is_tcp(),
        "port_category": port_category(), "port_bucket": port_bucket(),
    })


def services_df(spark: SparkSession) -> DataFrame:
    """The fixed service-name table (14 rows; broadcast-safe by construction)."""
    return spark.createDataFrame(list(SERVICES), "port int, service string")


def with_service(df: DataFrame, services: DataFrame | None = None, default: str = "other",
                 port_col: str = "dest_port") -> DataFrame:
    """Left lookup join to the service table; unknown ports get ``default``.

    The service table is a fixed 14-row list, so broadcasting it is size-safe.
    """
    spark = df.sparkSession
    s = services if services is not None else services_df(spark)
    s = s.withColumnRenamed("port", "__svc_port")
    out = df.join(F.broadcast(s), df[port_col] == F.col("__svc_port"), "left")
    return out.withColumn("service", F.coalesce(F.col("service"), F.lit(default))).drop("__svc_port")


def service_name(port="dest_port", default: str = "other") -> Column:
    """Service name as a CASE expression (no join); equivalent to ``with_service``."""
    p = _c(port)
    expr = None
    for num, name in SERVICES:
        expr = F.when(p == num, F.lit(name)) if expr is None else expr.when(p == num, F.lit(name))
    return expr.otherwise(F.lit(default))


def words(text="text") -> Column:
    """Lower-case and split on Unicode whitespace, dropping empty tokens."""
    return F.filter(F.split(F.lower(_c(text)), r"(?U)\s+"), lambda w: w != F.lit(""))


def word_bucket(word, dims: int = EMBED_DIMS) -> Column:
    """MD5 of the UTF-8 word read as a 128-bit integer, modulo ``dims``.

    For a power-of-two ``dims`` <= 4096 the low 12 bits decide the result, so the last three
    hex digits are enough (checked against the full 128-bit modulus).
    """
    if dims & (dims - 1) or dims > 4096:
        raise ValueError("dims must be a power of two <= 4096")
    return (F.conv(F.substring(F.md5(_c(word)), 30, 3), 16, 10).cast("int") % F.lit(dims))
