"""SQL surface: temporary SQL functions whose bodies Catalyst inlines (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from flowlens.functions.scalar import EMBED_DIMS, PORT_CATEGORY_LABELS


def register_functions(spark: SparkSession) -> list[str]:
    """Create ``port_category(port)``, ``port_bucket(port)``, ``word_bucket(word)`` for SQL users."""
    sys_l, usr_l, dyn_l = PORT_CATEGORY_LABELS
    stmts = {
        "port_category": f"""CREATE OR REPLACE TEMPORARY FUNCTION port_category(port INT) RETURNS STRING
            RETURN CASE WHEN port IS NULL THEN NULL WHEN port < 1024 THEN '{sys_l}'
                        WHEN port < 49152 THEN '{usr_l}' ELSE '{dyn_l}' END""",
        "port_bucket": """CREATE OR REPLACE TEMPORARY FUNCTION port_bucket(port INT) RETURNS INT
            RETURN CASE WHEN port IS NULL THEN NULL WHEN port <= 1023 THEN 0
                        WHEN port <= 49151 THEN 1 ELSE 2 END""",
        "word_bucket": f"""CREATE OR REPLACE TEMPORARY FUNCTION word_bucket(w STRING) RETURNS INT
            RETURN CAST(conv(substring(md5(w), 30, 3), 16, 10) AS INT) % {EMBED_DIMS}""",
    }
    for sql in stmts.values():
        spark.sql(sql)
    return list(stmts)
