"""Local twin of the driver's correctness gate: each Spark query vs its DuckDB oracle.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares column names, types, row counts and order-insensitive values (floats to 9 digits).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from flowlens.sources.tables import TABLES  # noqa: E402

SPARK2DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
              "tinyint": "TINYINT"}


def norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": True, "rows": len(s_rows), "check": "rows-only", "sec": round(t1 - t0, 2)}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        for c, st in zip(s_cols, s_types):
            dt = d_types[d_cols.index(c)]
            want = SPARK2DUCK.get(st, st.upper())
            if want != dt and not (st.startswith("array") and dt.endswith("[]")):
                problems.append(f"type {c}: spark={st} duck={dt}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif not problems:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        a = sorted(tuple(norm(r[i]) for i in si) for r in s_rows)
        b = sorted(tuple(norm(r[i]) for i in di) for r in d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return {"name": name, "ok": not problems, "rows": len(s_rows), "check": "oracle", "sec": round(t1 - t0, 2),
            "problems": problems}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    from flowlens.plans.registry import all_oracles, all_queries
    from flowlens.session import get_spark
    spark = get_spark("local[8]", 8)
    qs, oracles = all_queries(), all_oracles()
    con = duck_con(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        try:
            res = compare(spark, con, name, qs[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and continue
            res = {"name": name, "ok": False, "problems": [f"{type(e).__name__}: {str(e)[:400]}"]}
        bad += not res["ok"]
        print(("OK  " if res["ok"] else "BAD ") + name, res.get("rows"), res.get("check", ""), res.get("sec", ""),
              "" if res["ok"] else res["problems"], flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
