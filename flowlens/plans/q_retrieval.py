"""Knowledge-base chunks, embeddings, retrieval, prompt context, sampling and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import retrieval as RT
from flowlens.operators.chunks import build_chunks
from flowlens.plans.registry import query
from flowlens.plans.sql_text import daily_kb_sql, embed_cte, kb_cte, topn_cte
from flowlens.plans.sqlbase import with_flows
from flowlens.session import scratch_path
from flowlens.sources.tables import flows, load

REPORT_QUERIES = RT.REPORT_QUERIES


@query("kb_chunks", with_flows("SELECT chunk_id, kind, text FROM kb", extra=kb_cte()))
def q_kb_chunks(spark, sf):
    return build_chunks(flows(spark, sf))


@query("kb_chunks_daily", with_flows(daily_kb_sql()))
def q_kb_chunks_daily(spark, sf):
    from flowlens.operators.chunks import build_daily_chunks
    return build_daily_chunks(flows(spark, sf))


@query("chunk_embedding", "WITH " + embed_cte("e", "documents", "doc_id")
       + "\nSELECT id AS doc_id, dim, round(weight, 9) AS weight FROM e", headline=True)
def q_chunk_embedding(spark, sf):
    e = RT.embed(load(spark, sf, "documents"), "doc_id", "text")
    return e.withColumn("weight", F.round("weight", 9))


@query("index_reuse", "WITH " + embed_cte("e", "benchmark", "item_id") + """
SELECT step, n, dims, weights FROM (SELECT count(*) AS n, count(DISTINCT dim) AS dims, round(sum(weight), 6) AS weights FROM e),
 (VALUES ('built'), ('reused')) AS t(step)""")
def q_index_reuse(spark, sf):
    # The stored index built, then found again by its fingerprint; both reads give the same entries.
    path = scratch_path(spark, "index")
    items = load(spark, sf, "benchmark")

    def read(step):
        return RT.build_index(items, "item_id", "text", path).agg(
            F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"), F.count_distinct("dim").alias("dims"),
            F.round(F.sum("weight"), 6).alias("weights"))
    return read("built").unionByName(read("reused"))


def _doc_hits(spark, sf, n=4):
    docs = load(spark, sf, "documents")
    index = RT.embed_rows(docs, "doc_id", "text")
    qs = RT.embed_rows(load(spark, sf, "benchmark").withColumnRenamed("item_id", "qid"), "qid", "text")
    return RT.retrieve(qs, index, n, id_col="doc_id", ids=docs), docs


_TOPN = ("WITH " + embed_cte("ei", "documents", "doc_id") + ",\n" + embed_cte("eq", "benchmark", "item_id") + ",\n"
         + topn_cte("top", "eq", "ei", "SELECT doc_id AS id FROM documents", "SELECT DISTINCT id AS qid FROM eq", 4))


@query("retrieve_topn", _TOPN + "\nSELECT qid, rank, id AS doc_id, round(score, 6) AS score FROM top", headline=True)
def q_retrieve_topn(spark, sf):
    hits, _ = _doc_hits(spark, sf)
    return hits.withColumn("score", F.round("score", 6))


@query("prompt_context", _TOPN + """
SELECT t.qid, string_agg(substring(d.text, 1, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY t.rank)
 AS context FROM top t JOIN documents d ON t.id = d.doc_id GROUP BY t.qid""")
def q_prompt_context(spark, sf):
    hits, docs = _doc_hits(spark, sf)
    return RT.context(hits, docs, "doc_id", cut=800)


@query("recent_turns", """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
 ORDER BY turn DESC) AS pos FROM conversations) WHERE pos <= 6""")
def q_recent_turns(spark, sf):
    return RT.recent_turns(load(spark, sf, "conversations"), 6)


def _report_ctx_sql():
    qs = ", ".join(f"({i}, '{t}')" for i, t in enumerate(REPORT_QUERIES))
    return with_flows(
        "SELECT f.first_pos, f.chunk_id, kb.kind, substring(kb.text, 1, 600) AS piece FROM (SELECT id AS chunk_id,"
        " CAST(min(qid * 4 + rank) AS BIGINT) AS first_pos FROM top GROUP BY id ORDER BY first_pos, chunk_id LIMIT 12) f"
        " JOIN kb ON kb.chunk_id = f.chunk_id",
        extra=kb_cte() + f",\nrq AS (SELECT * FROM (VALUES {qs}) AS t(qid, text)),\n" + embed_cte("ei", "kb", "chunk_id")
        + ",\n" + embed_cte("eq", "rq", "qid") + ",\n"
        + topn_cte("top", "eq", "ei", "SELECT chunk_id AS id FROM kb", "SELECT DISTINCT id AS qid FROM eq", 3))


@query("report_context", _report_ctx_sql())
def q_report_context(spark, sf):
    return RT.report_context(build_chunks(flows(spark, sf)))


@query("sample_rows", with_flows("""SELECT * FROM flows ORDER BY md5(CAST(flow_id AS VARCHAR) || '|42'), flow_id
 LIMIT 300"""))
def q_sample_rows(spark, sf):
    return RT.sample_rows(flows(spark, sf), "flow_id", 300, 42)


# Stratified by label: rank in MD5 order within the label.
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY is_deny ORDER BY md5(CAST(flow_id AS VARCHAR) || '|42'), flow_id) - 1 AS rk,
 count(*) OVER (PARTITION BY is_deny) AS n_label FROM (SELECT *, CAST(action = 'Deny' AS INTEGER) AS is_deny FROM flows))"""


def _labelled(spark, sf):
    return flows(spark, sf).withColumn("is_deny", (F.col("action") == "Deny").cast("int"))


@query("train_test_split", with_flows("""SELECT CASE WHEN rk * 100 < n_label * 70 THEN 'train' ELSE 'test' END AS split, is_deny,
 count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS id_sum FROM ranked GROUP BY 1, 2""", extra=_RANKED))
def q_train_test_split(spark, sf):
    s = RT.split_label(_labelled(spark, sf), "flow_id", 70, 42, label="is_deny")
    return s.groupBy("split", "is_deny").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("id_sum"))


@query("cv_folds", with_flows("""SELECT CAST(rk % 5 AS INTEGER) AS fold, is_deny, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS id_sum
 FROM ranked GROUP BY 1, 2""", extra=_RANKED))
def q_cv_folds(spark, sf):
    f = RT.folds(_labelled(spark, sf), "flow_id", 5, 42, label="is_deny")
    return f.groupBy("fold", "is_deny").agg(F.count(F.lit(1)).alias("n"), F.sum("flow_id").alias("id_sum"))



_FP_COLS = ("flow_id", "date", "ip_source", "ip_destination", "protocol", "source_port", "dest_port", "rule_id",
            "action", "interface_in", "interface_out")


def _fp_sql():
    parts = []
    for c in _FP_COLS:
        e = "CAST(epoch_us(date) AS VARCHAR)" if c == "date" else f"CAST({c} AS VARCHAR)"
        parts.append(f"coalesce({e}, '\\N')")
    row = "concat_ws('|', " + ", ".join(parts) + ")"
    return with_flows(f"SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fp_md5"
                      " FROM flows")


@query("dataset_fingerprint", _fp_sql())
def q_dataset_fingerprint(spark, sf):
    return RT.fingerprint(flows(spark, sf), list(_FP_COLS)).select("n_rows", "fp_md5")
