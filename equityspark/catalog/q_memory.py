"""Report store, session and vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.registry import query
from equityspark.catalog.util import keep
from equityspark.operators import memory
from equityspark.sources import views


@query("a12_store_lookup", "SELECT doc_id, ticker, ts, summary FROM analyses WHERE summary = 'analysis 7'")
def a12(spark, d):
    return views.analyses(spark, d).where(F.col("summary") == "analysis 7").select("doc_id", "ticker", "ts", "summary")


@query("h29_document_id", "SELECT doc_id, upper(ticker) || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS document_id FROM analyses")
def h29(spark, d):
    return views.analyses(spark, d).select("doc_id", memory.document_id(F.col("ticker"), F.col("ts")).alias("document_id"))


@query("f05_past_analyses", """SELECT ticker, doc_id, ts, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, doc_id DESC) AS k
    FROM analyses WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY) WHERE k <= 5""")
def f05(spark, d):
    return memory.past_analyses(views.analyses(spark, d), 5, 30, "2024-02-01 00:00:00").select("ticker", "doc_id", "ts", "rank")


@query("f06_all_reports", "SELECT doc_id, ticker, ts, summary FROM analyses")
def f06(spark, d):
    return memory.all_reports(views.analyses(spark, d)).select("doc_id", "ticker", "ts", "summary")


@query("d31_store_stats", "SELECT count(*) AS total_documents FROM analyses")
def d31(spark, d):
    return memory.store_stats(views.analyses(spark, d))


@query("k03_metadata_filter", "SELECT doc_id, ts FROM analyses WHERE ticker = 'L3' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def k03(spark, d):
    a = views.analyses(spark, d)
    return a.where((F.col("ticker") == "L3") & F.col("date").between("2024-01-05", "2024-01-20")).select("doc_id", "ts")


@query("b30_message_filter", "SELECT conv_id, turn, content FROM messages WHERE role = 'assistant'")
def b30(spark, d):
    return memory.filter_messages(views.messages(spark, d), role="assistant").select("conv_id", "turn", "content")


@query("f11_last_messages", "SELECT conv_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM messages) WHERE k <= 6")
def f11(spark, d):
    return memory.last_messages(views.messages(spark, d), 6).select("conv_id", "turn", "role", "content")


@query("h31_message_render", "SELECT conv_id, turn, '[' || role || '] ' || substr(content, 1, 200) AS line, '[' || role || '] ' || content AS whole FROM messages")
def h31(spark, d):
    m = views.messages(spark, d)
    return m.select("conv_id", "turn", memory.render(F.col("role"), F.col("content"), 200).alias("line"), memory.render(F.col("role"), F.col("content")).alias("whole"))


@query("g04_scratchpad", """SELECT ticker, arg_max(recommendation, ROW(ts, event_id)) AS recommendation, arg_max(source, ROW(ts, event_id)) AS source, max(ts) AS ts FROM recommendations GROUP BY ticker""")
def g04(spark, d):
    e = views.recommendations(spark, d)
    return memory.scratchpad(e, ["ticker"], ["ts", "event_id"]).select("ticker", "recommendation", "source", "ts")


def _newest(spark, d):
    return views.analyses(spark, d).orderBy(F.desc("ts"), F.desc("doc_id")).select("embedding").first()["embedding"]


_Q = "(SELECT embedding AS q FROM analyses ORDER BY ts DESC, doc_id DESC LIMIT 1)"


@query("k01_semantic_search", f"SELECT doc_id, ticker, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM analyses, {_Q} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, doc_id LIMIT 10")
def k01(spark, d):
    return keep(memory.semantic_search(views.analyses(spark, d), _newest(spark, d), 10), "doc_id", "ticker", "similarity")


@query("k01_semantic_search_l2", f"SELECT doc_id, ticker, round(1 - pow(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 2), 6) AS similarity FROM analyses, {_Q} WHERE ticker = 'L4' ORDER BY 3 DESC, doc_id LIMIT 5")
def k01_l2(spark, d):
    return keep(memory.semantic_search(views.analyses(spark, d), _newest(spark, d), 5, "L4", "l2sq"), "doc_id", "ticker", "similarity")


oracle.define("vec_queries", "SELECT max(doc_id) AS query_id, arg_max(embedding, doc_id) AS query_vec FROM analyses GROUP BY ticker")


@query("k02_batch_search", """SELECT query_id, doc_id, round(s, 6) AS similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS k
    FROM (SELECT query_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], query_vec::DOUBLE[]), 12) AS s FROM analyses, vec_queries)) WHERE k <= 5""")
def k02(spark, d):
    a = views.analyses(spark, d)
    q = a.groupBy("ticker").agg(F.max("doc_id").alias("query_id"), F.max_by("embedding", "doc_id").alias("query_vec"))
    return keep(memory.batch_search(a, q, 5), "query_id", "doc_id", "similarity", "rank")
