"""Stored reports, sessions and vector search (ids A12, A14, B30, D31, F5, F6, F11, G4, H29, H31, K1-K3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions.core import latest_per, top_n


def document_id(ticker: Column, ts: Column) -> Column:
    return F.concat_ws("_", F.upper(ticker), F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "HHmmss"))


def past_analyses(analyses: DataFrame, n: int, days_back: int | None = None, as_of: str | None = None) -> DataFrame:
    """Newest ``n`` reports per ticker, optionally only the last ``days_back`` days."""
    rows = analyses
    if days_back is not None:
        end = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        rows = rows.where(F.col("ts") >= end - F.make_dt_interval(F.lit(days_back)))
    return top_n(rows, ["ticker"], [F.desc("ts"), F.desc("doc_id")], n, "rank")


def all_reports(analyses: DataFrame) -> DataFrame:
    return analyses.orderBy(F.desc("ts"), F.desc("doc_id"))


def store_stats(analyses: DataFrame) -> DataFrame:
    return analyses.agg(F.count("*").alias("total_documents"))


def filter_messages(messages: DataFrame, role: str | None = None, agent: str | None = None) -> DataFrame:
    if role is not None:
        messages = messages.where(F.col("role") == role)
    return messages.where(F.col("agent") == agent) if agent is not None else messages


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """Last ``n`` messages of each conversation; present them by turn."""
    return top_n(messages, ["conv_id"], [F.desc("turn")], n, "from_end")


def render(agent: Column, content: Column, limit: int | None = None) -> Column:
    text = F.substring(content, 1, limit) if limit else content
    return F.concat(F.lit("["), agent, F.lit("] "), text)


def scratchpad(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key."""
    rest = [c for c in entries.columns if c not in keys]
    return latest_per(entries, keys, F.struct(*order), rest)


def session_json(messages: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Each conversation as JSON lines (conv_id, part, turn, body), at any length.

    Part 0 is one line of metadata (number of messages, first and last turn), part 1 one
    line per scratchpad entry of ``notes`` (conv_id, key, value), part 2 one line per
    message. Sorted by (part, turn) the lines of a conversation are its session file; no
    conversation is gathered into one value. Messages repeat their turn if the turn repeats.
    """
    meta = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    out = meta.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.to_json(F.struct("conv_id", "messages", "first_turn", "last_turn")).alias("body"))
    if notes is not None:
        out = out.unionByName(notes.select("conv_id", F.lit(1).alias("part"), F.lit(None).cast("long").alias("turn"), F.to_json(F.struct("key", "value")).alias("body")))
    lines = messages.select("conv_id", F.lit(2).alias("part"), F.col("turn").cast("long").alias("turn"), F.to_json(F.struct("turn", "role", "content")).alias("body"))
    return out.unionByName(lines)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine", norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - distance: cosine similarity, or 1 - squared distance for ``l2sq``."""
    if metric == "cosine":
        return F.try_divide(_dot(a, b), (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b)))
    if metric == "l2sq":
        parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
        return 1.0 - F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    raise ValueError(f"unknown metric {metric!r}")


def semantic_search(analyses: DataFrame, query: list[float], k: int = 5, ticker: str | None = None, metric: str = "cosine") -> DataFrame:
    """Top ``k`` reports for one query vector: one scan, ``k`` rows per task, no shuffle of vectors."""
    rows = analyses if ticker is None else analyses.where(F.col("ticker") == ticker)
    vec = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("similarity", similarity(F.col("embedding"), vec, metric))
    return scored.orderBy(F.desc("similarity"), "doc_id").limit(k)


def batch_search(analyses: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", block: int = 4096, chunk: int = 8192) -> DataFrame:
    """Top ``k`` reports for each row of ``queries`` (query_id long, query_vec).

    A blocked product: Spark deals reports into chunks of about ``chunk`` and queries into
    blocks of about ``block`` rows by hash of their ids, sends every (chunk, block) pair to
    one group and keeps the best k per query there; a final top-k merges the chunks. Both
    tables are read a fixed number of times, whatever the number of queries, and none of
    their rows passes the driver. Ids are unique. Similarities are rounded to 12 digits so that equal
    vectors tie and go by doc_id; vectors that are null or of other length than the query's
    have no similarity to it.
    """
    if metric not in ("cosine", "l2sq"):
        raise ValueError(f"unknown metric {metric!r}")
    reports = analyses.select("doc_id", "embedding").where(F.col("embedding").isNotNull())
    asked = queries.select("query_id", "query_vec").where(F.col("query_vec").isNotNull())
    blocks, chunks = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (reports, chunk)))

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumns({own: F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})

    left = dealt(reports, "doc_id", "_chunk", chunks, "_block", blocks).groupBy("_chunk", "_block")
    right = dealt(asked, "query_id", "_block", blocks, "_chunk", chunks).groupBy("_chunk", "_block")
    best = left.cogroup(right).applyInPandas(_best_per_query(k, metric), BEST_SCHEMA)
    return top_n(best, ["query_id"], [F.desc("similarity"), F.asc("doc_id")], k, "rank")


BEST_SCHEMA = "query_id long, doc_id long, similarity double"
SLICE = 1 << 22  # similarities held at a time


def _best_per_query(k: int, metric: str):
    """Best ``k`` reports of a chunk for every query of a block, a few queries at a time."""

    def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (q @ x.T) / (np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :])
            return np.where(np.isfinite(s), s, -np.inf)
        return 1.0 - ((q**2).sum(1)[:, None] - 2.0 * (q @ x.T) + (x**2).sum(1)[None, :])

    def best(reports: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = [frame.map(len).to_numpy(dtype="int64") for frame in (reports["embedding"], asked["query_vec"])] if len(reports) and len(asked) else [np.zeros(0), np.zeros(0)]
        for n in np.intersect1d(*lengths):
            x, own = reports[lengths[0] == n], asked[lengths[1] == n]
            docs, ids = x["doc_id"].to_numpy(dtype="int64"), own["query_id"].to_numpy(dtype="int64")
            x, q = (np.stack(v.to_numpy()).astype("float64") for v in (x["embedding"], own["query_vec"]))
            step = max(1, SLICE // len(docs))
            for a in range(0, len(ids), step):
                s = np.round(product(q[a: a + step], x), 12)
                order = np.lexsort((np.broadcast_to(docs, s.shape), -s), axis=1)[:, :k]
                s = np.take_along_axis(s, order, 1)
                out.append(pd.DataFrame({"query_id": np.repeat(ids[a: a + step], s.shape[1]), "doc_id": docs[order].ravel(), "similarity": s.ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, "int64"), "doc_id": np.zeros(0, "int64"), "similarity": np.zeros(0)})
        return found[np.isfinite(found["similarity"])]

    return best
