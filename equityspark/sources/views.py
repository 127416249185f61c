"""Operator inputs derived from the test tables (see FIXTURES.md part 2).

Everything is a lazy DataFrame over the whole parquet tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions.core import attach_row, pct
from equityspark.sources.readers import resample_ohlcv

BENCHMARK = "S0000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key) -> F.Column:
    return F.format_string("S%04d", key)


def trades_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        (100.0 + F.col("l_extendedprice") / F.col("l_quantity") / 10000.0).alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


# Digits of what orders the trades of a day.
TRADE_SEQ = [("l_orderkey", 16), ("l_linenumber", 2), ("l_partkey", 13)]


SERIES_ROWS = 250_000  # trades behind one partition of series


def bars(spark: SparkSession, sf_dir: str, interval: str = "1d") -> DataFrame:
    """Daily (or coarser) OHLCV bars: one partial aggregation on (ticker, date).

    What works on series sorts a partition in one task. When the session's shuffle partitions would hold more than
    ``SERIES_ROWS`` trades each, the bars are dealt by ticker into more, so a task's memory does not grow with the table.
    """
    raw = trades_raw(spark, sf_dir)
    out = resample_ohlcv(raw, ["l_suppkey"], "date", "price", "qty", TRADE_SEQ, interval)
    out = out.select(ticker_of(F.col("l_suppkey")).alias("ticker"), "date", "open", "high", "low", "close", "volume")
    parts = -(-table(spark, sf_dir, "lineitem").count() // SERIES_ROWS)
    return out.repartition(parts, "ticker") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else out


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where(F.col("ticker") == BENCHMARK)


def instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            ticker_of(F.col("s_suppkey")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.col("s_acctbal").alias("market_cap"),
        )
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'all' holds every instrument, 'large_cap' those with market_cap above 5000."""
    base = instrument(spark, sf_dir).select("ticker", "sector", "market_cap")
    names = F.when(F.col("market_cap") > 5000, F.array(F.lit("all"), F.lit("large_cap"))).otherwise(F.array(F.lit("all")))
    return base.select(F.explode(names).alias("universe"), "sector", "ticker")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ratios per instrument; fractions, as the scoring rules expect."""
    k = F.col("s_suppkey")

    def step(a: int, m: int, shift: float = 0.0, scale: float = 1.0):
        return (F.pmod(k * a, F.lit(m)).cast("double") + shift) / scale

    de = F.when(F.pmod(k, F.lit(2)) == 0, step(19, 250, 0.0, 100.0)).otherwise(step(19, 250))
    return table(spark, sf_dir, "supplier").select(
        ticker_of(k).alias("ticker"),
        F.when(F.pmod(k, F.lit(11)) != 0, step(37, 60, 5.0)).alias("pe_ratio"),
        F.when(F.pmod(k, F.lit(13)) != 0, step(29, 300, 0.0, 100.0)).alias("peg_ratio"),
        step(17, 80, 0.0, 10.0).alias("price_to_book"),
        step(13, 60, 0.0, 1000.0).alias("dividend_yield"),
        step(7, 40, -5.0, 100.0).alias("profit_margin"),
        step(11, 45, -5.0, 100.0).alias("roe"),
        F.when(F.pmod(k, F.lit(17)) != 0, de).alias("debt_to_equity"),
        step(23, 60, -15.0, 100.0).alias("revenue_growth"),
        step(31, 70, -20.0, 100.0).alias("earnings_growth"),
        step(41, 300, 0.0, 100.0).alias("current_ratio"),
    )


def instrument_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_inst"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the whole text is the headline text."""
    d = table(spark, sf_dir, "documents")
    return attach_row(d, instrument_count(spark, sf_dir)).select(
        F.col("doc_id").alias("article_id"),
        ticker_of(F.pmod(F.col("doc_id"), F.col("n_inst"))).alias("ticker"),
        F.col("text").alias("title"),
        F.col("source").alias("publisher"),
        F.timestamp_seconds(F.lit(789004800) + F.pmod(F.col("doc_id") * 7919, F.lit(2500)) * 86400).alias("published"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as social posts; every post occurs twice, the copy with fewer likes."""
    e = table(spark, sf_dir, "events")
    platform = F.element_at(
        F.create_map(*[F.lit(x) for p in PLATFORM_OF.items() for x in p]), F.col("event_type")
    )
    comments = F.get_json_object("props", "$.k").cast("long")
    base = e.select(
        platform.alias("platform"),
        F.col("event_id").alias("id"),
        ticker_of(F.col("user_id")).alias("ticker"),
        F.concat(F.lit("$"), ticker_of(F.col("user_id")), F.lit(" "), F.col("event_type")).alias("text"),
        F.floor("value").cast("long").alias("likes"),
        comments.alias("comments"),
        F.lit(0).cast("long").alias("shares"),
        F.col("ts"),
    )
    copies = F.explode(F.array(F.lit(0), F.lit(1)))
    return (
        base.select("*", copies.alias("copy"))
        .withColumn("likes", F.col("likes") - F.col("copy"))
        .withColumn("id", F.when(F.col("comments") != 13, F.col("id")))
    )


# How the five event kinds stand in for the four platforms.
PLATFORM_OF = {"view": "twitter", "click": "reddit", "signup": "tiktok", "purchase": "instagram", "error": "twitter"}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rule models over bar indicators, in long form (ticker, date, model)."""
    close = F.col("close")
    b = bars(spark, sf_dir).select("ticker", "date", "close")
    b = b.withColumns(
        {
            "rsi": ind.rsi(close),
            "s20": ind.sma(close, 20),
            "s50": ind.sma(close, 50),
            "r5": ind.lag_return(close, 5) * 100.0,
        }
    ).where(F.col("s50").isNotNull() & F.col("rsi").isNotNull())
    spread = pct(F.col("s20"), F.col("s50"))
    tilt = 50.0 - F.col("rsi")

    def model(name: str, x, flat: float, conf, ret):
        direction = F.when(x > flat, "bullish").when(x < -flat, "bearish").otherwise("neutral")
        return F.struct(
            F.lit(name).alias("model"),
            direction.alias("direction"),
            F.least(F.lit(100.0), conf).alias("confidence"),
            ret.alias("expected_return"),
        )

    rows = F.array(
        model("rsi", tilt, 2.0, 50.0 + F.abs(tilt), tilt / 5.0),
        model("trend", spread, 0.0, 50.0 + F.abs(spread) * 25.0, spread * 4.0),
        model("momentum", F.col("r5"), 0.25, 50.0 + F.abs(F.col("r5")) * 10.0, F.col("r5")),
    )
    return b.select("ticker", "date", F.explode(rows).alias("m")).select("ticker", "date", "m.*")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.array(F.lit("buy"), F.lit("hold"), F.lit("sell"))
    return e.select(
        F.col("event_id"),
        ticker_of(F.col("user_id")).alias("ticker"),
        F.col("event_type").alias("source"),
        F.get(kinds, F.pmod(F.floor("value"), F.lit(3)).cast("int")).alias("recommendation"),
        F.col("ts"),
    )


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        "event_type",
        F.concat(F.lit("A"), F.pmod(F.col("event_id"), F.lit(5)).cast("string")).alias("source_agent"),
        ticker_of(F.col("user_id")).alias("ticker"),
        F.col("value"),
        F.col("props").alias("data"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600)
    return v.select(
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("ticker"),
        ts.alias("ts"),
        F.to_date(ts).alias("date"),
        F.concat(F.lit("analysis "), F.col("vec_id").cast("string")).alias("summary"),
        "embedding",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def global_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated world events; most fall between the benchmark's trading days."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("global_id"),
        F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("event "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("impact"),
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as reporting dates of the instrument the customer maps to."""
    o = table(spark, sf_dir, "orders")
    return attach_row(o, instrument_count(spark, sf_dir)).select(
        ticker_of(F.pmod(F.col("o_custkey"), F.col("n_inst"))).alias("ticker"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("reported"),
        (F.col("o_orderstatus") == "O").alias("upcoming"),
    )


def sentiment_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON sentiment document per event (several per ticker and day)."""
    e = table(spark, sf_dir, "events")
    moods = F.array(F.lit("Positive"), F.lit(" neutral "), F.lit("BEARISH"), F.lit("odd"))
    trends = F.array(F.lit("improving"), F.lit("stable"), F.lit("Deteriorating"))

    def mood(shift: int):
        return F.struct(F.get(moods, F.pmod(F.col("event_id") + shift, F.lit(4)).cast("int")).alias("sentiment"))

    body = F.to_json(
        F.struct(
            F.struct(
                F.pmod(F.col("event_id") * 7, F.lit(101)).alias("score"),
                F.floor("value").alias("confidence"),
            ).alias("overall_sentiment"),
            F.struct(
                mood(0).alias("macro_news"),
                mood(1).alias("company_expected_revenue_news"),
                mood(2).alias("company_specific_news"),
                mood(3).alias("industry_peer_news"),
            ).alias("news_sections"),
            F.struct(F.get(trends, F.pmod(F.col("event_id"), F.lit(3)).cast("int")).alias("trend")).alias("sentiment_trend"),
            F.get_json_object("props", "$.k").cast("long").alias("news_count"),
        )
    )
    return e.select(
        ticker_of(F.col("user_id")).alias("ticker"),
        F.to_date("ts").alias("date"),
        "ts",
        "event_id",
        body.alias("body"),
    )


def tick_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five long series: each agent's events as ticks, a fifth of all events in one series."""
    e = agent_events(spark, sf_dir)
    v = F.col("value")
    return e.select(
        F.col("source_agent").alias("ticker"), F.col("ts").alias("date"), v.alias("open"), (v + 1.0).alias("high"),
        v.alias("low"), v.alias("close"), (1.0 + F.pmod("event_id", F.lit(7))).alias("volume"))
