"""Scan, resampling, period and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.registry import query
from equityspark.catalog.util import keep, r
from equityspark.operators import quality, text
from equityspark.functions import indicators as ind
from equityspark.plans import stock_record, training_set
from equityspark.sources import readers, sinks, views

OHLCV = ["open", "high", "low", "close", "volume"]


@query("a01_price_scan", f"SELECT ticker, date, {r(*OHLCV)} FROM bars WHERE ticker IN ('S0001', 'S0003', 'S0007')")
def a01(spark, d):
    return keep(readers.scan_prices(views.bars(spark, d), ["S0001", "S0003", "S0007"]), "ticker", "date", *OHLCV)


def _resample_sql(start: str) -> str:
    return f"""SELECT ticker, CAST({start} AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
      arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2"""


@query("a02_daily_bars", f"SELECT ticker, date, {r(*OHLCV)} FROM bars")
def a02(spark, d):
    return keep(views.bars(spark, d), "ticker", "date", *OHLCV)


for _name, _interval, _start in (("week", "1wk", "date_trunc('week', date)"), ("month", "1mo", "date_trunc('month', date)"), ("quarter", "3mo", "date_trunc('quarter', date)")):
    query(f"a02_{_name}_bars", _resample_sql(_start))(
        lambda spark, d, i=_interval: keep(readers.resample_bars(views.bars(spark, d), i), "ticker", "date", *OHLCV)
    )


@query("a02_hour_bars", """SELECT printf('S%04d', user_id) AS ticker, date_trunc('hour', ts) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def a02_hour(spark, d):
    ticks = views.agent_events(spark, d).select("ticker", "ts", "value", F.lit(1).cast("long").alias("qty"), "event_id")
    return keep(readers.resample_ohlcv(ticks, ["ticker"], "ts", "value", "qty", "event_id", "1h"), "ticker", "date", *OHLCV)


@query("a04_source_fallback", """SELECT ticker, date, close AS close, CASE WHEN ticker IN (SELECT ticker FROM heavy GROUP BY ticker HAVING count(*) >= 200) THEN 'primary' ELSE 'secondary' END AS feed FROM (
    SELECT * FROM heavy WHERE ticker IN (SELECT ticker FROM heavy GROUP BY ticker HAVING count(*) >= 200)
    UNION ALL SELECT * FROM bars WHERE ticker NOT IN (SELECT ticker FROM heavy GROUP BY ticker HAVING count(*) >= 200) AND ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 200))""")
def a04(spark, d):
    b = views.bars(spark, d)
    primary = b.where("volume > 31").withColumn("feed", F.lit("primary"))
    return keep(readers.with_fallback(primary, b.withColumn("feed", F.lit("secondary")), 200), "ticker", "date", "close", "feed")


oracle.define("heavy", "SELECT * FROM bars WHERE volume > 31")


@query("a06_upsert_sentiment", """SELECT ticker, date, event_id, round(news_sentiment_score, 6) AS news_sentiment_score FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ts DESC, event_id DESC) AS k FROM sent_feat) WHERE k = 1""")
def a06(spark, d):
    f = text.sentiment_features(views.sentiment_raw(spark, d), "body").drop("body")
    split = F.pmod("event_id", F.lit(2)) == 0
    return keep(sinks.upsert(f.where(split), f.where(~split), ["ticker", "date"], ["ts", "event_id"]), "ticker", "date", "event_id", "news_sentiment_score")


@query("a09_earnings_calendar", """SELECT ticker, date, false AS upcoming, 'earnings' AS type, round(reported, 6) AS reported FROM earnings WHERE NOT upcoming
    UNION ALL SELECT ticker, min(date), true, 'earnings', NULL FROM earnings WHERE upcoming GROUP BY ticker""")
def a09(spark, d):
    e = views.earnings(spark, d)
    out = readers.earnings_calendar(e.where("NOT upcoming").drop("upcoming"), e.where("upcoming"))
    return keep(out, "ticker", "date", "upcoming", "type", "reported")


@query("a10_csv_export", """SELECT b.ticker, b.date, b.close AS close, round(l.f5, 6) AS forward_5d_return, i.sector FROM bars b JOIN
    (SELECT ticker, date, (lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) - close) / close * 100 AS f5 FROM bars) l ON l.ticker = b.ticker AND l.date = b.date
    LEFT JOIN instrument i ON i.ticker = b.ticker WHERE f5 IS NOT NULL""")
def a10(spark, d):
    e = training_set.export_frame(views.bars(spark, d), views.instrument(spark, d))
    return keep(e, "ticker", "date", "close", "forward_5d_return", "sector")


@query("b01_date_range", f"SELECT ticker, date, {r('close')} FROM bars WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-06-30'")
def b01(spark, d):
    return keep(readers.date_range(views.bars(spark, d), "1997-03-01", "1998-06-30"), "ticker", "date", "close")


_PERIODS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825, "max": 3650}


@query("b02_period_start", " UNION ALL ".join(f"SELECT '{p}' AS period, m - {n} AS start_date, count(*) FILTER (date >= m - {n}) AS n_rows FROM bars, (SELECT max(date) AS m FROM bars) GROUP BY m" for p, n in _PERIODS.items()))
def b02(spark, d):
    b = views.bars(spark, d)
    end = b.agg(F.max("date").alias("_end"))
    from equityspark.functions.core import attach_row

    j = attach_row(b.select("date"), end)
    periods = F.array(*[F.struct(F.lit(p).alias("period"), readers.period_start(F.col("_end"), p).alias("start_date")) for p in _PERIODS])
    per_day = j.groupBy("date", "_end").agg(F.count("*").alias("c")).select("date", "c", F.explode(periods).alias("p"))
    return per_day.groupBy("p.period", "p.start_date").agg(F.sum(F.when(F.col("date") >= F.col("p.start_date"), F.col("c")).otherwise(0)).alias("n_rows"))


@query("b03_warmup_range", f"SELECT ticker, date, {r('sma_50')} FROM (SELECT ticker, date, CASE WHEN count(*) OVER w = 50 THEN avg(close) OVER w END AS sma_50 FROM bars WHERE date >= DATE '1998-01-01' - 100 AND date <= DATE '1998-12-31' WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)) WHERE date >= DATE '1998-01-01'")
def b03(spark, d):
    b = readers.warmup_range(views.bars(spark, d), "1998-01-01", "1998-12-31").withColumn("sma_50", ind.sma(F.col("close"), 50))
    return keep(readers.date_range(b, "1998-01-01"), "ticker", "date", "sma_50")


@query("b04_min_history", "SELECT ticker, date FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 530)")
def b04(spark, d):
    return readers.min_history(views.bars(spark, d), 530).select("ticker", "date")


@query("b21_sanitize", "SELECT ticker, date, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE round(x, 6) END AS x FROM (SELECT ticker, date, CASE WHEN volume < 10 THEN 'nan'::DOUBLE WHEN volume < 20 THEN 'inf'::DOUBLE WHEN volume < 30 THEN '-inf'::DOUBLE ELSE close END AS x FROM bars)")
def b21(spark, d):
    v, close = F.col("volume"), F.col("close")
    x = F.when(v < 10, F.lit(float("nan"))).when(v < 20, F.lit(float("inf"))).when(v < 30, F.lit(float("-inf"))).otherwise(close)
    return keep(quality.sanitize(views.bars(spark, d).select("ticker", "date", x.alias("x"))), "ticker", "date", "x")


@query("d01_store_summary", "SELECT count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars")
def d01(spark, d):
    return training_set.summary(views.bars(spark, d))


@query("d01_tickers_per_sector", "SELECT sector, count(*) AS n_tickers FROM (SELECT DISTINCT ticker FROM bars) LEFT JOIN instrument USING (ticker) GROUP BY sector")
def d01_sectors(spark, d):
    return training_set.tickers_per_sector(views.bars(spark, d), views.instrument(spark, d))


SUMMARY = ["latest_price", "period_high", "period_low", "price_change", "price_change_percent"]


@query("d02_period_summary", """SELECT ticker, count(*) AS data_points, min(date) AS start_date, max(date) AS end_date, arg_max(close, date) AS latest_price, CAST(arg_max(volume, date) AS BIGINT) AS latest_volume,
    max(high) AS period_high, min(low) AS period_low, round(arg_max(close, date) - arg_min(close, date), 6) AS price_change,
    round((arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100, 6) AS price_change_percent, CAST(floor(avg(volume)) AS BIGINT) AS average_volume FROM bars GROUP BY ticker""")
def d02(spark, d):
    s = stock_record.period_summary(views.bars(spark, d))
    return keep(s, "ticker", "data_points", "start_date", "end_date", "latest_volume", "average_volume", *SUMMARY)


_COMPLETE = ["close", "rsi_14", "sma_20", "sma_50", "sma_200", "volume_sma_20"]


@query("d03_completeness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round(100.0 * count({c}) / count(*), 6) AS complete_pct FROM ind_rsi" for c in _COMPLETE))
def d03(spark, d):
    close = F.col("close")
    b = views.bars(spark, d).withColumns({"rsi_14": ind.rsi(close), "sma_20": ind.sma(close, 20), "sma_50": ind.sma(close, 50),
                                          "sma_200": ind.sma(close, 200), "volume_sma_20": ind.sma(F.col("volume"), 20)})
    return keep(quality.completeness(b, _COMPLETE), "column_name", "null_count", "complete_pct")


@query("c14_stock_record")
def c14(spark, d):
    rec = stock_record.stock_record(views.instrument(spark, d), views.bars(spark, d), views.fundamentals(spark, d), views.news(spark, d), views.earnings(spark, d))
    return rec


@query("h33_summary_line", """SELECT i.ticker, 'Stock analysis for ' || i.ticker || ' on 2024-01-31. ' || i.name || ' - ' || i.sector || '. ' || printf('Price: $%.2f, Change: %.2f%%', p, c) AS line FROM instrument i JOIN
    (SELECT ticker, arg_max(close, date) AS p, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS c FROM bars GROUP BY ticker) USING (ticker)""")
def h33(spark, d):
    j = views.instrument(spark, d).join(stock_record.period_summary(views.bars(spark, d)), "ticker")
    return j.select("ticker", stock_record.summary_line("2024-01-31").alias("line"))


_LINES = ", ".join(f"'- {label}: ' || coalesce(CAST({c} AS VARCHAR), 'N/A')" for label, c in (
    ("P/E Ratio", "pe_ratio"), ("PEG Ratio", "peg_ratio"), ("Price to Book", "price_to_book"), ("Profit Margin", "profit_margin"),
    ("ROE", "roe"), ("Debt to Equity", "debt_to_equity"), ("Current Ratio", "current_ratio")))


@query("h28_record_text", f"""SELECT i.ticker, concat_ws(chr(10), 'Stock Analysis Data for ' || i.ticker, '- Name: ' || name, '- Sector: ' || sector, '- Industry: ' || industry, printf('- Price: $%.2f', p),
    '- Market Cap: $' || format('{{:,}}', CAST(round(market_cap) AS BIGINT)), printf('- Period Change: %.2f%%', c), printf('- Period High: $%.2f', hi), printf('- Period Low: $%.2f', lo), {_LINES}) AS text
  FROM instrument i JOIN (SELECT ticker, arg_max(close, date) AS p, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS c, max(high) AS hi, min(low) AS lo FROM bars GROUP BY ticker) b ON b.ticker = i.ticker
  LEFT JOIN fundamentals f ON f.ticker = i.ticker""")
def h28_record(spark, d):
    j = views.instrument(spark, d).join(stock_record.period_summary(views.bars(spark, d)), "ticker").join(views.fundamentals(spark, d), "ticker", "left")
    return j.select("ticker", stock_record.record_text().alias("text"))


@query("h28_signal_text")
def h28_signal(spark, d):
    from equityspark.catalog.q_screens import technical

    return technical(spark, d).select("ticker", stock_record.indicator_text().alias("indicators"), stock_record.signal_text().alias("signal"))


@query("h28_medium_text", """SELECT m.ticker, concat_ws(chr(10), m.ticker || ' Analysis Summary' || chr(10), printf('Price: $%.2f', price), 'Technical Signal: ' || upper(coalesce(t.direction, 'neutral')),
    printf('Fundamental Score: %.0f/100', coalesce(m.fundamental_score, 50.0)), printf('RSI: %.1f', coalesce(m.rsi, 50.0)) || chr(10),
    CASE WHEN lower(t.direction) = 'bullish' AND coalesce(m.fundamental_score, 50) > 60 THEN 'Strong buy candidate with positive technical and fundamental signals.'
      WHEN lower(t.direction) = 'bearish' OR coalesce(m.fundamental_score, 50) < 40 THEN 'Caution advised. Weak technical or fundamental indicators.'
      ELSE 'Mixed signals. Further analysis recommended.' END) AS text
  FROM medium_scored m LEFT JOIN tech_signal t ON t.ticker = m.ticker""")
def h28_medium(spark, d):
    from equityspark.catalog.q_screens import metrics, technical
    from equityspark.operators import scoring
    from equityspark.plans import funnel

    m = funnel.medium_scores(funnel.quick_scores(metrics(spark, d)), technical(spark, d), scoring.fundamental_table(views.fundamentals(spark, d)))
    return m.select("ticker", stock_record.medium_text().alias("text"))
