"""Training joins, feature projections and the assembled training frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.registry import query
from equityspark.catalog.util import keep, r
from equityspark.functions import indicators as ind
from equityspark.operators import features, labels, text
from equityspark.plans import training_set
from equityspark.sources import sinks, views

JOINED = ["close", "rsi_14", "macd", "sma_200", "bb_upper", "forward_5d_return", "max_drawdown_5d", "market_cap"]

oracle.define("joined", """
  SELECT b.ticker, b.date, b.open, b.high, b.low, b.close, b.volume, i.rsi_14, i.macd, i.macd_signal, i.macd_hist, i.sma_20, i.sma_50, i.sma_200, i.ema_12, i.ema_26,
    i.bb_upper, i.bb_middle, i.bb_lower, i.volume_sma_20, l.forward_1d_return, l.forward_5d_return, l.forward_10d_return, l.forward_20d_return, l.direction_5d, l.max_drawdown_5d,
    s.sector, s.industry, s.market_cap
  FROM bars b JOIN indicators i ON i.ticker = b.ticker AND i.date = b.date JOIN fwd_labels l ON l.ticker = b.ticker AND l.date = b.date LEFT JOIN instrument s ON s.ticker = b.ticker""")


def _tables(spark, d):
    b = views.bars(spark, d)
    table = ind.indicator_table(b).select("ticker", "date", *ind.INDICATOR_COLUMNS)
    return b, table, labels.forward_labels(b), views.instrument(spark, d)


def daily_sentiment(spark, d):
    """Newest sentiment snapshot per (ticker, date), moved onto the dates of the bars."""
    f = text.sentiment_features(views.sentiment_raw(spark, d), "body").drop("body")
    s = sinks.upsert(None, f, ["ticker", "date"], ["ts", "event_id"])
    return s.withColumn("date", F.date_sub("date", 9131)).select("ticker", "date", *features.SENTIMENT_DEFAULTS)


oracle.define("news_sent", """SELECT ticker, date - 9131 AS date, news_sentiment_score, news_sentiment_confidence, news_sentiment_article_count, news_sentiment_trend, news_macro_sentiment,
    news_company_expected_revenue_sentiment, news_company_specific_sentiment, news_industry_peer_sentiment FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ts DESC, event_id DESC) AS k FROM sent_feat) WHERE k = 1""")


@query("c01_training_join", f"SELECT ticker, date, sector, direction_5d, {r(*JOINED)} FROM joined")
def c01(spark, d):
    return keep(features.training_join(*_tables(spark, d)), "ticker", "date", "sector", "direction_5d", *JOINED)


@query("c02_sentiment_join", f"SELECT j.ticker, j.date, {r('news_sentiment_score', 'news_macro_sentiment')}, j.close AS close FROM joined j LEFT JOIN news_sent n ON n.ticker = j.ticker AND n.date = j.date")
def c02(spark, d):
    out = features.training_join(*_tables(spark, d), daily_sentiment(spark, d))
    return keep(out, "ticker", "date", "news_sentiment_score", "news_macro_sentiment", "close")


@query("c03_export_join", "SELECT b.ticker, b.date, i.sector, b.close AS close, round(x.rsi_14, 6) AS rsi_14, round(l.forward_5d_return, 6) AS forward_5d_return FROM bars b LEFT JOIN ind_rsi x ON x.ticker = b.ticker AND x.date = b.date LEFT JOIN fwd_labels l ON l.ticker = b.ticker AND l.date = b.date LEFT JOIN instrument i ON i.ticker = b.ticker WHERE l.forward_5d_return IS NOT NULL")
def c03(spark, d):
    return keep(features.export_join(*_tables(spark, d)), "ticker", "date", "sector", "close", "rsi_14", "forward_5d_return")


SENT = list(features.SENTIMENT_DEFAULTS)
MODEL_COLS = features.BASE_FEATURES + SENT + ["price_to_sma20", "price_to_sma50", "volume_ratio"]
oracle.define("model_frame", "SELECT j.ticker, j.date, " + ", ".join(f"j.{c}" for c in features.BASE_FEATURES) + ", " + ", ".join(
    f"coalesce(n.{c}, {v}) AS {c}" for c, v in features.SENTIMENT_DEFAULTS.items()) + """, j.close / j.sma_20 - 1 AS price_to_sma20, j.close / j.sma_50 - 1 AS price_to_sma50,
    j.volume / j.volume_sma_20 AS volume_ratio, j.direction_5d, j.forward_5d_return
  FROM joined j LEFT JOIN news_sent n ON n.ticker = j.ticker AND n.date = j.date WHERE j.sma_200 IS NOT NULL AND j.rsi_14 IS NOT NULL AND j.forward_5d_return IS NOT NULL""")


def model_frame(spark, d):
    b = views.bars(spark, d)
    frame = ind.indicator_table(labels.add_forward_labels(b, drop_tail=False)).where("forward_20d_return IS NOT NULL").join(daily_sentiment(spark, d), ["ticker", "date"], "left")
    return features.model_features(frame)


@query("b26_model_features", f"SELECT ticker, date, direction_5d, {r('forward_5d_return', *MODEL_COLS)} FROM model_frame")
def b26(spark, d):
    return keep(model_frame(spark, d), "ticker", "date", "direction_5d", "forward_5d_return", *MODEL_COLS)


EXT = ["lag_return_1d", "lag_return_20d", "atr_14", "realized_vol_20d", "rs_vs_benchmark_20d", "bb_pct_b", "bb_width"]
W = "(PARTITION BY ticker ORDER BY date)"
oracle.define("clean", f"""
  SELECT * FROM (SELECT *, (chg - avg(chg) OVER ()) / stddev_samp(chg) OVER () AS z FROM (SELECT *, (close - lag(close) OVER {W}) / lag(close) OVER {W} AS chg FROM joined
    WHERE high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0)) WHERE z IS NULL OR abs(z) <= 5""")
oracle.define("train_rows", f"""
  SELECT *, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct_b, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width,
    CASE WHEN n14 = 14 THEN atr END AS atr_14, vol AS realized_vol_20d,
    CASE WHEN vol IS NOT NULL THEN CAST(vol > median(vol) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS INTEGER) END AS volatility_regime
  FROM (SELECT *, avg(tr) OVER r14 AS atr, count(*) OVER r14 AS n14, CASE WHEN count(lr) OVER r20 = 20 THEN stddev_samp(lr) OVER r20 END AS vol
    FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, ln(close / pc) AS lr, (close - pc) / pc AS lag_return_1d, (close - p20) / p20 AS lag_return_20d
      FROM (SELECT *, lag(close) OVER {W} AS pc, lag(close, 20) OVER {W} AS p20, row_number() OVER {W} AS rn FROM clean))
    WINDOW r14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), r20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))""")


@query("i19_training_set", f"""SELECT t.ticker, t.date, sector, volatility_regime, CAST(isodow(t.date) - 1 AS INTEGER) AS day_of_week, 63 - (rn - 1) % 63 AS days_to_earnings,
    {', '.join(f'round({c}, 6) AS {c}' for c in EXT if c != 'rs_vs_benchmark_20d')}, round(lag_return_20d / nullif(b.v, 0), 4) AS rs_vs_benchmark_20d, round(ema_26, 6) AS ema_26, round(forward_5d_return, 6) AS forward_5d_return
  FROM train_rows t LEFT JOIN (SELECT date, lag_return_20d AS v FROM train_rows WHERE ticker = 'S0000') b ON b.date = t.date""")
def i19(spark, d):
    t = training_set.assemble(views.bars(spark, d), views.instrument(spark, d), benchmark=views.BENCHMARK)
    cols = [c for c in EXT if c != "rs_vs_benchmark_20d"]
    return t.select("ticker", "date", "sector", "volatility_regime", "day_of_week", "days_to_earnings",
                    *[F.round(c, 6).alias(c) for c in cols], F.round("rs_vs_benchmark_20d", 4).alias("rs_vs_benchmark_20d"),
                    F.round("ema_26", 6).alias("ema_26"), F.round("forward_5d_return", 6).alias("forward_5d_return"))


@query("i20_preparation_report")
def i20(spark, d):
    """Completeness of the assembled frame, as the preparation job reports it."""
    from equityspark.operators import quality

    return quality.completeness(training_set.assemble(views.bars(spark, d), views.instrument(spark, d), benchmark=views.BENCHMARK))
