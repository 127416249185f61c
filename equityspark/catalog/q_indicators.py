"""Window indicators, latest-row snapshots and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog.registry import query
from equityspark.catalog.util import keep, r
from equityspark.functions import indicators as ind
from equityspark.functions import rules
from equityspark.functions.core import series, pct, ratio
from equityspark.operators import features, labels, quality
from equityspark.plans import snapshot
from equityspark.sources import readers, views

W = "(PARTITION BY ticker ORDER BY date)"


@query("e01_sma", f"SELECT ticker, date, {r('sma_20', 'sma_50', 'sma_200')} FROM ind_rsi")
def e01(spark, d):
    b = views.bars(spark, d).withColumns({f"sma_{n}": ind.sma(F.col("close"), n) for n in (20, 50, 200)})
    return keep(b, "ticker", "date", "sma_20", "sma_50", "sma_200")


@query("e02_ema", f"SELECT ticker, date, {r('ema_12', 'ema_26')} FROM ema_rec")
def e02(spark, d):
    return keep(ind.add_ema(views.bars(spark, d), "close", {"ema_12": 12, "ema_26": 26}), "ticker", "date", "ema_12", "ema_26")


@query("e03_macd", f"SELECT ticker, date, {r('macd', 'macd_signal', 'macd_hist')} FROM indicators")
def e03(spark, d):
    return keep(ind.add_macd(views.bars(spark, d)), "ticker", "date", "macd", "macd_signal", "macd_hist")


@query("e04_rsi", f"SELECT ticker, date, {r('rsi_14')} FROM ind_rsi")
def e04(spark, d):
    return keep(views.bars(spark, d).withColumn("rsi_14", ind.rsi(F.col("close"))), "ticker", "date", "rsi_14")


@query(
    "e05_latest_rsi",
    """SELECT ticker, round(CASE WHEN n < 15 THEN 50.0 ELSE coalesce(rsi_14, 50.0) END, 6) AS rsi FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY ticker) AS n
      FROM ind_rsi) WHERE k = 1""",
)
def e05(spark, d):
    return keep(snapshot.latest_rsi(views.bars(spark, d)), "ticker", "rsi")


@query("e06_bollinger", f"SELECT ticker, date, {r('bb_upper', 'bb_middle', 'bb_lower')} FROM (SELECT ticker, date, sma_20 + 2 * sd_20 AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd_20 AS bb_lower FROM ind_rsi)")
def e06(spark, d):
    up, mid, lo = ind.bollinger(F.col("close"))
    b = views.bars(spark, d).withColumns({"bb_upper": up, "bb_middle": mid, "bb_lower": lo})
    return keep(b, "ticker", "date", "bb_upper", "bb_middle", "bb_lower")


@query("e07_volume_ratio", "SELECT ticker, date, round(volume_sma_20, 6) AS average_volume, round(volume / volume_sma_20, 6) AS volume_ratio FROM ind_rsi")
def e07(spark, d):
    b = views.bars(spark, d).withColumn("average_volume", ind.sma(F.col("volume"), 20))
    return keep(b.withColumn("volume_ratio", ratio(F.col("volume"), F.col("average_volume"))), "ticker", "date", "average_volume", "volume_ratio")


@query("e08_obv", f"""SELECT ticker, date, round(sum(s) OVER {W}, 6) AS obv FROM (
    SELECT ticker, date, coalesce(sign(close - lag(close) OVER {W}) * volume, 0.0) AS s FROM bars)""")
def e08(spark, d):
    return keep(views.bars(spark, d).withColumn("obv", ind.obv(F.col("close"), F.col("volume"))), "ticker", "date", "obv")


@query("e09_support_resistance", f"""SELECT ticker, min(close) AS support, max(close) AS resistance,
    arg_max(close, date) AS current FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars)
    WHERE k <= 20 GROUP BY ticker""")
def e09(spark, d):
    return keep(snapshot.support_resistance(views.bars(spark, d)), "ticker", "support", "resistance", "current")


SNAP_SQL = """
  SELECT ticker, date, close AS current_price, high AS price_high, low AS price_low, rsi_14, macd, macd_signal, macd_hist,
    sma_20, sma_50, sma_200, bb_upper, bb_middle, bb_lower, volume AS volume_current, volume_sma_20 AS volume_average,
    volume / volume_sma_20 AS volume_ratio, sup AS support, res AS resistance,
    CASE WHEN sma_20 <> 0 AND sma_50 <> 0 AND sma_200 <> 0 THEN
      CASE WHEN sma_20 > sma_50 AND sma_50 > sma_200 THEN 'Strong Uptrend' WHEN sma_20 > sma_50 THEN 'Uptrend'
        WHEN sma_20 < sma_50 AND sma_50 < sma_200 THEN 'Strong Downtrend' WHEN sma_20 < sma_50 THEN 'Downtrend'
        ELSE 'Sideways' END ELSE 'Unknown' END AS trend,
    CASE WHEN macd <> 0 AND macd_signal <> 0 AND macd > macd_signal AND macd_hist > 0 THEN 'Bullish'
      WHEN macd <> 0 AND macd_signal <> 0 AND macd < macd_signal AND macd_hist < 0 THEN 'Bearish' ELSE 'Neutral' END AS macd_label,
    CASE WHEN rsi_14 > 70 THEN 'Overbought' WHEN rsi_14 <> 0 AND rsi_14 < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_label,
    (close - sma_20) / sma_20 * 100 AS vs_sma20, (close - sma_50) / sma_50 * 100 AS vs_sma50,
    (close - sma_200) / sma_200 * 100 AS vs_sma200
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k,
      min(close) OVER w AS sup, max(close) OVER w AS res
    FROM indicators WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) WHERE k = 1"""

from equityspark.catalog import oracle  # noqa: E402

oracle.define("snap", SNAP_SQL)
SNAP_COLS = ["current_price", "price_high", "price_low", "rsi_14", "macd", "macd_signal", "macd_hist", "sma_20", "sma_50",
             "sma_200", "bb_upper", "bb_middle", "bb_lower", "volume_current", "volume_average", "volume_ratio",
             "support", "resistance", "vs_sma20", "vs_sma50", "vs_sma200"]


@query("e10_snapshot", f"SELECT ticker, date, trend, macd_label, rsi_label, {r(*SNAP_COLS)} FROM snap")
def e10(spark, d):
    flat = snapshot.flat_snapshot(views.bars(spark, d))
    return keep(flat, "ticker", "date", "trend", "macd_label", "rsi_label", *SNAP_COLS)


@query("e11_indicator_table", f"SELECT ticker, date, {r(*ind.INDICATOR_COLUMNS)} FROM indicators")
def e11(spark, d):
    return keep(ind.indicator_table(views.bars(spark, d)), "ticker", "date", *ind.INDICATOR_COLUMNS)


LAGS = [f"lag_return_{n}d" for n in (1, 5, 10, 20)]


@query("e12_lag_returns", "SELECT ticker, date, " + ", ".join(f"round(lag_{n}, 6) AS lag_return_{n}d" for n in (1, 5, 10, 20)) + " FROM ind_lag")
def e12(spark, d):
    return keep(features.add_lags(views.bars(spark, d)), "ticker", "date", *LAGS)


oracle.define("ind_vol", f"""
  SELECT ticker, date, close, CASE WHEN n14 = 14 THEN atr END AS atr_14, vol AS realized_vol_20d,
    CASE WHEN vol IS NOT NULL THEN CAST(vol > median(vol) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS INTEGER) END AS volatility_regime
  FROM (SELECT *, avg(tr) OVER r14 AS atr, count(*) OVER r14 AS n14,
      CASE WHEN count(lr) OVER r20 = 20 THEN stddev_samp(lr) OVER r20 END AS vol
    FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, ln(close / pc) AS lr
      FROM (SELECT *, lag(close) OVER {W} AS pc FROM bars))
    WINDOW r14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), r20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))""")


@query("e13_atr", f"SELECT ticker, date, {r('atr_14')} FROM ind_vol")
def e13(spark, d):
    return keep(views.bars(spark, d).withColumn("atr_14", ind.atr(F.col("high"), F.col("low"), F.col("close"))), "ticker", "date", "atr_14")


@query("e14_realized_vol", f"SELECT ticker, date, {r('realized_vol_20d')} FROM ind_vol")
def e14(spark, d):
    return keep(features.add_volatility(views.bars(spark, d)), "ticker", "date", "realized_vol_20d")


@query("e15_volatility_regime", "SELECT ticker, date, volatility_regime FROM ind_vol")
def e15(spark, d):
    return features.add_volatility(views.bars(spark, d)).select("ticker", "date", "volatility_regime")


oracle.define("rel_strength", """
  SELECT a.ticker, a.date, a.lag_20 / nullif(b.lag_20, 0) AS rs_vs_benchmark_20d, b.lag_20 AS bench_ret
  FROM ind_lag a LEFT JOIN (SELECT * FROM ind_lag WHERE ticker = 'S0000') b ON a.date = b.date""")


@query("e16_relative_strength", f"SELECT ticker, date, {r('rs_vs_benchmark_20d', digits=4)} FROM rel_strength")
def e16(spark, d):
    return keep(features.add_relative_strength(views.bars(spark, d), views.BENCHMARK), "ticker", "date", "rs_vs_benchmark_20d", digits=4)


@query("c04_benchmark_join", "SELECT ticker, date, round(bench_ret, 6) AS bench_return_20d FROM rel_strength")
def c04(spark, d):
    b = views.bars(spark, d).withColumn("_r", ind.lag_return(F.col("close"), 20)).select("ticker", "date", "_r")
    bench = b.where(F.col("ticker") == views.BENCHMARK).select("date", F.col("_r").alias("bench_return_20d"))
    return keep(b.join(F.broadcast(bench), "date", "left"), "ticker", "date", "bench_return_20d")


@query("e17_bollinger_position", """SELECT ticker, date, round((close - bb_lower) / nullif(bb_upper - bb_lower, 0), 6) AS bb_pct_b,
    round((bb_upper - bb_lower) / nullif(bb_middle, 0), 6) AS bb_width FROM (SELECT *, sma_20 + 2 * sd_20 AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd_20 AS bb_lower FROM ind_rsi)""")
def e17(spark, d):
    up, mid, lo = ind.bollinger(F.col("close"))
    b = views.bars(spark, d).withColumns({"bb_upper": up, "bb_middle": mid, "bb_lower": lo})
    return keep(features.add_bands(b), "ticker", "date", "bb_pct_b", "bb_width")


@query("e18_daily_change", f"SELECT ticker, date, round(coalesce((close - lag(close) OVER {W}) / lag(close) OVER {W} * 100, 0), 6) AS change_pct FROM bars")
def e18(spark, d):
    b = views.bars(spark, d).withColumn("change_pct", snapshot.daily_change(F.col("close")))
    return keep(b, "ticker", "date", "change_pct")


@query("e19_days_to_earnings", "SELECT ticker, date, 63 - (rn - 1) % 63 AS days_to_earnings FROM numbered")
def e19(spark, d):
    return views.bars(spark, d).select("ticker", "date", ind.days_to_earnings().alias("days_to_earnings"))


LABEL_COLS = [f"forward_{n}d_return" for n in (1, 5, 10, 20)]
DIR_COLS = [f"direction_{n}d" for n in (1, 5, 10, 20)]
oracle.define("fwd_labels", """
  SELECT ticker, date, close, f1 AS forward_1d_return, f5 AS forward_5d_return, f10 AS forward_10d_return, f20 AS forward_20d_return,
    CAST(f1 > 0 AS INTEGER) AS direction_1d, CAST(f5 > 0 AS INTEGER) AS direction_5d, CAST(f10 > 0 AS INTEGER) AS direction_10d,
    CAST(f20 > 0 AS INTEGER) AS direction_20d,
    least(0, (p1 - greatest(close, p1)) / greatest(close, p1) * 100,
      (p2 - greatest(close, p1, p2)) / greatest(close, p1, p2) * 100,
      (p3 - greatest(close, p1, p2, p3)) / greatest(close, p1, p2, p3) * 100,
      (p4 - greatest(close, p1, p2, p3, p4)) / greatest(close, p1, p2, p3, p4) * 100,
      (p5 - greatest(close, p1, p2, p3, p4, p5)) / greatest(close, p1, p2, p3, p4, p5) * 100) AS max_drawdown_5d
  FROM (SELECT *, (p1 - close) / close * 100 AS f1, (p5 - close) / close * 100 AS f5, (p10 - close) / close * 100 AS f10, (p20 - close) / close * 100 AS f20
    FROM (SELECT ticker, date, close, lead(close, 1) OVER w AS p1, lead(close, 2) OVER w AS p2, lead(close, 3) OVER w AS p3,
      lead(close, 4) OVER w AS p4, lead(close, 5) OVER w AS p5, lead(close, 10) OVER w AS p10, lead(close, 20) OVER w AS p20
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))) WHERE p20 IS NOT NULL""")


@query("e20_forward_labels", f"SELECT ticker, date, {', '.join(DIR_COLS)}, {r(*LABEL_COLS)} FROM fwd_labels")
def e20(spark, d):
    return keep(labels.forward_labels(views.bars(spark, d)), "ticker", "date", *DIR_COLS, *LABEL_COLS)


@query("e22_forward_drawdown", f"SELECT ticker, date, {r('max_drawdown_5d')} FROM fwd_labels")
def e22(spark, d):
    return keep(labels.forward_labels(views.bars(spark, d)), "ticker", "date", "max_drawdown_5d")


oracle.define("regimes", f"""
  SELECT ticker, date, close, vol_20, dev_50, median(vol_20) OVER (PARTITION BY ticker) AS med_vol, median(dev_50) OVER (PARTITION BY ticker) AS med_dev
  FROM (SELECT ticker, date, close, CASE WHEN count(chg) OVER r20 = 20 THEN stddev_samp(chg) OVER r20 END AS vol_20,
      CASE WHEN count(*) OVER r50 = 50 THEN abs((close - avg(close) OVER r50) / avg(close) OVER r50) END AS dev_50
    FROM (SELECT *, (close - lag(close) OVER {W}) / lag(close) OVER {W} AS chg FROM bars)
    WINDOW r20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), r50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING))""")
REGIME = "CASE WHEN vol_20 > med_vol AND dev_50 > med_dev THEN 'trending' ELSE 'ranging' END"


@query("e21_regime_inputs", f"SELECT ticker, date, {REGIME} AS regime, {r('vol_20', 'dev_50', 'med_vol', 'med_dev')} FROM regimes")
def e21(spark, d):
    return keep(features.regime_inputs(views.bars(spark, d)), "ticker", "date", "regime", "vol_20", "dev_50", "med_vol", "med_dev")


@query("e23_percent_since_start", "SELECT ticker, date, round((close - f) / f * 100, 6) AS percent_change FROM (SELECT *, first(close) OVER (PARTITION BY ticker ORDER BY date) AS f FROM bars)")
def e23(spark, d):
    b = views.bars(spark, d).withColumn("percent_change", ind.percent_since_start(F.col("close")))
    return keep(b, "ticker", "date", "percent_change")


oracle.define("zscores", f"""
  SELECT *, (chg - avg(chg) OVER ()) / stddev_samp(chg) OVER () AS z_score
  FROM (SELECT *, (close - lag(close) OVER {W}) / lag(close) OVER {W} AS chg FROM bars
    WHERE high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0)""")
OHLCV = ["open", "high", "low", "close", "volume"]


@query("e24_outlier_filter", f"SELECT ticker, date, {r(*OHLCV)} FROM zscores WHERE z_score IS NULL OR abs(z_score) <= 3")
def e24(spark, d):
    return keep(quality.drop_outliers(quality.valid_bars(views.bars(spark, d)), 3.0), "ticker", "date", *OHLCV)


@query("b25_valid_bars", f"SELECT ticker, date, {r(*OHLCV)} FROM bars WHERE high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0")
def b25(spark, d):
    return keep(quality.valid_bars(views.bars(spark, d)), "ticker", "date", *OHLCV)


@query("d04_quality_counters", """SELECT count(*) AS total_rows, CAST(sum(CAST(NOT coalesce(high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0, false) AS BIGINT)) AS BIGINT) AS invalid_ohlcv,
    (SELECT count(*) FROM zscores WHERE abs(z_score) > 3) AS outliers_detected,
    CAST(sum(CAST(NOT coalesce(high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0, false) AS BIGINT)) + (SELECT count(*) FROM zscores WHERE abs(z_score) > 3) AS BIGINT) AS rows_excluded FROM bars""")
def d04(spark, d):
    return quality.quality_counters(views.bars(spark, d), 3.0)


@query("e33_price_position", "SELECT ticker, date, " + ", ".join(f"round((close - sma_{n}) / nullif(sma_{n}, 0) * 100, 6) AS vs_sma{n}" for n in (20, 50, 200)) + " FROM ind_rsi")
def e33(spark, d):
    b = views.bars(spark, d).withColumns({f"vs_sma{n}": pct(F.col("close"), ind.sma(F.col("close"), n)) for n in (20, 50, 200)})
    return keep(b, "ticker", "date", "vs_sma20", "vs_sma50", "vs_sma200")


@query("e34_day_metrics", f"""SELECT ticker, date, round(dc, 6) AS day_change_pct, round(pc, 6) AS prev_change_pct, round(vv, 6) AS volume_vs_avg,
    abs(dc) > 3 OR abs(vv) > 50 AS significant FROM (SELECT ticker, date, (close - open) / open * 100 AS dc,
    coalesce((close - lag(close) OVER {W}) / lag(close) OVER {W} * 100, 0) AS pc,
    (volume - avg(volume) OVER (PARTITION BY ticker)) / avg(volume) OVER (PARTITION BY ticker) * 100 AS vv FROM bars)""")
def e34(spark, d):
    return keep(snapshot.day_metrics(views.bars(spark, d)), "ticker", "date", "day_change_pct", "prev_change_pct", "volume_vs_avg", "significant")


@query("f01_latest_row", f"SELECT ticker, max(date) AS date, {', '.join(f'arg_max({c}, date) AS {c}' for c in OHLCV)} FROM bars GROUP BY ticker")
def f01(spark, d):
    return keep(snapshot.latest_bar(views.bars(spark, d)), "ticker", "date", *OHLCV)


@query("h01_trend", "SELECT ticker, trend FROM snap")
def h01(spark, d):
    b = views.bars(spark, d).withColumns({f"sma_{n}": ind.sma(F.col("close"), n) for n in (20, 50, 200)})
    last = snapshot.latest(b, ["sma_20", "sma_50", "sma_200"])
    return last.select("ticker", rules.trend(F.col("sma_20"), F.col("sma_50"), F.col("sma_200")).alias("trend"))


@query("h02_macd_label", """SELECT ticker, date, CASE WHEN macd <> 0 AND macd_signal <> 0 AND macd > macd_signal AND macd_hist > 0 THEN 'Bullish'
      WHEN macd <> 0 AND macd_signal <> 0 AND macd < macd_signal AND macd_hist < 0 THEN 'Bearish' ELSE 'Neutral' END AS macd_label FROM indicators""")
def h02(spark, d):
    b = ind.add_macd(views.bars(spark, d))
    return b.select("ticker", "date", rules.macd_label(F.col("macd"), F.col("macd_signal"), F.col("macd_hist")).alias("macd_label"))


@query("h03_rsi_label", "SELECT ticker, date, CASE WHEN rsi_14 > 70 THEN 'Overbought' WHEN rsi_14 <> 0 AND rsi_14 < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_label FROM ind_rsi")
def h03(spark, d):
    return views.bars(spark, d).withColumn("rsi", ind.rsi(F.col("close"))).select("ticker", "date", rules.rsi_label(F.col("rsi")).alias("rsi_label"))


@query("h23_calendar", "SELECT ticker, date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, 63 - (rn - 1) % 63 AS days_to_earnings FROM numbered")
def h23(spark, d):
    return features.add_calendar(views.bars(spark, d)).select("ticker", "date", "day_of_week", "month", "days_to_earnings")


@query("h22_threshold_labels", "SELECT ticker, date, CAST(forward_5d_return > 0 AS INTEGER) AS label FROM fwd_labels WHERE abs(forward_5d_return) >= 2")
def h22(spark, d):
    return labels.threshold_labels(labels.forward_labels(views.bars(spark, d)), "forward_5d_return", 2.0).select("ticker", "date", "label")


@query("e30_tertile_labels", """SELECT ticker, date, CAST(forward_5d_return > q1 AS INTEGER) + CAST(forward_5d_return > q2 AS INTEGER) AS tertile
    FROM fwd_labels, (SELECT quantile_cont(forward_5d_return, 1.0/3) AS q1, quantile_cont(forward_5d_return, 2.0/3) AS q2 FROM fwd_labels)""")
def e30(spark, d):
    out = labels.tertile_labels(labels.forward_labels(views.bars(spark, d)), "forward_5d_return", ["ticker", "date"])
    return out.select("ticker", "date", "tertile")
