"""Ensemble, backtest, metric and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.registry import ORACLE, query
from equityspark.catalog.util import keep, r, rounded
from equityspark.functions import indicators as ind
from equityspark.functions.core import ratio, series
from equityspark.operators import backtest, drift, ensemble
from equityspark.session import materialize, scratch_folder
from equityspark.sources import readers, views

START, END = "1997-01-01", "2000-12-31"

# Ensembles ----------------------------------------------------------------------
ENS_REC = """CASE WHEN direction = 'bullish' AND c > 70 AND e > 3 THEN 'STRONG BUY' WHEN direction = 'bullish' AND c > 60 AND e > 1 THEN 'BUY'
  WHEN direction = 'bearish' AND c > 70 AND e < -3 THEN 'STRONG SELL' WHEN direction = 'bearish' AND c > 60 AND e < -1 THEN 'SELL' ELSE 'HOLD' END AS recommendation"""
ENS_SCORE = "round(CASE direction WHEN 'bullish' THEN least(100, c + e * 5) WHEN 'bearish' THEN greatest(-100, -c + e * 5) ELSE 0.0::DOUBLE END, 1) AS score"
ENS_OUT = f"ticker, date, direction, round(c, 1) AS confidence, round(e, 2) AS expected_return, {ENS_SCORE}, {ENS_REC}"
oracle.define("ens_base", """
  SELECT ticker, date, count(direction) AS n, count(*) FILTER (direction = 'bullish') AS nu, count(*) FILTER (direction = 'bearish') AS nd,
    avg(confidence) AS ca, avg(expected_return) AS ea, avg(confidence) FILTER (direction = 'bullish') AS cu, avg(expected_return) FILTER (direction = 'bullish') AS eu,
    avg(confidence) FILTER (direction = 'bearish') AS cd, avg(expected_return) FILTER (direction = 'bearish') AS ed FROM predictions GROUP BY 1, 2""")
ENS_COLS = ["ticker", "date", "direction", "confidence", "expected_return", "score", "recommendation"]


@query("i10_voting", f"""SELECT {ENS_OUT}, na AS n_agree, round(nu / n * 100, 6) AS bullish_pct FROM (SELECT *, CASE WHEN na = n AND direction <> 'neutral' THEN least(100, c0 + 10) ELSE c0 END AS c FROM (
    SELECT *, CASE WHEN nu > nd THEN 'bullish' WHEN nd > nu THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN nu > nd THEN nu WHEN nd > nu THEN nd ELSE n END AS na,
      CASE WHEN nu > nd THEN cu WHEN nd > nu THEN cd ELSE ca END AS c0, CASE WHEN nu > nd THEN eu WHEN nd > nu THEN ed ELSE ea END AS e FROM ens_base))""")
def i10(spark, d):
    return keep(ensemble.voting(views.predictions(spark, d)), *ENS_COLS, "n_agree", "bullish_pct")


@query("i11_averaging", f"SELECT {ENS_OUT} FROM (SELECT *, CASE WHEN ea > 0.5 THEN 'bullish' WHEN ea < -0.5 THEN 'bearish' ELSE 'neutral' END AS direction, ca AS c, ea AS e FROM ens_base)")
def i11(spark, d):
    return keep(ensemble.averaging(views.predictions(spark, d)), *ENS_COLS)


UNANIMOUS = """SELECT *, CASE WHEN nu = n THEN 'bullish' WHEN nd = n THEN 'bearish' ELSE 'neutral' END AS direction,
    CASE WHEN nu = n OR nd = n THEN least(100, ca + 15) ELSE 0.0 END AS c, CASE WHEN nu = n OR nd = n THEN ea ELSE 0.0 END AS e, (nu = n OR nd = n) AS unanimous FROM ens_base"""


@query("i12_unanimous", f"SELECT {ENS_OUT}, unanimous FROM ({UNANIMOUS})")
def i12(spark, d):
    return keep(ensemble.unanimous(views.predictions(spark, d)), *ENS_COLS, "unanimous")


oracle.define("model_accuracy", """
  SELECT p.model, p.date, avg(CASE WHEN p.direction = CASE WHEN l.forward_5d_return > 0 THEN 'bullish' ELSE 'bearish' END THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM predictions p JOIN fwd_labels l USING (ticker, date) WHERE p.model <> 'momentum' GROUP BY 1, 2""")
oracle.define("model_weights", "SELECT model, avg(accuracy) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM model_accuracy) WHERE k <= 30 GROUP BY model")


def accuracy(spark, d):
    """Share of right directions per model and date; the momentum model has no history yet."""
    close = F.col("close")
    b = views.bars(spark, d).select("ticker", "date", "close")
    fwd = b.withColumns({"_f": F.lead(close, 5).over(series()), "_h": F.lead(close, 20).over(series())}).where("_h IS NOT NULL")
    up = F.when(F.col("_f") > close, "bullish").otherwise("bearish")
    p = views.predictions(spark, d).where("model <> 'momentum'").join(fwd.select("ticker", "date", up.alias("_a")), ["ticker", "date"])
    return p.groupBy("model", F.col("date").alias("ts")).agg(F.avg((F.col("direction") == F.col("_a")).cast("double")).alias("accuracy"))


@query("e29_rolling_weights", f"SELECT model, {r('weight')} FROM model_weights")
def e29(spark, d):
    return keep(ensemble.rolling_weights(accuracy(spark, d)), "model", "weight")


@query("i14_dynamic_weighting", f"""SELECT {ENS_OUT.replace('round(c, 1)', 'round(c, 1)')} FROM (SELECT ticker, date, CASE WHEN u > dn THEN 'bullish' WHEN dn > u THEN 'bearish' ELSE 'neutral' END AS direction, c, e FROM (
    SELECT ticker, date, sum(w * confidence) / sum(w) AS c, sum(w * expected_return) / sum(w) AS e, coalesce(sum(w) FILTER (direction = 'bullish'), 0) AS u, coalesce(sum(w) FILTER (direction = 'bearish'), 0) AS dn
    FROM (SELECT p.*, coalesce(weight, 1.0) AS w FROM predictions p LEFT JOIN model_weights USING (model)) GROUP BY 1, 2))""")
def i14(spark, d):
    w = ensemble.rolling_weights(accuracy(spark, d))
    return keep(ensemble.dynamic_weighting(views.predictions(spark, d), w), *ENS_COLS)


@query("i14_model_weights", """SELECT ticker, date, model, round(coalesce(weight, 1.0) / sum(coalesce(weight, 1.0)) OVER (PARTITION BY ticker, date), 6) AS weight
    FROM predictions LEFT JOIN model_weights USING (model) WHERE direction IS NOT NULL""")
def i14_weights(spark, d):
    w = ensemble.rolling_weights(accuracy(spark, d))
    return keep(ensemble.normalised_weights(views.predictions(spark, d), w), "ticker", "date", "model", "weight")


@query("i15_failed_models", f"""SELECT {ENS_OUT}, n AS n_models, CASE WHEN n = 0 THEN 'All models failed' END AS error FROM (SELECT *, CASE WHEN ea > 0.5 THEN 'bullish' WHEN ea < -0.5 THEN 'bearish' ELSE 'neutral' END AS direction,
    coalesce(ca, 0) AS c, coalesce(ea, 0) AS e FROM (SELECT ticker, date, count(direction) AS n, avg(confidence) FILTER (direction IS NOT NULL) AS ca, avg(expected_return) FILTER (direction IS NOT NULL) AS ea
      FROM (SELECT * REPLACE (CASE WHEN confidence > 55 THEN direction END AS direction) FROM predictions) GROUP BY 1, 2))""")
def i15(spark, d):
    p = views.predictions(spark, d).withColumn("direction", F.when(F.col("confidence") > 55, F.col("direction")))
    return keep(ensemble.averaging(p), *ENS_COLS, "n_models", "error")


# Backtest -----------------------------------------------------------------------
oracle.define("ens_unanimous", f"SELECT ticker, date, direction, round(c, 1) AS confidence, round(e, 2) AS expected_return FROM ({UNANIMOUS})")
oracle.define("range_bars", f"""SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS nr,
    lead(date, 5) OVER (PARTITION BY ticker ORDER BY date) AS exit_date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS exit_price
  FROM bars WHERE date >= DATE '{START}' - 100 AND date <= DATE '{END}'""")
oracle.define("trades", f"""
  SELECT b.ticker, b.date AS entry_date, b.exit_date, round(b.close, 2) AS entry_price, round(exit_price, 2) AS exit_price,
    round((exit_price - b.close) / b.close * 100, 2) AS gross_return_pct, round((exit_price - b.close) / b.close * 100 - 0.2, 2) AS net_return_pct,
    round(confidence, 1) AS ml_confidence, round(expected_return, 2) AS ml_expected_return, p.direction AS ml_direction,
    CASE WHEN exit_price > b.close THEN 'bullish' ELSE 'bearish' END AS actual_direction,
    p.direction = CASE WHEN exit_price > b.close THEN 'bullish' ELSE 'bearish' END AS prediction_correct, (exit_price - b.close) / b.close * 100 - 0.2 > 0 AS profitable
  FROM range_bars b JOIN ens_unanimous p ON p.ticker = b.ticker AND p.date = b.date
  WHERE nr >= 100 AND pos >= 50 AND pos < nr - 6 AND b.date >= DATE '{START}' AND confidence >= 60 AND abs(expected_return) >= 1""")
TRADE_NUM = ["entry_price", "exit_price", "gross_return_pct", "net_return_pct", "ml_confidence", "ml_expected_return"]
TRADE_TXT = ["ticker", "entry_date", "exit_date", "ml_direction", "actual_direction", "prediction_correct", "profitable"]


def trades(spark, d):
    p = ensemble.unanimous(views.predictions(spark, d)).select("ticker", "date", "direction", "confidence", "expected_return")
    return backtest.simulate(views.bars(spark, d), p, START, END, min_return=1.0)


@query("i16_backtest_trades", f"SELECT {', '.join(TRADE_TXT)}, {r(*TRADE_NUM)} FROM trades")
def i16(spark, d):
    return keep(trades(spark, d), *TRADE_TXT, *TRADE_NUM)


@query("c16_priced_predictions", "SELECT b.ticker, b.date, p.model, round((b.exit_price - b.close) / b.close * 100, 6) AS realised FROM range_bars b JOIN predictions p ON p.ticker = b.ticker AND p.date = b.date WHERE nr >= 100 AND pos >= 50 AND pos < nr - 6")
def c16(spark, d):
    from equityspark.functions.core import pct

    e = backtest.priced_entries(readers.warmup_range(views.bars(spark, d), START, END))
    j = e.join(views.predictions(spark, d), ["ticker", "date"]).withColumn("realised", pct(F.col("exit_price"), F.col("entry_price")))
    return keep(j, "ticker", "date", "model", "realised")


@query("c08_entry_exit", "SELECT ticker, date, close AS entry_price, exit_date, exit_price AS exit_price FROM range_bars WHERE nr >= 100 AND pos >= 50 AND pos < nr - 6")
def c08(spark, d):
    e = backtest.priced_entries(readers.warmup_range(views.bars(spark, d), START, END))
    return keep(e, "ticker", "date", "entry_price", "exit_date", "exit_price")


@query("b28_entry_filter", "SELECT ticker, date, model FROM predictions WHERE confidence >= 60 AND abs(expected_return) >= 2 AND direction = 'bullish'")
def b28(spark, d):
    return views.predictions(spark, d).where(backtest.entry_filter(direction="bullish")).select("ticker", "date", "model")


STATS = ["win_rate", "avg_return_per_trade", "median_return", "total_return", "avg_winner", "avg_loser", "best_trade", "worst_trade",
         "prediction_accuracy", "avg_ml_confidence", "profit_factor", "expectancy", "trade_sharpe"]
oracle.define("tstats", """
  SELECT *, CASE WHEN losses > 0 THEN gains / losses WHEN gains > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor,
    win_rate / 100 * avg_winner - losing_trades / total_trades * abs(avg_loser) AS expectancy,
    CASE WHEN total_trades >= 2 AND sd > 0 THEN avg_return_per_trade / sd * sqrt(252) ELSE 0 END AS trade_sharpe
  FROM (SELECT ticker, count(*) AS total_trades, count(*) FILTER (net_return_pct > 0) AS winning_trades, count(*) FILTER (net_return_pct <= 0) AS losing_trades,
    count(*) FILTER (net_return_pct > 0) / count(*) * 100 AS win_rate, avg(net_return_pct) AS avg_return_per_trade, median(net_return_pct) AS median_return, sum(net_return_pct) AS total_return,
    coalesce(avg(net_return_pct) FILTER (net_return_pct > 0), 0) AS avg_winner, coalesce(avg(net_return_pct) FILTER (net_return_pct <= 0), 0) AS avg_loser,
    max(net_return_pct) AS best_trade, min(net_return_pct) AS worst_trade, avg(CAST(prediction_correct AS INTEGER)) * 100 AS prediction_accuracy, avg(ml_confidence) AS avg_ml_confidence,
    stddev_samp(net_return_pct) AS sd, coalesce(sum(net_return_pct) FILTER (net_return_pct > 0), 0) AS gains, abs(coalesce(sum(net_return_pct) FILTER (net_return_pct <= 0), 0)) AS losses
    FROM trades GROUP BY ticker)""")


@query("d05_trade_stats", f"SELECT ticker, total_trades, winning_trades, losing_trades, {r(*[s for s in STATS if s not in ('profit_factor', 'expectancy', 'trade_sharpe')])} FROM tstats")
def d05(spark, d):
    return keep(backtest.trade_stats(trades(spark, d)), "ticker", "total_trades", "winning_trades", "losing_trades",
                *[s for s in STATS if s not in ("profit_factor", "expectancy", "trade_sharpe")])


def _stat(name: str, column: str, digits: int = 6):
    sql = f"SELECT ticker, CASE WHEN isinf({column}) THEN 1e300 ELSE round({column}, {digits}) END AS {column} FROM tstats"

    def run(spark, d):
        x = F.col(column)
        s = backtest.trade_stats(trades(spark, d))
        finite = F.when(F.abs(x) != float("inf"), x)
        return s.select("ticker", F.coalesce(F.round(finite, digits), F.lit(1e300)).alias(column))

    query(name, sql)(run)


_stat("d06_win_rate", "win_rate")
_stat("d07_profit_factor", "profit_factor")
_stat("d08_expectancy", "expectancy")
_stat("d09_trade_sharpe", "trade_sharpe")


def _mean(total: str, n: str, digits: int) -> str:
    """SQL for total / n rounded half away from zero in whole numbers; total in units of 10^-digits."""
    return f"sign({total}) * floor((2 * abs({total}) + {n})::DOUBLE / (2 * {n})) / {10.0**digits}"


def _share(hit: str) -> str:
    return _mean(f"(1000 * count(*) FILTER ({hit}))", "count(*)", 1)


_CENTS = "sum(CAST(round(net_return_pct * 100) AS BIGINT))"
_TENTHS = "sum(CAST(round(ml_confidence * 10) AS BIGINT))"


@query("d10_return_distribution", "SELECT ticker, count(*) FILTER (x < -5) AS big_loss, count(*) FILTER (x >= -5 AND x < 0) AS loss, count(*) FILTER (x >= 0 AND x < 2) AS small_gain, count(*) FILTER (x >= 2 AND x < 5) AS medium_gain, count(*) FILTER (x >= 5) AS big_gain FROM (SELECT ticker, net_return_pct AS x FROM trades) GROUP BY ticker")
def d10(spark, d):
    return backtest.return_distribution(trades(spark, d))


@query("d11_accuracy_by_confidence", f"""SELECT ticker, bucket, count(*) AS count, {_share("prediction_correct")} AS accuracy, {_share("net_return_pct > 0")} AS win_rate,
    {_mean(_CENTS, "count(*)", 2)} AS avg_return FROM (SELECT *, CASE WHEN ml_confidence > 70 THEN 'high' WHEN ml_confidence > 60 THEN 'medium' WHEN ml_confidence > 50 THEN 'low' END AS bucket FROM trades) WHERE bucket IS NOT NULL GROUP BY 1, 2""")
def d11(spark, d):
    return backtest.accuracy_by_confidence(trades(spark, d))


@query("d12_aggregate", f"""SELECT (SELECT count(*) FROM instrument) AS total_tickers, count(DISTINCT ticker) AS successful_tickers, count(*) AS total_trades, {_share("profitable")} AS win_rate,
    {_mean(_CENTS, "count(*)", 2)} AS avg_return_per_trade, {_CENTS} / 100.0 AS total_return, {_share("prediction_correct")} AS prediction_accuracy,
    {_mean(_TENTHS, "count(*)", 1)} AS avg_confidence, (SELECT ticker FROM trades GROUP BY ticker ORDER BY {_mean(_CENTS, "count(*)", 2)} DESC, ticker LIMIT 1) AS best_ticker,
    (SELECT ticker FROM trades GROUP BY ticker ORDER BY {_mean(_CENTS, "count(*)", 2)}, ticker LIMIT 1) AS worst_ticker FROM trades""")
def d12(spark, d):
    n = views.instrument(spark, d).agg(F.count("*").alias("total_tickers"))
    return backtest.aggregate_tickers(trades(spark, d), n)


@query("d13_buy_and_hold", f"SELECT ticker, round(CASE WHEN count(*) >= 2 THEN (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 ELSE 0 END, 6) AS buy_hold_return FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ticker")
def d13(spark, d):
    return keep(backtest.buy_and_hold(views.bars(spark, d), START, END), "ticker", "buy_hold_return")


oracle.define("equity_factors", f"""SELECT ticker, exit_date, product(1 + net_return_pct / 100) AS f FROM trades WHERE exit_date <= DATE '{END}' GROUP BY 1, 2""")
oracle.define("equity_run", f"""
  SELECT t.ticker, DATE '{START}' AS date, coalesce(f, 1.0::DOUBLE) AS p FROM (SELECT DISTINCT ticker FROM trades) t LEFT JOIN equity_factors x ON x.ticker = t.ticker AND x.exit_date = DATE '{START}'
  UNION ALL SELECT e.ticker, e.date + 1, e.p * coalesce(f, 1.0::DOUBLE) FROM equity_run e LEFT JOIN equity_factors x ON x.ticker = e.ticker AND x.exit_date = e.date + 1 WHERE e.date < DATE '{END}'""")
oracle.define("equity", "SELECT ticker, date, p * 100 AS equity FROM equity_run")


@query("e27_equity_curve", f"SELECT ticker, date, {r('equity')} FROM equity")
def e27(spark, d):
    return keep(backtest.equity_curve(trades(spark, d), START, END), "ticker", "date", "equity")


oracle.define("emetrics", """
  SELECT ticker, CASE WHEN n >= 2 AND sd > 0 THEN m / sd * sqrt(252) ELSE 0 END AS sharpe_ratio,
    CASE WHEN n < 2 THEN 0 WHEN neg = 0 THEN CASE WHEN m > 0 THEN 1e300 ELSE 0 END WHEN down > 0 THEN m / down * sqrt(252) ELSE 0 END AS sortino_ratio,
    CASE WHEN n >= 2 THEN coalesce(mdd, 0) ELSE 0 END AS max_drawdown,
    CASE WHEN n < 2 THEN 0 WHEN mdd = 0 THEN CASE WHEN ann > 0 THEN 1e300 ELSE 0 END ELSE ann / abs(mdd / 100) END AS calmar_ratio
  FROM (SELECT *, pow(1 + (lst - fst) / fst, 252.0 / n) - 1 AS ann FROM (
    SELECT ticker, count(*) AS n, avg(chg) AS m, stddev_samp(chg) AS sd, count(*) FILTER (chg < 0) AS neg, sqrt(avg(chg * chg) FILTER (chg < 0)) AS down, min(dd) AS mdd, arg_min(equity, date) AS fst, arg_max(equity, date) AS lst
    FROM (SELECT *, (equity - lag(equity) OVER w) / lag(equity) OVER w AS chg, (equity - max(equity) OVER w) / max(equity) OVER w * 100 AS dd FROM equity WINDOW w AS (PARTITION BY ticker ORDER BY date)) GROUP BY ticker))""")


def _equity_metric(name: str, column: str):
    def run(spark, d):
        m = backtest.equity_metrics(backtest.equity_curve(trades(spark, d), START, END))
        x = F.col(column)
        return m.select("ticker", F.coalesce(F.round(F.when(F.abs(x) != float("inf"), x), 6), F.lit(1e300)).alias(column))

    query(name, f"SELECT ticker, round({column}, 6) AS {column} FROM emetrics")(run)


_equity_metric("d14_equity_sharpe", "sharpe_ratio")
_equity_metric("d15_sortino", "sortino_ratio")
_equity_metric("d16_max_drawdown", "max_drawdown")
_equity_metric("d17_calmar", "calmar_ratio")


@query("d18_calibration_curve", f"""SELECT ticker, CAST(bin AS BIGINT) AS bin, {_mean(_TENTHS, "count(*)", 1)} AS avg_confidence, {_share("prediction_correct")} AS actual_win_rate, count(*) AS count FROM (
    SELECT t.*, greatest(len(list_filter(e, lambda x: x < ml_confidence)) - 1, 0) AS bin, len(e) AS ne FROM trades t JOIN (
      SELECT ticker, list_sort(list_distinct(quantile_cont(ml_confidence, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM trades GROUP BY ticker) USING (ticker)) WHERE ne >= 2 GROUP BY 1, 2""")
def d18(spark, d):
    return backtest.calibration_curve(trades(spark, d))


REG = "CASE WHEN vol_20 > med_vol AND dev_50 > med_dev THEN 'trending' ELSE 'ranging' END"


@query("d19_by_regime", f"""SELECT t.ticker, {REG} AS regime, count(*) AS count, {_share("net_return_pct > 0")} AS win_rate, {_mean(_CENTS, "count(*)", 2)} AS avg_return,
    {_share("prediction_correct")} AS prediction_accuracy FROM trades t JOIN regimes g ON g.ticker = t.ticker AND g.date = t.entry_date GROUP BY 1, 2""")
def d19(spark, d):
    return backtest.by_regime(trades(spark, d), views.bars(spark, d))


@query("c09_trade_regime", f"SELECT t.ticker, t.entry_date, {REG} AS regime FROM trades t JOIN regimes g ON g.ticker = t.ticker AND g.date = t.entry_date")
def c09(spark, d):
    from equityspark.operators.features import regime_inputs

    g = regime_inputs(views.bars(spark, d)).select("ticker", F.col("date").alias("entry_date"), "regime")
    return trades(spark, d).join(g, ["ticker", "entry_date"]).select("ticker", "entry_date", "regime")


@query("e28_streaks", """SELECT ticker, coalesce(max(n) FILTER (win), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (NOT win), 0) AS max_consecutive_losses FROM (SELECT ticker, win, g, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY entry_date) - row_number() OVER (PARTITION BY ticker, win ORDER BY entry_date) AS g FROM (SELECT *, net_return_pct > 0 AS win FROM trades)) GROUP BY 1, 2, 3) GROUP BY 1""")
def e28(spark, d):
    return backtest.streaks(trades(spark, d))


@query("g05_all_trades", "SELECT ml_direction, count(*) AS n, round(sum(net_return_pct), 4) AS total FROM trades GROUP BY 1")
def g05(spark, d):
    return keep(trades(spark, d).groupBy("ml_direction").agg(F.count("*").alias("n"), F.sum("net_return_pct").alias("total")), "ml_direction", "n", "total", digits=4)


@query("i17_backtest_multi", """SELECT ticker, total_trades, round(win_rate, 6) AS win_rate, round(avg_return_per_trade, 6) AS avg_return_per_trade FROM tstats""")
def i17(spark, d):
    return keep(backtest.trade_stats(trades(spark, d)), "ticker", "total_trades", "win_rate", "avg_return_per_trade")


@query("h27_assessment", """SELECT ticker, CASE WHEN w > 60 THEN '✓ Excellent win rate (>60%) - Strong signal quality' WHEN w > 55 THEN '✓ Good win rate (55-60%) - Signals have edge' WHEN w > 50 THEN '○ Marginal win rate (50-55%) - Slight edge' ELSE '✗ Poor win rate (<50%) - No edge detected' END AS first_remark,
    CASE WHEN w > 55 AND a > 1.5 AND p > 55 THEN 'Strategy shows PROMISE - Consider live paper trading' WHEN w > 50 AND a > 0.5 THEN 'Strategy has WEAK EDGE - Needs optimization' ELSE 'Strategy NEEDS WORK - Not ready for live trading' END AS overall,
    t > coalesce(b, 0) AS beat_hold FROM (SELECT s.ticker, round(win_rate, 1) AS w, round(avg_return_per_trade, 2) AS a, round(prediction_accuracy, 1) AS p, round(total_return, 2) AS t, round(hold.v, 2) AS b FROM tstats s LEFT JOIN
      (SELECT ticker, CASE WHEN count(*) >= 2 THEN (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 ELSE 0 END AS v FROM bars WHERE date BETWEEN DATE '""" + START + """' AND DATE '""" + END + """' GROUP BY ticker) hold ON hold.ticker = s.ticker)""")
def h27(spark, d):
    rep = backtest.report(trades(spark, d), views.bars(spark, d), START, END)
    return rep.select("ticker", F.get("assessment", 0).alias("first_remark"), F.element_at("assessment", -1).alias("overall"),
                      F.col("verdict").contains("BEAT").alias("beat_hold"))


@query("h28_backtest_report")
def h28(spark, d):
    return backtest.report(trades(spark, d), views.bars(spark, d), START, END).select("ticker", "report")


# Drift --------------------------------------------------------------------------
FEATURES = ["rsi_14", "sma_ratio", "volume", "lag_return_1d", "weekday"]
CUT = "1999-01-01"


def drift_features(spark, d):
    close = F.col("close")
    b = views.bars(spark, d).withColumns({"rsi_14": ind.rsi(close), "s20": ind.sma(close, 20), "lag_return_1d": ind.lag_return(close, 1)})
    b = b.withColumns({"sma_ratio": ratio(close, F.col("s20")), "weekday": F.weekday("date").cast("double")})
    b = materialize(b.select("date", *FEATURES), "drift")  # read by every pass of the quantile selection
    split = F.col("date") < F.lit(CUT).cast("date")
    return drift.to_long(b.where(split), FEATURES), drift.to_long(b.where(~split), FEATURES)


oracle.define("drift_wide", """
  SELECT i.date, i.rsi_14, i.close / i.sma_20 AS sma_ratio, i.volume, l.lag_1 AS lag_return_1d, CAST(isodow(i.date) - 1 AS DOUBLE) AS weekday
  FROM ind_rsi i JOIN ind_lag l ON l.ticker = i.ticker AND l.date = i.date""")
oracle.define("drift_long", f"""
  SELECT date < DATE '{CUT}' AS base, name AS key, v AS value FROM drift_wide UNPIVOT (v FOR name IN ({', '.join(FEATURES)})) WHERE v IS NOT NULL""")
oracle.define("drift_edges", """
  SELECT key, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM drift_long WHERE base GROUP BY key""")
oracle.define("psi_scores", """
  SELECT key, greatest(0, sum((pa - pe) * ln(pa / pe))) AS psi FROM (
    SELECT b.key, b.bin, CASE WHEN coalesce(x.n, 0) = 0 THEN 1e-6 ELSE x.n / t.te END AS pe, CASE WHEN coalesce(y.n, 0) = 0 THEN 1e-6 ELSE y.n / t.ta END AS pa
    FROM (SELECT key, unnest(range(len(e) - 1)) AS bin FROM drift_edges) b
    LEFT JOIN (SELECT key, bin, count(*) AS n FROM drift_bins WHERE base GROUP BY 1, 2) x ON x.key = b.key AND x.bin = b.bin
    LEFT JOIN (SELECT key, bin, count(*) AS n FROM drift_bins WHERE NOT base GROUP BY 1, 2) y ON y.key = b.key AND y.bin = b.bin
    JOIN (SELECT key, count(*) FILTER (base) AS te, count(*) FILTER (NOT base) AS ta FROM drift_long GROUP BY key) t ON t.key = b.key) GROUP BY key""")
oracle.define("drift_bins", "SELECT l.base, l.key, len(list_filter(e[2:-2], lambda x: x <= value)) AS bin FROM drift_long l JOIN drift_edges USING (key)")


CLASS = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'minor_shift' ELSE 'major_shift' END"


@query("d20_baseline_profile", """SELECT key, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, """ + ", ".join(f"round(q[{i + 1}], 6) AS p{i * 10}" for i in range(11)) + """ FROM (
    SELECT key, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM drift_long WHERE base GROUP BY key)""")
def d20(spark, d):
    p = drift.profile(drift_features(spark, d)[0])
    return rounded(p.select("key", "n", "mean", "std", "min", "max", *[F.col("percentiles")[i].alias(f"p{i * 10}") for i in range(11)]))


def stored_days(spark, d):
    """Day profiles of the baseline, stored in two appends; the long rows of the baseline and of the newer days."""
    close = F.col("close")
    b = views.bars(spark, d).withColumns({"rsi_14": ind.rsi(close), "s20": ind.sma(close, 20), "lag_return_1d": ind.lag_return(close, 1)})
    b = b.withColumns({"sma_ratio": ratio(close, F.col("s20")), "weekday": F.weekday("date").cast("double")})
    long = b.select(F.trunc("date", "quarter").alias("day"), "date", *FEATURES).unpivot(["day", "date"], FEATURES, "key", "value")
    long = materialize(long.where(F.col("value").isNotNull()), "long")
    path = scratch_folder(spark, "days")
    base = F.col("date") < F.lit(CUT).cast("date")
    for early in (F.col("day") < "1996-01-01", F.col("day") >= "1996-01-01"):
        drift.append_days(long.where(base & early).select("day", "key", "value"), path)
    return path, long.where(base).select("key", "value"), long.where(~base).select("key", "value")


@query("d20_stored_days", ORACLE["d20_baseline_profile"])
def d20_stored(spark, d):
    """The same profile from stored day sketches, which bracket the exact percentiles in one pass."""
    path, base, _ = stored_days(spark, d)
    p = drift.exact_profile(base, path)
    return rounded(p.select("key", "n", "mean", "std", "min", "max", *[F.col("percentiles")[i].alias(f"p{i * 10}") for i in range(11)]))


@query("d22_merged_days", f"SELECT s.key, n, {CLASS} AS classification FROM psi_scores s JOIN (SELECT key, count(*) AS n FROM drift_long WHERE base GROUP BY key) c ON c.key = s.key")
def d22_merged(spark, d):
    """Drift classes against merged day sketches: the baseline's values are not read again."""
    path, _, now = stored_days(spark, d)
    classes = drift.check_merged(now, path)
    return classes.join(drift.merged_profile(spark, path), "key").select("key", "n", "classification")


@query("d21_psi", f"SELECT key, {r('psi')} FROM psi_scores")
def d21(spark, d):
    return keep(drift.psi(*drift_features(spark, d)), "key", "psi")


@query("d22_drift_check", f"SELECT key, round(psi, 6) AS psi, {CLASS} AS classification FROM psi_scores")
def d22(spark, d):
    return keep(drift.check(*drift_features(spark, d)), "key", "psi", "classification")


@query("d23_drift_class", f"SELECT key, {CLASS} AS classification FROM psi_scores")
def d23(spark, d):
    return drift.check(*drift_features(spark, d)).select("key", "classification")


@query("d24_should_retrain", "SELECT coalesce(bool_or(psi >= 0.2), false) AS should_retrain FROM psi_scores")
def d24(spark, d):
    return drift.should_retrain(drift.check(*drift_features(spark, d)))


@query("d25_drift_summary", f"SELECT count(*) AS total_features, count(*) FILTER (c = 'stable') AS stable, count(*) FILTER (c = 'minor_shift') AS minor_shift, count(*) FILTER (c = 'major_shift') AS major_shift, round(max(psi), 6) AS max_psi FROM (SELECT *, {CLASS} AS c FROM psi_scores)")
def d25(spark, d):
    return rounded(drift.summary(drift.check(*drift_features(spark, d))))


@query("f09_top_drifted", f"SELECT key, round(psi, 6) AS psi, {CLASS} AS classification FROM psi_scores ORDER BY psi DESC LIMIT 3")
def f09(spark, d):
    return keep(drift.top_drifted(drift.check(*drift_features(spark, d)), 3), "key", "psi", "classification")
