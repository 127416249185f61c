"""Screens, universes and tiered ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.registry import query, register
from equityspark.catalog.util import keep, r
from equityspark.functions import indicators as ind
from equityspark.functions import rules
from equityspark.functions.core import latest_per
from equityspark.operators import features, scoring, screening, universe as uni
from equityspark.plans import funnel, snapshot
from equityspark.sources import readers, views

PERIOD = "5y"

oracle.define("period_bars", "SELECT b.* FROM bars b, (SELECT max(date) AS m FROM bars) WHERE b.date >= m - 1825")
oracle.define("pct_fund", """
  SELECT ticker, pe_ratio, peg_ratio, price_to_book, coalesce(dividend_yield * 100, 0) AS dividend_yield,
    nullif(profit_margin, 0) * 100 AS profit_margin, nullif(roe, 0) * 100 AS roe, debt_to_equity,
    nullif(revenue_growth, 0) * 100 AS revenue_growth, nullif(earnings_growth, 0) * 100 AS earnings_growth, current_ratio
  FROM fundamentals""")
oracle.define("metrics", """
  SELECT p.ticker, price, volume, coalesce((price - pc) / pc * 100, 0) AS returns_1d,
    CASE WHEN n >= 5 THEN (price - f) / f * 100 ELSE 0 END AS returns_5d, (price - p5) / p5 * 100 AS returns_5_rows,
    CASE WHEN n > 14 THEN coalesce(CASE WHEN ls > 0 THEN 100 - 100 / (1 + gn / ls) WHEN gn > 0 THEN 100.0 END, 50.0) WHEN n = 14 THEN 50.0 END AS rsi,
    CASE WHEN n >= 20 THEN s20 END AS sma_20, CASE WHEN n >= 20 THEN (price - s20) / s20 * 100 END AS price_vs_sma20,
    CASE WHEN n >= 50 THEN s50 END AS sma_50, av AS avg_volume, CASE WHEN av > 0 THEN volume / av ELSE 1.0 END AS volume_ratio,
    coalesce(i.market_cap, 0) AS market_cap, coalesce(sector, 'Unknown') AS sector, coalesce(industry, 'Unknown') AS industry, x.* EXCLUDE (ticker)
  FROM (SELECT ticker, close AS price, volume, lag(close) OVER w AS pc, lag(close, 5) OVER w AS p5, first(close) OVER w AS f,
      count(*) OVER (PARTITION BY ticker) AS n, avg(volume) OVER (PARTITION BY ticker) AS av,
      avg(greatest(d, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING) AS gn,
      avg(greatest(-d, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING) AS ls,
      avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS s20,
      avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING) AS s50,
      row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k
    FROM (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) AS d FROM period_bars)
    WINDOW w AS (PARTITION BY ticker ORDER BY date)) p
  LEFT JOIN instrument i ON i.ticker = p.ticker LEFT JOIN pct_fund x ON x.ticker = p.ticker WHERE k = 1""")

TECH = ["price", "volume", "returns_1d", "returns_5d", "returns_5_rows", "rsi", "sma_20", "price_vs_sma20", "sma_50",
        "avg_volume", "volume_ratio"]
FUND = ["pe_ratio", "peg_ratio", "price_to_book", "dividend_yield", "profit_margin", "roe", "debt_to_equity",
        "revenue_growth", "earnings_growth", "current_ratio"]


def metrics(spark, d):
    bars = readers.within_period(views.bars(spark, d), PERIOD)
    return snapshot.quick_metrics(bars, views.fundamentals(spark, d), views.instrument(spark, d))


@query("e26_quick_metrics", f"SELECT ticker, sector, industry, {r('market_cap', *TECH, *FUND)} FROM metrics")
def e26(spark, d):
    return keep(metrics(spark, d), "ticker", "sector", "industry", "market_cap", *TECH, *FUND)


@query("e25_quick_returns", f"SELECT ticker, {r('returns_1d', 'returns_5d', 'returns_5_rows')} FROM metrics")
def e25(spark, d):
    return keep(metrics(spark, d), "ticker", "returns_1d", "returns_5d", "returns_5_rows")


@query("d40_volume_metrics", f"SELECT ticker, {r('avg_volume', 'volume_ratio')} FROM metrics")
def d40(spark, d):
    return keep(metrics(spark, d), "ticker", "avg_volume", "volume_ratio")


def _sql_test(c: screening.Criterion) -> str:
    if c.op == "between":
        return f"coalesce({c.field} BETWEEN {c.value[0]} AND {c.value[1]}, false)"
    if c.op == "in":
        return f"coalesce({c.field} IN ({', '.join(repr(v) for v in c.value)}), false)"
    return f"coalesce({c.field} {c.op} {c.value!r}, false)"


def _sql_score(criteria) -> str:
    total = sum(c.weight for c in criteria)
    parts = " + ".join(f"CASE WHEN {_sql_test(c)} THEN {c.weight} ELSE 0 END" for c in criteria)
    return f"CAST(({parts}) AS DOUBLE) / {total} * 100"


def _sql_screen(s: screening.Screen, source: str = "metrics") -> str:
    joiner = " AND " if s.require_all else " OR "
    passed = joiner.join(_sql_test(c) for c in s.criteria)
    return (
        f"SELECT ticker, round(score, 6) AS score FROM (SELECT ticker, ({passed}) AS passed, {_sql_score(s.criteria)} AS score "
        f"FROM {source}) WHERE passed AND score >= {s.min_score}"
    )


for _i, _name in enumerate(screening.SCREENS, start=11):
    register(
        f"b{_i}_screen_{_name}",
        lambda spark, d, n=_name: keep(screening.run_named(metrics(spark, d), n), "ticker", "score"),
        _sql_screen(screening.SCREENS[_name]),
    )

CUSTOM = (
    screening.Criterion("rsi", ">=", 40, 1.0),
    screening.Criterion("rsi", "<=", 65, 0.5),
    screening.Criterion("sector", "in", ("ASIA", "EUROPE"), 0.8),
    screening.Criterion("pe_ratio", "between", (10, 40), 0.7),
    screening.Criterion("price_to_book", "=", 3.4, 0.2),
    screening.Criterion("roe", ">", 10, 0.9),
    screening.Criterion("debt_to_equity", "<", 50, 0.6),
)


@query("b05_criteria", "SELECT ticker, " + ", ".join(f"{_sql_test(c)} AS c{i}" for i, c in enumerate(CUSTOM)) + " FROM metrics")
def b05(spark, d):
    m = metrics(spark, d)
    return m.select("ticker", *[screening.predicate(c, m.columns).alias(f"c{i}") for i, c in enumerate(CUSTOM)])


_ALL = " AND ".join(_sql_test(c) for c in CUSTOM[:2])
_ANY = " OR ".join(_sql_test(c) for c in CUSTOM[2:])


@query("b06_all_or_any", f"SELECT ticker, ({_ALL}) AS all_passed, ({_ANY}) AS any_passed FROM metrics")
def b06(spark, d):
    m = screening.evaluate(metrics(spark, d), CUSTOM[:2], True).withColumnRenamed("passed", "all_passed")
    m = screening.evaluate(m.drop("score", "reasons"), CUSTOM[2:], False).withColumnRenamed("passed", "any_passed")
    return m.select("ticker", "all_passed", "any_passed")


@query("b07_weighted_score", f"SELECT ticker, round({_sql_score(CUSTOM)}, 6) AS score FROM metrics")
def b07(spark, d):
    return keep(screening.evaluate(metrics(spark, d), CUSTOM), "ticker", "score")


@query("b08_reasons", "SELECT ticker, array_to_string([" + ", ".join(
    f"CASE WHEN {_sql_test(c)} THEN '✓ ' ELSE '✗ ' END || '{c.field} {c.op} {str(c.value).replace(chr(39), chr(39) * 2)}'" for c in CUSTOM) + "], '; ') AS reasons FROM metrics")
def b08(spark, d):
    return screening.evaluate(metrics(spark, d), CUSTOM).select("ticker", F.array_join("reasons", "; ").alias("reasons"))


@query("b09_screen_many", _sql_screen(screening.Screen("custom", CUSTOM, False, 40)))
def b09(spark, d):
    return keep(screening.run(metrics(spark, d), screening.Screen("custom", CUSTOM, False, 40)), "ticker", "score")


@query("b10_quick_filter", "SELECT ticker, price AS price FROM metrics WHERE price > 100 AND volume_ratio > 0.5")
def b10(spark, d):
    return keep(screening.quick_filter(metrics(spark, d), "price > 100 AND volume_ratio > 0.5"), "ticker", "price")


@query("b22_screen_by_name", " UNION ALL ".join(f"SELECT '{n}' AS screen, * FROM ({_sql_screen(s)})" for n, s in screening.SCREENS.items()))
def b22(spark, d):
    return keep(screening.run_all(metrics(spark, d)), "screen", "ticker", "score")


@query("f02_ranked_momentum", f"SELECT ticker, passed, round(score, 6) AS score, round(rsi, 6) AS rsi, round(returns_5d, 6) AS returns_5d FROM (SELECT *, ({' AND '.join(_sql_test(c) for c in screening.SCREENS['momentum'].criteria)}) AS passed, {_sql_score(screening.SCREENS['momentum'].criteria)} AS score FROM metrics)")
def f02(spark, d):
    s = screening.SCREENS["momentum"]
    out = screening.evaluate(metrics(spark, d), s.criteria, s.require_all)
    return keep(out, "ticker", "passed", "score", "rsi", "returns_5d").orderBy(F.desc("score"), "ticker")


@query("f02_top_results", f"SELECT * FROM ({_sql_screen(screening.SCREENS['value'])}) ORDER BY score DESC, ticker LIMIT 10")
def f02_top(spark, d):
    return keep(screening.run_named(metrics(spark, d), "value", limit=10), "ticker", "score")


# Universes ---------------------------------------------------------------------
@query("b23_universe_members", "SELECT DISTINCT ticker FROM universe WHERE universe = 'large_cap' AND lower(sector) = 'asia'")
def b23(spark, d):
    return uni.members(views.universe(spark, d), "large_cap", "aSiA")


@query("b24_universe_filter", "SELECT DISTINCT ticker FROM universe WHERE universe = 'all' AND sector IN ('ASIA', 'EUROPE') AND ticker NOT IN (SELECT ticker FROM universe WHERE universe = 'large_cap')")
def b24(spark, d):
    u = views.universe(spark, d)
    return uni.filter_members(u, "all", ["asia", "EUROPE"], uni.members(u, "large_cap"))


@query("c10_exclude", "SELECT ticker, date, close AS close FROM bars WHERE ticker NOT IN (SELECT ticker FROM universe WHERE universe = 'large_cap')")
def c10(spark, d):
    out = uni.members(views.universe(spark, d), "large_cap")
    return keep(views.bars(spark, d).join(out, "ticker", "left_anti"), "ticker", "date", "close")


@query("c15_restrict", f"SELECT ticker, {r(*TECH)} FROM metrics WHERE ticker IN (SELECT ticker FROM universe WHERE universe = 'large_cap' AND sector = 'AFRICA')")
def c15(spark, d):
    return keep(uni.restrict(metrics(spark, d), uni.members(views.universe(spark, d), "large_cap", "Africa")), "ticker", *TECH)


@query("g03_sector_union", "SELECT DISTINCT ticker FROM universe WHERE sector IN ('AMERICA', 'ASIA')")
def g03(spark, d):
    u = views.universe(spark, d)
    return uni.members(u, "all", "AMERICA").union(uni.members(u, "large_cap", "AMERICA")).union(uni.members(u, "all", "ASIA")).distinct()


@query("d30_universe_info", "SELECT universe, sector, count(DISTINCT ticker) AS n_tickers FROM universe GROUP BY 1, 2")
def d30(spark, d):
    return uni.universe_info(views.universe(spark, d))


# Scores and funnel --------------------------------------------------------------
oracle.define("quick_scored", """
  SELECT *, CASE WHEN score >= 65 THEN 'bullish' WHEN score <= 35 THEN 'bearish' ELSE 'neutral' END AS signal FROM (
  SELECT *, greatest(0.0, least(100.0, 50.0
    + CASE WHEN coalesce(rsi, 50) < 30 THEN 20 WHEN rsi > 70 THEN -20 WHEN coalesce(rsi, 50) BETWEEN 40 AND 60 THEN 5 ELSE 0 END
    + CASE WHEN price_vs_sma20 > 5 THEN 10 WHEN price_vs_sma20 > 0 THEN 5 WHEN price_vs_sma20 < -5 THEN -10 ELSE 0 END
    + CASE WHEN volume_ratio > 1.5 THEN 5 ELSE 0 END
    + CASE WHEN pe_ratio > 10 AND pe_ratio < 25 THEN 10 WHEN pe_ratio > 50 THEN -5 ELSE 0 END
    + CASE WHEN returns_5d > 5 THEN 10 WHEN returns_5d > 0 THEN 5 WHEN returns_5d < -5 THEN -10 ELSE 0 END))::DOUBLE AS score FROM metrics)""")


@query("h14_quick_score", "SELECT ticker, score FROM quick_scored")
def h14(spark, d):
    return funnel.quick_scores(metrics(spark, d)).select("ticker", "score")


@query("h16_signal", "SELECT ticker, signal FROM quick_scored")
def h16(spark, d):
    return funnel.quick_scores(metrics(spark, d)).select("ticker", "signal")


@query("f03_batch_quick", """SELECT u.ticker, coalesce(q.score, 0.0) AS score, coalesce(q.signal, 'error') AS signal
  FROM (SELECT ticker FROM instrument UNION ALL SELECT DISTINCT ticker FROM recommendations WHERE ticker NOT IN (SELECT ticker FROM instrument)) u
  LEFT JOIN quick_scored q USING (ticker)""")
def f03(spark, d):
    inst = views.instrument(spark, d).select("ticker")
    wanted = inst.union(views.recommendations(spark, d).select("ticker").distinct().join(inst, "ticker", "left_anti"))
    return funnel.quick_scores(metrics(spark, d), wanted).select("ticker", "score", "signal").orderBy(F.desc("score"), "ticker")


oracle.define("tech_signal", """
  SELECT *, CASE WHEN signal_score > 0 THEN 'BULLISH' WHEN signal_score < 0 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction, abs(signal_score) AS confidence FROM (
  SELECT *, CAST(greatest(-100, least(100, s2 + CASE trend WHEN 'Strong Uptrend' THEN 10 WHEN 'Uptrend' THEN 5 WHEN 'Strong Downtrend' THEN -10 WHEN 'Downtrend' THEN -5 ELSE 0 END)) AS INTEGER) AS signal_score
  FROM (SELECT *, CASE WHEN volume_ratio > 1.5 AND s1 > 0 THEN s1 + 10 WHEN volume_ratio > 1.5 AND s1 < 0 THEN s1 - 10
      WHEN volume_ratio < 0.5 AND volume_ratio <> 0 THEN trunc(s1 * 0.8) ELSE s1 END AS s2
    FROM (SELECT *, CAST(CASE WHEN rsi_14 <> 0 AND rsi_14 < 30 THEN 15 WHEN rsi_14 <> 0 AND rsi_14 < 40 THEN 5 WHEN rsi_14 > 70 THEN -15 WHEN rsi_14 > 60 THEN -5 ELSE 0 END
        + CASE WHEN macd <> 0 AND macd_signal <> 0 AND macd_hist <> 0 THEN
            CASE WHEN macd > macd_signal AND macd_hist > 0 THEN 15 WHEN macd < macd_signal AND macd_hist < 0 THEN -15 ELSE 0 END
            + CASE WHEN macd_hist > 0.1 THEN 5 WHEN macd_hist < -0.1 THEN -5 ELSE 0 END ELSE 0 END
        + CASE WHEN sma_20 <> 0 AND sma_50 <> 0 AND sma_200 <> 0 THEN CASE WHEN sma_20 > sma_50 AND sma_50 > sma_200 THEN 25
            WHEN sma_20 < sma_50 AND sma_50 < sma_200 THEN -25 WHEN sma_20 > sma_50 THEN 10 WHEN sma_20 < sma_50 THEN -10 ELSE 0 END ELSE 0 END
        + CASE WHEN vs_sma20 > 5 THEN 10 WHEN vs_sma20 > 2 THEN 5 WHEN vs_sma20 < -5 THEN -10 WHEN vs_sma20 < -2 THEN -5 ELSE 0 END AS DOUBLE) AS s1 FROM snap)))""")
LEVEL = "CASE WHEN confidence > 70 THEN 'Very High' WHEN confidence > 50 THEN 'High' WHEN confidence > 30 THEN 'Medium' WHEN confidence > 15 THEN 'Low' ELSE 'Very Low' END"
SIGREC = "CASE WHEN direction = 'BULLISH' AND confidence > 50 THEN 'STRONG BUY' WHEN direction = 'BULLISH' AND confidence > 30 THEN 'BUY' WHEN direction = 'BEARISH' AND confidence > 50 THEN 'STRONG SELL' WHEN direction = 'BEARISH' AND confidence > 30 THEN 'SELL' ELSE 'HOLD' END"


def technical(spark, d):
    return scoring.technical_signal(snapshot.flat_snapshot(views.bars(spark, d)))


@query("h13_technical_signal", f"SELECT ticker, signal_score, direction, confidence, {LEVEL} AS confidence_level, {SIGREC} AS recommendation FROM tech_signal")
def h13(spark, d):
    return technical(spark, d).select("ticker", "signal_score", "direction", "confidence", "confidence_level", "recommendation")


oracle.define("fund_scored", """
  SELECT *, CASE WHEN fundamental_score >= 80 THEN 'STRONG BUY' WHEN fundamental_score >= 65 THEN 'BUY' WHEN fundamental_score >= 35 THEN 'HOLD'
    WHEN fundamental_score >= 20 THEN 'SELL' ELSE 'STRONG SELL' END AS rating FROM (SELECT ticker, greatest(0.0, least(100.0, 50
    + CASE WHEN pe_ratio <> 0 AND pe_ratio < 15 THEN 10 WHEN pe_ratio > 30 THEN -10 ELSE 0 END
    + CASE WHEN peg_ratio <> 0 AND peg_ratio < 1 THEN 10 WHEN peg_ratio > 2 THEN -5 ELSE 0 END
    + CASE WHEN profit_margin > 0.20 THEN 10 WHEN profit_margin <> 0 AND profit_margin < 0.05 THEN -10 ELSE 0 END
    + CASE WHEN roe > 0.15 THEN 10 WHEN roe <> 0 AND roe < 0.05 THEN -5 ELSE 0 END
    + CASE WHEN revenue_growth > 0.15 THEN 10 WHEN revenue_growth < 0 THEN -10 ELSE 0 END
    + CASE WHEN earnings_growth > 0.15 THEN 5 WHEN earnings_growth < 0 THEN -5 ELSE 0 END
    + CASE WHEN debt_to_equity < 50 THEN 5 WHEN debt_to_equity > 150 THEN -10 ELSE 0 END
    + CASE WHEN current_ratio > 1.5 THEN 5 WHEN current_ratio <> 0 AND current_ratio < 1 THEN -10 ELSE 0 END))::DOUBLE AS fundamental_score FROM fundamentals)""")


@query("h17_fundamental_score", "SELECT ticker, fundamental_score, rating FROM fund_scored")
def h17(spark, d):
    return scoring.fundamental_table(views.fundamentals(spark, d)).select("ticker", "fundamental_score", "rating")


oracle.define("medium_scored", """
  SELECT q.*, t.signal_score, f.fundamental_score, greatest(0.0, least(100.0, q.score + CASE t.direction WHEN 'BULLISH' THEN 15 WHEN 'BEARISH' THEN -15 ELSE 0 END
    + (coalesce(f.fundamental_score, 50) - 50) / 5)) AS medium_score
  FROM quick_scored q LEFT JOIN tech_signal t ON t.ticker = q.ticker LEFT JOIN fund_scored f ON f.ticker = q.ticker""")


@query("h15_medium_score", "SELECT ticker, round(medium_score, 6) AS medium_score FROM medium_scored")
def h15(spark, d):
    m = funnel.medium_scores(funnel.quick_scores(metrics(spark, d)), technical(spark, d), scoring.fundamental_table(views.fundamentals(spark, d)))
    return keep(m, "ticker", "medium_score")


CONS = """CASE WHEN up > down THEN 'BULLISH' WHEN down > up THEN 'BEARISH' ELSE 'MIXED' END"""
oracle.define("consensus", f"""SELECT ticker, direction, rating, {CONS} AS consensus FROM (
  SELECT coalesce(t.ticker, f.ticker) AS ticker, direction, rating,
    CASE WHEN direction = 'BULLISH' THEN 1 ELSE 0 END + CASE WHEN rating LIKE '%BUY%' THEN 1 ELSE 0 END AS up,
    CASE WHEN direction = 'BEARISH' THEN 1 ELSE 0 END + CASE WHEN rating LIKE '%SELL%' THEN 1 ELSE 0 END AS down
  FROM (SELECT * FROM tech_signal WHERE sma_50 < sma_200) t FULL OUTER JOIN (SELECT * FROM fund_scored WHERE ticker IN (SELECT ticker FROM fundamentals WHERE pe_ratio > 20)) f ON t.ticker = f.ticker)""")


def consensus(spark, d):
    t = technical(spark, d).where("sma_50 < sma_200")
    f = scoring.fundamental_table(views.fundamentals(spark, d).where("pe_ratio > 20"))
    return scoring.consensus_table(t, f)


@query("c13_consensus_join", "SELECT ticker, direction, rating FROM consensus")
def c13(spark, d):
    return consensus(spark, d).select("ticker", "direction", "rating")


@query("h18_consensus", "SELECT ticker, consensus FROM consensus")
def h18(spark, d):
    return consensus(spark, d).select("ticker", "consensus")


oracle.define("latest_sent", """
  SELECT ticker, arg_max(news_sentiment_score, ROW(ts, event_id)) AS news_sentiment_score FROM sent_feat GROUP BY ticker""")
oracle.define("tiers", """
  SELECT 'quick' AS tier, ticker, score FROM t1 UNION ALL SELECT 'medium', ticker, medium_score FROM t2 UNION ALL SELECT 'deep', ticker, deep_score FROM t3""")
oracle.define("t1", "SELECT * FROM medium_scored ORDER BY score DESC, ticker LIMIT 20")
oracle.define("t2", "SELECT * FROM t1 ORDER BY medium_score DESC, ticker LIMIT 10")
oracle.define("t3", """SELECT t2.ticker, greatest(0.0, least(100.0, ((coalesce(signal_score, 0) + 100.0) / 2 + coalesce(fundamental_score, 50) + coalesce(s.news_sentiment_score, 50)) / 3)) AS deep_score
  FROM t2 LEFT JOIN latest_sent s USING (ticker) ORDER BY 2 DESC, ticker LIMIT 5""")


def tiers(spark, d):
    from equityspark.operators import text

    sent = text.sentiment_features(views.sentiment_raw(spark, d), "body")
    newest = latest_per(sent, ["ticker"], F.struct("ts", "event_id"), ["news_sentiment_score"])
    return funnel.tiered(funnel.quick_scores(metrics(spark, d)), technical(spark, d),
                         scoring.fundamental_table(views.fundamentals(spark, d)), newest)


@query("f04_tiered_funnel", "SELECT tier, ticker, round(score, 6) AS score, CASE WHEN score >= 65 THEN 'bullish' WHEN score <= 35 THEN 'bearish' ELSE 'neutral' END AS signal FROM tiers")
def f04(spark, d):
    return keep(tiers(spark, d), "tier", "ticker", "score", "signal")


@query("d38_tier_summary", "SELECT 'screened' AS tier, count(*) AS n FROM metrics UNION ALL SELECT tier, count(*) FROM tiers GROUP BY tier")
def d38(spark, d):
    return funnel.tier_summary(metrics(spark, d), tiers(spark, d))


@query("h21_confidence_level", "SELECT ticker, date, model, CASE WHEN confidence > 70 THEN 'Very High' WHEN confidence > 50 THEN 'High' WHEN confidence > 30 THEN 'Medium' WHEN confidence > 15 THEN 'Low' ELSE 'Very Low' END AS level FROM predictions")
def h21(spark, d):
    return views.predictions(spark, d).select("ticker", "date", "model", rules.confidence_level(F.col("confidence")).alias("level"))


PREDREC = """CASE WHEN direction = 'bullish' AND confidence > 70 AND expected_return > 3 THEN 'STRONG BUY' WHEN direction = 'bullish' AND confidence > 60 AND expected_return > 1 THEN 'BUY'
  WHEN direction = 'bearish' AND confidence > 70 AND expected_return < -3 THEN 'STRONG SELL' WHEN direction = 'bearish' AND confidence > 60 AND expected_return < -1 THEN 'SELL' ELSE 'HOLD' END"""
PREDSCORE = "CASE direction WHEN 'bullish' THEN least(100, confidence + expected_return * 5) WHEN 'bearish' THEN greatest(-100, -confidence + expected_return * 5) ELSE 0 END"


@query("h19_recommendation", f"SELECT ticker, date, model, {PREDREC} AS recommendation FROM predictions")
def h19(spark, d):
    p = views.predictions(spark, d)
    return p.select("ticker", "date", "model", rules.recommendation(F.col("direction"), F.col("confidence"), F.col("expected_return")).alias("recommendation"))


@query("h20_prediction_score", f"SELECT ticker, date, model, round({PREDSCORE}, 6) AS score FROM predictions")
def h20(spark, d):
    p = views.predictions(spark, d)
    return keep(p.withColumn("score", rules.prediction_score(F.col("direction"), F.col("confidence"), F.col("expected_return"))), "ticker", "date", "model", "score")


@query("i18_score_choice", f"""SELECT t.ticker, round(CASE WHEN p.score IS NOT NULL THEN p.score ELSE t.signal_score END, 6) AS signal_score,
    CASE WHEN p.score IS NOT NULL THEN upper(p.direction) ELSE t.direction END AS direction,
    CASE WHEN p.score IS NOT NULL THEN p.recommendation ELSE {SIGREC.replace('direction', 't.direction').replace('confidence', 't.confidence')} END AS recommendation,
    p.score IS NOT NULL AS ml_powered
  FROM tech_signal t LEFT JOIN (SELECT ticker, direction, {PREDSCORE} AS score, {PREDREC} AS recommendation FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k
    FROM predictions WHERE model = 'momentum') WHERE k = 1 AND direction <> 'neutral') p ON p.ticker = t.ticker""")
def i18(spark, d):
    p = views.predictions(spark, d).where("model = 'momentum'")
    last = latest_per(p, ["ticker"], "date", ["direction", "confidence", "expected_return"]).where("direction <> 'neutral'")
    args = (F.col("direction"), F.col("confidence"), F.col("expected_return"))
    last = last.withColumns({"score": rules.prediction_score(*args), "recommendation": rules.recommendation(*args)})
    return keep(scoring.choose_score(technical(spark, d), last), "ticker", "signal_score", "direction", "recommendation", "ml_powered")
