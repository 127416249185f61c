"""Screens, scores, text rules, ensembles and backtest metrics on hand-made rows."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from equityspark.operators import annotate, backtest, ensemble, memory, scoring, screening, social, text, universe
from equityspark.plans import funnel, stock_record
from equityspark.streaming import event_log


def test_criteria_null_and_missing_fields_fail(spark):
    m = spark.createDataFrame([("A", 10.0, "x"), ("B", None, "y")], "ticker string, v double, s string")
    crit = [screening.Criterion("v", ">", 5, 2.0), screening.Criterion("s", "in", ("x",), 1.0), screening.Criterion("gone", "<", 1, 1.0)]
    out = {r["ticker"]: r for r in screening.evaluate(m, crit, False).collect()}
    assert out["A"]["passed"] and out["A"]["score"] == 75.0 and not out["B"]["passed"]
    assert out["B"]["reasons"] == ["✗ v > 5", "✗ s in ('x',)", "✗ gone < 1"]
    assert screening.evaluate(m, []).first()["score"] == 100.0
    assert screening.evaluate(m, [screening.Criterion("v", ">", 5, 0.0)]).first()["score"] == 0.0
    with pytest.raises(ValueError):
        screening.predicate(screening.Criterion("v", "~", 1), m.columns)
    with pytest.raises(ValueError):
        screening.run_named(m, "nothing")
    assert screening.list_screens(spark).count() == 10


def test_universe_errors_and_case(spark):
    u = spark.createDataFrame([("all", "Tech", "A"), ("all", "Energy", "B"), ("all", "tech", "A")], "universe string, sector string, ticker string")
    assert [r[0] for r in universe.members(u, "all", "TECH").collect()] == ["A"]
    assert universe.members(u, "all", "none").count() == 0
    assert [r[0] for r in universe.filter_members(u, "all", ["tech", "energy"], ["A"]).collect()] == ["B"]
    with pytest.raises(ValueError):
        universe.require_universe(u, "other")


SNAP = ("ticker string, rsi_14 double, macd double, macd_signal double, macd_hist double, sma_20 double, sma_50 double, sma_200 double, "
        "vs_sma20 double, volume_ratio double, trend string")


def test_technical_signal_by_hand(spark):
    rows = [
        ("up", 25.0, 2.0, 1.0, 1.0, 30.0, 20.0, 10.0, 6.0, 2.0, "Strong Uptrend"),      # 15+15+5+25+10+10+10
        ("thin", 65.0, None, None, None, 30.0, 20.0, 25.0, 3.0, 0.4, "Uptrend"),          # (-5+10+5)*0.8 -> 8, +5
        ("down", 75.0, 1.0, 2.0, -1.0, 10.0, 20.0, 30.0, -6.0, 1.6, "Strong Downtrend"),
        ("none", None, None, None, None, None, None, None, None, None, "Unknown"),
    ]
    out = {r["ticker"]: r for r in scoring.technical_signal(spark.createDataFrame(rows, SNAP)).collect()}
    assert [out[t]["signal_score"] for t in ("up", "thin", "down", "none")] == [90, 13, -90, 0]
    assert out["up"]["recommendation"] == "STRONG BUY" and out["down"]["direction"] == "BEARISH"
    assert out["up"]["confidence_level"] == "Very High" and out["none"]["signals"] == []
    assert out["thin"]["signals"][-2:] == ["Low volume (0.40x) - reduced confidence", "Uptrend in place"]


def test_fundamental_zero_counts_as_missing(spark):
    cols = "ticker string, pe_ratio double, peg_ratio double, profit_margin double, roe double, revenue_growth double, earnings_growth double, debt_to_equity double, current_ratio double"
    rows = [("good", 10.0, 0.5, 0.3, 0.2, 0.2, 0.2, 0.0, 2.0), ("zero", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    out = {r["ticker"]: r for r in scoring.fundamental_table(spark.createDataFrame(rows, cols)).collect()}
    assert (out["good"]["fundamental_score"], out["good"]["rating"]) == (100.0, "STRONG BUY")
    assert out["zero"]["fundamental_score"] == 55.0 and out["zero"]["fundamental_signals"] == ["Low debt levels (D/E: 0.0)"]


def test_quick_scores_mark_missing_tickers(spark):
    m = spark.createDataFrame([("A", 25.0, 6.0, 2.0, 20.0, 6.0)], "ticker string, rsi double, price_vs_sma20 double, volume_ratio double, pe_ratio double, returns_5d double")
    want = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    out = {r["ticker"]: (r["score"], r["signal"]) for r in funnel.quick_scores(m, want).collect()}
    assert out == {"A": (100.0, "bullish"), "Z": (0.0, "error")}


def test_news_category_precedence_and_keyword(spark):
    titles = [("Fed fears hit earnings",), ("Inflation data",), ("Rival chips",), ("A quiet day",), (None,)]
    df = spark.createDataFrame(titles, "title string")
    got = [r[0] for r in df.select(text.news_category(F.col("title"))).collect()]
    assert got == ["company_expected_revenue_news", "macro_news", "industry_peer_news", "company_specific_news", "company_specific_news"]
    kw = df.select(text.first_keyword(F.lit("Merger talk: acquisition of X"))).first()[0]
    assert kw == "acquisition"


def test_recover_json(spark):
    raw = [('{"a": 1}',), ('text ```json\n{"a": 2}\n``` tail',), ('well {"a": 3} done',), ("nothing",), ('{"a": broken',)]
    out = spark.createDataFrame(raw, "t string").select(text.recover_json(F.col("t"), "a int").alias("j"))
    assert [r["j"]["a"] if r["j"] else None for r in out.collect()] == [1, 2, 3, None, None]


def test_sections_and_scores_from_reports(spark):
    doc = "Intro\n**Risk Factors**:\n\nFirst **bold** line\nsecond line\n# Next\nend"
    df = spark.createDataFrame([(doc, "We do not buy this"), ("## Outlook\ngood\n\n# X", "Buy now")], "a string, b string")
    assert [r[0] for r in df.select(text.extract_section(F.col("a"), "Risk Factors")).collect()] == ["First bold line second line", ""]
    assert [r[0] for r in df.select(text.extract_section(F.col("a"), "Outlook")).collect()] == ["", "good"]
    assert [r[0] for r in df.select(text.report_score(F.col("b"))).collect()] == [50.0, 70.0]


def test_sentiment_features_defaults_and_wrapper(spark):
    raw = [("{}",), ('{"structured_sentiment": {"overall_sentiment": {"score": 80}, "sentiment_trend": {"trend": " Improving "}}, "news_count": 4}',), (None,)]
    out = text.sentiment_features(spark.createDataFrame(raw, "b string"), "b").collect()
    assert out[0]["news_sentiment_score"] == 50.0 and out[2]["news_sentiment_score"] == 50.0
    assert (out[1]["news_sentiment_score"], out[1]["news_sentiment_trend"], out[1]["news_sentiment_article_count"]) == (80.0, 1.0, 4.0)


def test_posts_dedup_and_document(spark):
    rows = [("twitter", 1, "A", "$A up", 5, 1, 0, 0), ("twitter", 1, "A", "$A up", 4, 1, 0, 1), ("reddit", None, "A", "x", 9, 9, 9, 0), ("twitter", 2, "A", "A", 50, 0, 0, 0)]
    posts = spark.createDataFrame(rows, "platform string, id long, ticker string, text string, likes long, comments long, shares long, copy int")
    d = social.deduplicate(posts, ["copy"])
    assert sorted((r["id"], r["likes"]) for r in d.collect()) == [(1, 5), (2, 50)]
    doc = social.posts_document(d, "2024-01-01").first()["document"]
    assert "TOTAL POSTS: 2" in doc and doc.index("1. A") < doc.index("2. $A up") and "No posts found." in doc
    v = {(r["id"], r["variant"]) for r in social.collect_variants(posts.where("id is not null")).collect()}
    assert v == {(1, "cashtag"), (2, "plain")}


def test_snap_to_trading_day(spark):
    d = datetime.date
    days = spark.createDataFrame([(d(2024, 1, 5),), (d(2024, 1, 9),), (d(2024, 1, 30),)], "date date")
    ev = spark.createDataFrame([(1, d(2024, 1, 5)), (2, d(2024, 1, 7)), (3, d(2024, 1, 8)), (4, d(2024, 1, 17)), (5, d(2024, 1, 22)), (6, d(2023, 12, 29))], "id int, date date")
    got = {r["id"]: r["chart_date"] for r in annotate.snap_to_trading_day(ev, days).collect()}
    assert got == {1: d(2024, 1, 5), 2: d(2024, 1, 5), 3: d(2024, 1, 9), 6: d(2024, 1, 5)}


def preds(spark, *rows):
    day = datetime.date(2024, 1, 2)
    return spark.createDataFrame([("A", day, f"m{i}", *r) for i, r in enumerate(rows)], "ticker string, date date, model string, direction string, confidence double, expected_return double")


def test_ensembles(spark):
    tie = preds(spark, ("bullish", 80.0, 2.0), ("bearish", 60.0, -2.0))
    v = ensemble.voting(tie).first()
    assert (v["direction"], v["confidence"], v["score"], v["recommendation"]) == ("neutral", 70.0, 0.0, "HOLD")
    one = ensemble.voting(preds(spark, ("bullish", 95.0, 4.0))).first()
    assert (one["direction"], one["confidence"], one["score"], one["recommendation"]) == ("bullish", 100.0, 100.0, "STRONG BUY")
    assert ensemble.unanimous(tie).first()["recommendation"] == "HOLD"
    assert ensemble.unanimous(preds(spark, ("neutral", 90.0, 9.0))).first()["unanimous"] is False
    failed = ensemble.averaging(preds(spark, (None, None, None))).first()
    assert (failed["direction"], failed["confidence"], failed["error"]) == ("neutral", 0.0, "All models failed")
    w = spark.createDataFrame([("m0", 0.0), ("m1", 0.0)], "model string, weight double")
    assert ensemble.dynamic_weighting(tie, w).first()["confidence"] == 70.0
    w = spark.createDataFrame([("m1", 3.0)], "model string, weight double")
    dw = ensemble.dynamic_weighting(tie, w).first()
    assert (dw["direction"], dw["confidence"], dw["expected_return"]) == ("bearish", 65.0, -1.0)
    with pytest.raises(ValueError):
        ensemble.combine(tie, "magic")


def trade_frame(spark, returns, conf=None):
    day = datetime.date(2024, 1, 1)
    rows = [("A", day + datetime.timedelta(days=i), day + datetime.timedelta(days=i + 1), float(r), float(conf[i] if conf else 60), r > 0, r > 0) for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "ticker string, entry_date date, exit_date date, net_return_pct double, ml_confidence double, prediction_correct boolean, profitable boolean")


def test_trade_metrics_edges(spark):
    win = backtest.trade_stats(trade_frame(spark, [1, 2])).first()
    assert win["profit_factor"] == math.inf and win["avg_loser"] == 0.0
    lose = backtest.trade_stats(trade_frame(spark, [-1, 0])).first()
    assert lose["profit_factor"] == 0.0 and lose["winning_trades"] == 0 and lose["losing_trades"] == 2
    assert backtest.trade_stats(trade_frame(spark, [1])).first()["trade_sharpe"] == 0.0
    s = backtest.streaks(trade_frame(spark, [1, 1, -1, 1, 1, 1, -1, -1])).first()
    assert (s["max_consecutive_wins"], s["max_consecutive_losses"]) == (3, 2)
    assert backtest.calibration_curve(trade_frame(spark, [1, -1, 1], [70, 70, 70])).count() == 0
    assert backtest.calibration_curve(trade_frame(spark, list(range(1, 21)), list(range(50, 70)))).count() == 10


def test_equity_curve_and_metrics(spark):
    t = trade_frame(spark, [10, -50])
    curve = backtest.equity_curve(t, "2024-01-01", "2024-01-05")
    assert [round(r["equity"], 6) for r in curve.orderBy("date").collect()] == [100.0, 110.0, 55.0, 55.0, 55.0]
    m = backtest.equity_metrics(curve).first()
    assert math.isclose(m["max_drawdown"], -50.0) and m["sharpe_ratio"] < 0
    nobody = spark.createDataFrame([("Z",)], "ticker string")
    flat = backtest.equity_metrics(backtest.equity_curve(t.where("false"), "2024-01-01", "2024-01-05", nobody)).first()
    assert (flat["sharpe_ratio"], flat["sortino_ratio"], flat["max_drawdown"], flat["calmar_ratio"]) == (0.0, 0.0, 0.0, 0.0)
    up = backtest.equity_metrics(backtest.equity_curve(trade_frame(spark, [1, 2]), "2024-01-01", "2024-01-05")).first()
    assert up["sortino_ratio"] == math.inf and up["calmar_ratio"] == math.inf


def test_backtest_entry_window_and_report(spark, make_bars):
    bars = make_bars({"A": [100 + i % 7 for i in range(150)]})
    p = bars.select("ticker", "date", F.lit("bullish").alias("direction"), F.lit(80.0).alias("confidence"), F.lit(3.0).alias("expected_return"))
    t = backtest.simulate(bars, p, "2020-01-01", "2020-05-29")
    assert t.count() == 150 - 50 - 6
    assert t.agg(F.min("entry_date")).first()[0] == datetime.date(2020, 2, 20)
    late = backtest.simulate(bars, p, "2020-04-10", "2020-05-29")
    compat = backtest.simulate(bars, p, "2020-04-10", "2020-05-29", compat=True)
    assert late.agg(F.min("entry_date")).first()[0] == datetime.date(2020, 4, 10)
    assert compat.count() > late.count()
    r = backtest.report(t, bars, "2020-01-01", "2020-05-29").first()
    assert "Total Trades: 94" in r["report"] and r["verdict"] in r["report"] and len(r["assessment"]) == 5
    bear = p.withColumn("direction", F.lit("bearish"))
    a = backtest.simulate(bars, bear, "2020-01-01", "2020-05-29").agg(F.sum("gross_return_pct")).first()[0]
    b = backtest.simulate(bars, bear, "2020-01-01", "2020-05-29", side_aware=True).agg(F.sum("gross_return_pct")).first()[0]
    assert math.isclose(a, -b, abs_tol=1e-6)


def test_memory_searches(spark):
    rows = [(i, "A" if i % 2 else "B", datetime.datetime(2024, 1, 1, i), [float(i), 1.0]) for i in range(1, 9)]
    a = spark.createDataFrame(rows, "doc_id long, ticker string, ts timestamp, embedding array<float>").repartition(3)
    top = [r["doc_id"] for r in memory.semantic_search(a, [8.0, 1.0], 2).collect()]
    assert top == [8, 7]
    q = spark.createDataFrame([(1, [8.0, 1.0]), (2, [0.0, 1.0])], "query_id long, query_vec array<double>")
    for metric in ("cosine", "l2sq"):
        got = {(r["query_id"], r["rank"]): r["doc_id"] for r in memory.batch_search(a, q, 2, metric).collect()}
        assert got == {(1, 1): 8, (1, 2): 7, (2, 1): 1, (2, 2): 2}
    one_by_one = {(r["query_id"], r["rank"]): r["doc_id"] for r in memory.batch_search(a, q, 2, block=1).collect()}
    assert one_by_one == {(1, 1): 8, (1, 2): 7, (2, 1): 1, (2, 2): 2}
    assert [r["doc_id"] for r in memory.past_analyses(a, 1).orderBy("ticker").collect()] == [7, 8]


def test_session_lines_hold_everything(spark):
    """One session at any length: metadata, scratchpad and 1,500 messages in order."""
    m = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(1500)], "conv_id long, turn long, role string, content string").repartition(4)
    notes = spark.createDataFrame([(1, "plan", "buy")], "conv_id long, key string, value string")
    lines = [r["body"] for r in memory.session_json(m, notes).orderBy("part", "turn").collect()]
    assert json.loads(lines[0]) == {"conv_id": 1, "messages": 1500, "first_turn": 0, "last_turn": 1499}
    assert json.loads(lines[1]) == {"key": "plan", "value": "buy"}
    assert [json.loads(x)["content"] for x in lines[2:]] == [f"m{t}" for t in range(1500)]


def test_progress_and_conflicts(spark):
    t = datetime.datetime
    rows = [(i, t(2024, 1, 1, i // 3), "x", "s1" if i % 2 else "s2", "HOT" if i % 3 else "B", "buy" if i < 8 else "sell") for i in range(12)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, source_agent string, ticker string, recommendation string")
    seq = event_log.progress(e).where("ticker = 'HOT'").orderBy("seq")
    assert [r["seq"] for r in seq.collect()] == list(range(1, 9))
    c = event_log.conflicts(e.withColumn("source", F.col("source_agent"))).collect()
    assert {r["ticker"] for r in c} == {"B"} or all(r["n_recommendations"] > 1 for r in c)


def test_summary_texts(spark):
    df = spark.createDataFrame([("A", "Acme", "Tech", 12.345, -1.5)], "ticker string, name string, sector string, latest_price double, price_change_percent double")
    assert df.select(stock_record.summary_line("2024-01-31")).first()[0] == "Stock analysis for A on 2024-01-31. Acme - Tech. Price: $12.35, Change: -1.50%"
