"""Indicators, labels and quality rules on hand-made series."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions.core import sanitize
from equityspark.operators import features, labels, quality
from equityspark.plans import snapshot


def col(df, name, ticker="A"):
    return [r[name] for r in df.where(F.col("ticker") == ticker).orderBy("date").collect()]


def prices(n, seed=0):
    return list(100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n))))


@pytest.mark.parametrize(("span", "block"), [(2, 4), (26, 7), (200, 64), (9, 512)])
def test_ema_equals_recurrence_for_any_block(make_bars, block, span):
    p = prices(90)
    got = col(ind.add_ema(make_bars({"A": p, "B": p[::-1]}), "close", {"e": span}, block), "e")
    want = pd.Series(p).ewm(span=span, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-12)


def test_ema_span_must_exceed_one(make_bars):
    with pytest.raises(ValueError):
        ind.add_ema(make_bars({"A": [1, 2]}), "close", {"e": 1})


@pytest.mark.parametrize("n", [13, 14, 15])
def test_rsi_starts_at_row_14(make_bars, n):
    got = col(make_bars({"A": list(range(1, n + 1))}).withColumn("r", ind.rsi(F.col("close"))), "r")
    assert got[:13] == [None] * 13
    assert all(v == 100.0 for v in got[13:])


def test_rsi_constant_price_is_null(make_bars):
    assert set(col(make_bars({"A": [5.0] * 20}).withColumn("r", ind.rsi(F.col("close"))), "r")) == {None}


def test_no_leak_across_tickers(make_bars):
    b = features.add_volatility(features.add_lags(make_bars({"A": [10.0] * 25, "B": [500.0] * 25})))
    assert col(b, "lag_return_1d", "B")[0] is None
    assert max(v for v in col(b, "atr_14", "B") if v is not None) < 20
    assert col(b, "lag_return_20d", "B")[:20] == [None] * 20


def test_constant_price_bands(make_bars):
    up, mid, lo = ind.bollinger(F.col("close"))
    b = features.add_bands(make_bars({"A": [7.0] * 21}).withColumns({"bb_upper": up, "bb_middle": mid, "bb_lower": lo}))
    assert col(b, "bb_upper")[-1] == col(b, "bb_lower")[-1] == 7.0
    assert col(b, "bb_pct_b")[-1] is None and col(b, "bb_width")[-1] == 0.0


def test_rolling_median_matches_pandas(make_bars):
    p = prices(80, 3)
    got = col(make_bars({"A": p}).withColumn("m", ind.rolling_median(F.col("close"), 10)), "m")
    assert np.allclose(got, pd.Series(p).rolling(10, min_periods=1).median())


def test_obv(make_bars):
    got = col(make_bars({"A": [1, 2, 2, 1]}, 10).withColumn("o", ind.obv(F.col("close"), F.col("volume"))), "o")
    assert got == [0.0, 10.0, 10.0, 0.0]


def test_relative_strength_without_or_with_flat_benchmark(make_bars):
    b = make_bars({"A": prices(22), "SPY": [50.0] * 22})
    assert set(col(features.add_relative_strength(b, "SPY"), "rs_vs_benchmark_20d")) == {None}
    assert set(col(features.add_relative_strength(b, "NONE"), "rs_vs_benchmark_20d")) == {None}


def test_labels_on_rising_series(make_bars):
    out = labels.forward_labels(make_bars({"A": list(range(1, 31))}))
    assert out.count() == 10
    assert set(col(out, "direction_5d")) == {1} and set(col(out, "max_drawdown_5d")) == {0.0}


def test_forward_drawdown_uses_running_peak(make_bars):
    b = make_bars({"A": [100, 110, 99, 120, 60, 90] + [90] * 20})
    assert math.isclose(col(labels.forward_labels(b), "max_drawdown_5d")[0], -50.0)


def test_threshold_labels_drop_the_band(spark):
    df = spark.createDataFrame([(-3.0,), (-1.0,), (1.0,), (2.0,)], "r double")
    assert sorted((r["r"], r["label"]) for r in labels.threshold_labels(df, "r", 2.0).collect()) == [(-3.0, 0), (2.0, 1)]


def test_tertiles_by_edges_and_by_rank(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id int, r double")
    got = [r["tertile"] for r in labels.tertile_labels(df, "r", ["id"]).orderBy("id").collect()]
    assert got == list(pd.qcut(pd.Series(range(30)), 3, labels=False))
    flat = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, r double")
    got = [r["tertile"] for r in labels.tertile_labels(flat, "r", ["id"]).collect()]
    assert sorted(got) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_validity_and_counters(spark):
    rows = [("A", i, 1.0, 2.0, 1.0, 1.5, 5.0) for i in range(12)]
    rows += [("A", 12, 1.0, 1.0, 2.0, 1.5, 5.0), ("A", 13, 1.0, 2.0, 1.0, 0.0, 5.0), ("A", 14, 1.0, 2.0, 1.0, 1.0, 0.0), ("A", 15, 1.0, 2.0, 1.0, None, 5.0)]
    df = spark.createDataFrame(rows, "ticker string, date int, open double, high double, low double, close double, volume double")
    assert quality.valid_bars(df).count() == 12
    c = quality.quality_counters(df).first()
    assert (c["total_rows"], c["invalid_ohlcv"], c["outliers_detected"], c["rows_excluded"]) == (16, 4, 0, 4)


def test_one_jump_is_an_outlier(make_bars):
    p = [100 + 0.1 * (i % 3) for i in range(400)]
    p[200:] = [x * 1.6 for x in p[200:]]
    b = make_bars({"A": p})
    assert quality.drop_outliers(b).count() == 399


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], 3)], "x double, a array<double>, n int")
    assert tuple(sanitize(df).first()) == (None, [1.0, None], 3)


def test_calendar_and_missing_date(make_bars):
    b = features.add_calendar(make_bars({"A": [1.0] * 70}))
    assert col(b, "days_to_earnings")[:2] == [63, 62] and col(b, "days_to_earnings")[63] == 63
    assert col(b, "day_of_week")[0] == 2  # 2020-01-01 was a Wednesday
    assert features.add_calendar(b.select("close")).first()["month"] is None


def test_nested_snapshot_groups(make_bars):
    r = snapshot.nested_snapshot(snapshot.flat_snapshot(make_bars({"A": prices(210)}))).first()
    assert r["rsi"]["signal"] in ("Overbought", "Oversold", "Neutral")
    assert r["moving_averages"]["SMA_200"] is not None and r["support_resistance"]["support"] <= r["current_price"]


def test_inference_features_have_no_nulls(make_bars):
    out = features.inference_features(snapshot.flat_snapshot(make_bars({"A": prices(30)})))
    assert None not in tuple(out.first())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 10_000), min_size=25, max_size=60))
def test_feature_invariants(make_bars, ps):
    b = make_bars({"A": ps, "SPY": ps[::-1]})
    up, mid, lo = ind.bollinger(F.col("close"))
    b = features.add_bands(b.withColumns({"bb_upper": up, "bb_middle": mid, "bb_lower": lo}))
    b = features.add_calendar(features.add_relative_strength(features.add_volatility(b), "SPY"))
    for r in b.collect():
        assert r["atr_14"] is None or r["atr_14"] >= 0
        assert r["realized_vol_20d"] is None or r["realized_vol_20d"] >= 0
        assert r["volatility_regime"] in (0, 1, None)
        assert r["bb_width"] is None or r["bb_width"] >= 0
        assert 0 <= r["day_of_week"] <= 6 and 1 <= r["month"] <= 12 and 1 <= r["days_to_earnings"] <= 63
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)


def test_ema_of_a_very_long_span(spark, make_bars):
    from equityspark.functions import indicators as ind

    values = [100 + (i * 7919 % 97) for i in range(3000)]
    got = ind.add_ema(make_bars({"A": values}), "close", {"long": 4000, "short": 3}).orderBy("date").collect()
    for span, name in ((4000, "long"), (3, "short")):
        e, a = None, 2 / (span + 1)
        for v, r in zip(values, got, strict=True):
            e = v if e is None else e + a * (v - e)
            assert abs(r[name] - e) < 1e-7


def test_tertiles_keep_rows_without_a_value(spark):
    from equityspark.operators import labels

    rows = [(i, 1.0 if i % 3 else None) for i in range(20)] + [(100 + i, float("nan")) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    got = {r["k"]: r["tertile"] for r in labels.tertile_labels(df, "v", ["k"]).collect()}
    known = [k for k, v in rows if v == 1.0]
    assert len(got) == 23 and all(got[k] is None for k, v in rows if v != 1.0)
    # ties go by the number, not by its text: 2 before 10
    assert [got[k] for k in known] == sorted(got[k] for k in known) and set(got[k] for k in known) == {0, 1, 2}


def test_quantiles_leave_nan_out(spark):
    from equityspark.functions.quantiles import exact_quantiles

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan"))], "key string, value double")
    assert exact_quantiles(df, [0.0, 0.5, 1.0]).first()["quantiles"] == [1.0, 2.0, 3.0]


def test_equity_curve_fills_calendar_days_after_the_product(spark):
    import datetime as dt

    from equityspark.operators import backtest

    day = dt.date
    rows = [("A", day(2024, 1, 3), 10.0), ("A", day(2024, 1, 3), -50.0), ("A", day(2024, 1, 1), 20.0), ("A", day(2024, 2, 1), 7.0),
            ("B", day(2024, 1, 5), None), ("C", day(2023, 12, 1), 4.0), (None, day(2024, 1, 2), 9.0)]
    trades = spark.createDataFrame(rows, "ticker string, exit_date date, net_return_pct double")

    def curve(tickers=None):
        out = backtest.equity_curve(trades, "2024-01-01", "2024-01-05", tickers)
        return out, {(r["ticker"], r["date"].day): r["equity"] for r in out.collect()}

    out, got = curve()
    want = {"A": [120.0, 120.0, 66.0, 66.0, 66.0], "B": [100.0] * 5, "C": [100.0] * 5, None: [100.0] * 5}
    assert set(got) == {(t, i) for t in want for i in range(1, 6)} and out.count() == 20
    assert all(abs(got[t, i] - w[i - 1]) < 1e-9 for t, w in want.items() for i in range(1, 6))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate explode") < plan.index("Window")  # days come last
    _, listed = curve(spark.createDataFrame([("A",), ("D",)], "ticker string"))
    assert {t for t, _ in listed} == {"A", "D"} and listed["D", 3] == 100.0 and abs(listed["A", 5] - 66.0) < 1e-9


def test_weights_are_sent_to_the_rows_and_regimes_read_the_series_once(spark):
    from equityspark.operators import ensemble, features

    p = spark.createDataFrame([("A", 1, "m", "bullish", 60.0, 1.0), ("A", 1, "n", "bearish", 70.0, -1.0)], "ticker string, date int, model string, direction string, confidence double, expected_return double")
    w = spark.createDataFrame([("m", 0.7)], "model string, weight double")
    out = ensemble.dynamic_weighting(p, w)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
    assert out.first()["direction"] == "bearish"  # the unknown model weighs 1
    bars = spark.createDataFrame([("A", i, 100.0 + i % 7) for i in range(80)] + [(None, 1, 1.0)], "ticker string, date int, close double")
    g = features.regime_inputs(bars)
    assert "Join" not in g._jdf.queryExecution().optimizedPlan().toString()
    assert g.count() == 80 and g.select("med_vol", "med_dev").distinct().count() == 1


def test_a_tier_reads_the_kept_tickers_only(spark):
    from equityspark.plans import funnel

    bars = spark.createDataFrame([(f"T{i}", d, float(i)) for i in range(40) for d in range(3)], "ticker string, date int, close double")
    newest = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("v"))
    quick = newest.select("ticker", F.col("v").alias("score"), F.lit("neutral").alias("signal"))
    technical = newest.select("ticker", F.lit("BULLISH").alias("direction"), F.lit(10).alias("signal_score"))
    fundamental = newest.select("ticker", F.lit(50.0).alias("fundamental_score"))
    sentiment = newest.select("ticker", F.lit(60.0).alias("news_sentiment_score"))
    out = funnel.tiered(quick, technical, fundamental, sentiment, 4, 3, 2)
    got = [(r["tier"], r["ticker"]) for r in out.collect()]
    assert sorted(got) == sorted([("quick", f"T{i}") for i in (36, 37, 38, 39)] + [("medium", f"T{i}") for i in (37, 38, 39)] + [("deep", "T37"), ("deep", "T38")])
    plan = funnel._only(technical, quick.where("ticker = 'T5'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("T5")  # the names filter the rows below the aggregation
