"""Chunked series equal whole-series windows; as-of joins equal pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions.core import series
from equityspark.operators import asof, features, labels
from equityspark.plans import long_series


@pytest.fixture(scope="module")
def hot(spark):
    """One ticker with most rows at uneven times, small ones, one row, gaps in price."""
    rng = np.random.default_rng(4)
    rows = []
    for ticker, n in (("HOT", 6000), ("MID", 900), ("FEW", 30), ("ONE", 1)):
        at = np.cumsum(rng.integers(1, 400, n)) + (86400 * 20 * (np.arange(n) > n // 2))
        close = np.exp(np.cumsum(rng.normal(0, 0.01, n))) * 50
        for i in range(n):
            rows.append((ticker, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(at[i])), float(close[i]), float(close[i] * 1.01), float(close[i] * 0.99), float(close[i]), float(rng.integers(1, 100))))
    return spark.createDataFrame(rows, "ticker string, date timestamp, open double, high double, low double, close double, volume double").repartition(6).cache()


def same(a, b, cols):
    a, b = ({(r["ticker"], r["date"]): r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for k, r in a.items():
        for c in cols:
            x, y = r[c], b[k][c]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (k, c, x, y)


@pytest.mark.parametrize("rows, bucket", [(1000, 600), (350, 3600), (10**6, 3600)])
def test_indicators_over_chunks_equal_whole_series(hot, rows, bucket):
    got = long_series.indicator_table(hot, rows=rows, bucket_seconds=bucket)
    assert set(got.columns) == set(ind.indicator_table(hot).columns)
    same(got, ind.indicator_table(hot), ind.INDICATOR_COLUMNS)


@pytest.mark.parametrize("rows", [200, 900])
def test_features_over_chunks_equal_whole_series(hot, rows):
    whole = labels.add_forward_labels(features.add_volatility(features.add_lags(hot)), drop_tail=False)
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumns({
        "obv": ind.obv(F.col("close"), F.col("volume")), "pos": F.row_number().over(series()) - 1, "days_to_earnings": ind.days_to_earnings(),
        "percent_since_start": ind.percent_since_start(F.col("close")), "drawdown_pct": (F.col("close") / F.max("close").over(so_far) - 1) * 100})
    got = long_series.feature_table(hot, rows=rows, bucket_seconds=900)
    assert set(got.columns) == set(whole.columns)
    same(got, whole, [c for c in whole.columns if c not in ("ticker", "date")])


def test_a_hot_ticker_is_dealt_to_many_chunks(hot):
    got = long_series.chunked(hot, before=100, after=20, rows=500, bucket_seconds=600)
    sizes = {(r["ticker"], r["_chunk"]): (r["own"], r["n"]) for r in got.groupBy("ticker", "_chunk").agg(F.count_if("_own").alias("own"), F.count("*").alias("n")).collect()}
    assert sum(own for own, _ in sizes.values()) == hot.count()
    hot_ones = [v for (t, _), v in sizes.items() if t == "HOT"]
    assert len(hot_ones) >= 11 and max(n for _, n in hot_ones) < 1500
    assert sorted(k for k in sizes if k[0] in ("FEW", "ONE")) == [("FEW", 0), ("ONE", 0)]


def test_chunks_of_daily_bars_ties_and_missing_dates(spark, make_bars):
    bars = make_bars({"A": [float(100 + i % 7) for i in range(400)], "B": [1.0, 2.0]})
    same(long_series.indicator_table(bars, rows=120, bucket_seconds=86400 * 8), ind.indicator_table(bars), ind.INDICATOR_COLUMNS)
    odd = bars.unionByName(bars.limit(3)).unionByName(bars.limit(1).withColumn("date", F.lit(None).cast("date")))
    assert long_series.own_rows(long_series.chunked(odd, 50, 5, rows=100, bucket_seconds=86400)).count() == odd.count()
    assert long_series.feature_table(bars.limit(0)).count() == 0


# ---- as-of ---------------------------------------------------------------
def _sides(spark, seed, n_left=400, n_right=150):
    rng = np.random.default_rng(seed)
    t0 = datetime.datetime(2024, 1, 1)
    left = [(i, ["a", "b", "c"][rng.integers(3)], t0 + datetime.timedelta(seconds=int(rng.integers(0, 86400 * 12)))) for i in range(n_left)]
    right = [(["a", "b"][rng.integers(2)], t0 + datetime.timedelta(seconds=int(rng.integers(86400, 86400 * 9))), float(i)) for i in range(n_right)]
    left += [(n_left + i, k, t) for i, (k, t, _) in enumerate(right[:20])]
    return left, right


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("bucket, tolerance", [(3600, None), (86400 * 3, 7200), (86400 * 400, None)])
def test_asof_equals_pandas(spark, direction, bucket, tolerance):
    left, right = _sides(spark, 5)
    lf = spark.createDataFrame(left, "id long, k string, ts timestamp").repartition(5)
    rf = spark.createDataFrame(right, "k string, at timestamp, v double").repartition(3)
    got = {r["id"]: (r["at"], r["v"]) for r in asof.join(lf, rf, ["k"], "ts", "at", ["v"], direction=direction, tolerance_seconds=tolerance, bucket_seconds=bucket).collect()}
    assert len(got) == len(left)
    lp, rp = pd.DataFrame(left, columns=["id", "k", "ts"]).sort_values("ts"), pd.DataFrame(right, columns=["k", "at", "v"]).sort_values(["at", "v"])
    rp["t"] = rp["at"]
    rp = rp.drop_duplicates(["k", "t"], keep="last")
    for i, k, ts in left:
        own = rp[rp["k"] == k]
        gaps = [((ts - a).total_seconds(), a, v) for a, v in zip(list(map(pd.Timestamp.to_pydatetime, own["at"])), own["v"], strict=True)]
        if direction != "nearest":
            gaps = [g for g in gaps if (g[0] >= 0 if direction == "backward" else g[0] <= 0)]
        best = min(gaps, key=lambda g: (abs(g[0]), g[1]), default=None)
        want = (best[1], best[2]) if best and (tolerance is None or abs(best[0]) <= tolerance) else (None, None)
        assert got[i] == want, (i, k, ts)


def test_asof_keeps_rows_without_key_time_or_partner(spark):
    t = datetime.datetime(2024, 1, 2)
    left = spark.createDataFrame([(1, "a", t), (1, "a", t), (2, None, t), (3, "a", None), (4, "z", t)], "id long, k string, ts timestamp")
    right = spark.createDataFrame([("a", t, 1.0), ("a", t, 2.0), ("a", None, 9.0), (None, t, 5.0)], "k string, at timestamp, v double")
    got = sorted((r["id"], r["v"]) for r in asof.join(left, right, ["k"], "ts", "at", ["v"]).fillna(-1.0).collect())
    assert got == [(1, 2.0), (1, 2.0), (2, -1.0), (3, -1.0), (4, -1.0)]
    assert asof.join(left, right.limit(0), ["k"], "ts", "at", ["v"]).where("v IS NULL").count() == 5
    with pytest.raises(ValueError):
        asof.join(left, right, ["k"], "ts", "at", ["v"], direction="sideways")
