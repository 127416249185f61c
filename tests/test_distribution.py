"""Order statistics, drift, correlation and ranking: exact under skew and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equityspark.functions import quantiles
from equityspark.functions.quantiles import exact_quantiles, global_rank
from equityspark.operators import drift, ml

PROBS = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy, inside_most, error", [(50, 4_000_000, None), (10_000, 4_000_000, None), (64, 40, None), (50, 4_000_000, 1e-4), (200, 100, 1e-3)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, inside_most, error):
    """Small sketches, brackets that are narrowed first, and brackets that miss and are widened."""
    if error is not None:
        monkeypatch.setattr(quantiles, "rank_error", lambda size: error)
    rng = np.random.default_rng(1)
    data = {
        "normal": rng.normal(size=4000),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(7, 1, 3000)),
        "two": np.array([1.0, 2.0]),
        "one": np.array([3.0]),
        "four": np.array([4.0, 1.0, 3.0, 2.0]),
        "flat": np.full(500, 2.5),
    }
    pdf = pd.concat([pd.DataFrame({"key": k, "value": v}) for k, v in data.items()])
    got = {r["key"]: r for r in exact_quantiles(spark.createDataFrame(pdf).repartition(5), PROBS, accuracy, inside_most=inside_most).collect()}
    for k, v in data.items():
        assert got[k]["n"] == len(v)
        assert np.allclose(got[k]["quantiles"], np.percentile(v, [p * 100 for p in PROBS]), rtol=1e-12, atol=1e-12), k
        assert got[k]["below"] == [int((v < q).sum()) for q in got[k]["quantiles"]], k


def test_global_rank_with_a_hot_value(spark):
    rows = [(1.0 if i % 3 == 0 else float(i), f"T{i % 7}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "v double, t string, i int").repartition(4)
    got = [(r["v"], r["t"], r["i"]) for r in global_rank(df, ["v", "t", "i"], "rank", 8).orderBy("rank").collect()]
    assert got == sorted(rows)


def psi_reference(expected, actual, buckets=10):
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, buckets + 1)))
    if len(edges) < 2:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    e = np.histogram(expected, edges)[0] / len(expected)
    a = np.histogram(actual, edges)[0] / len(actual)
    e, a = np.where(e == 0, 1e-6, e), np.where(a == 0, 1e-6, a)
    return max(0.0, float(np.sum((a - e) * np.log(a / e))))


def test_psi_and_stored_baseline(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = pd.DataFrame({"same": rng.normal(size=800), "moved": rng.normal(size=800), "flat": 1.0, "steps": rng.integers(0, 3, 800).astype(float)})
    now = pd.DataFrame({"same": base["same"].to_numpy(), "moved": rng.normal(2, 1, 800), "flat": 1.0, "steps": rng.integers(0, 3, 800).astype(float)})
    names = list(base.columns)
    b, n = (drift.to_long(spark.createDataFrame(x), names) for x in (base, now))
    want = {c: psi_reference(base[c], now[c]) for c in names}
    got = {r["key"]: r["psi"] for r in drift.psi(b, n).collect()}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[c], want[c], atol=1e-9) for c in names)
    path = str(tmp_path / "baseline")
    assert drift.check_stored(b, path) is None
    stored = {r["key"]: r for r in drift.check_stored(n, path).collect()}
    assert all(np.isclose(stored[c]["psi"], want[c], atol=1e-9) for c in names)
    assert stored["moved"]["classification"] == "major_shift" and stored["same"]["classification"] == "stable"
    checked = drift.check(b, n)
    assert drift.should_retrain(checked).first()[0] is True
    assert drift.summary(checked).first()["total_features"] == 4
    assert drift.sample_values(b, 5).groupBy("key").count().where("count > 5").count() == 0


def test_correlations_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.normal(size=200), "c": rng.normal(size=200)})
    x["b"] = x["a"] + rng.normal(0, 0.01, 200)
    x.loc[:15, "c"] = np.nan
    x["k"] = 5.0
    names = ["a", "b", "c", "k"]
    df = spark.createDataFrame(x).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]).repartition(3)
    pairs = ml.correlations(df, names)
    got = {(r["a"], r["b"]): r["corr"] for r in pairs.collect()}
    want = x[names].corr()
    for (a, b), v in got.items():
        assert (v is None and np.isnan(want.loc[a, b])) or np.isclose(v, want.loc[a, b])
    assert [r["feature"] for r in ml.correlated_features(pairs).collect()] == ["b"]


def test_missing_and_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0), (8.0, 6.0)], "x double, y double")
    assert {r["feature"]: r["missing"] for r in ml.missing_share(df, ["x", "y"]).collect()} == {"x": 0.25, "y": 0.25}
    assert sorted(tuple(r) for r in ml.impute_median(df, ["x", "y"]).collect()) == [(1.0, 4.0), (3.0, 2.0), (3.0, 4.0), (8.0, 6.0)]


def test_day_profiles_merge_to_the_whole(spark, tmp_path):
    rng = np.random.default_rng(6)
    days = pd.date_range("2024-01-01", periods=12).date
    pdf = pd.concat([pd.DataFrame({"day": d, "key": k, "value": v}) for d in days for k, v in (
        ("a", rng.normal(size=900) + 1e6), ("step", rng.integers(0, 4, 700).astype(float)), ("one", np.array([2.0])))])
    pdf.loc[pdf.index[:3], "value"] = np.nan
    path = str(tmp_path / "days")
    long = spark.createDataFrame(pdf)
    for part in (long.where("day < '2024-01-05'"), long.where("day >= '2024-01-04'")):  # one day twice: replaced, not doubled
        drift.append_days(part, path, 256)
    for start, end in ((None, None), ("2024-01-03", "2024-01-08")):
        own = pdf[pdf["value"].notna()]
        own = own[(own["day"] >= pd.Timestamp(start or "2000-01-01").date()) & (own["day"] <= pd.Timestamp(end or "2100-01-01").date())]
        got = {r["key"]: r for r in drift.merged_profile(spark, path, start, end).collect()}
        for k, v in own.groupby("key")["value"]:
            r, v = got[k], np.sort(v.to_numpy())
            assert r["n"] == len(v) and r["min"] == v[0] and r["max"] == v[-1]
            assert np.isclose(r["mean"], v.mean(), rtol=1e-12) and np.isclose(r["std"], v.std(), rtol=1e-9)
            eps = (3 * quantiles.rank_error(256) + 2 / quantiles.GRID) * len(v) + 1
            for i, (p, b) in enumerate(zip(r["percentiles"], r["below"], strict=True)):
                assert np.searchsorted(v, p, "left") - eps <= i / 10 * len(v) <= np.searchsorted(v, p, "right") + eps
                assert abs(b - np.searchsorted(v, p, "left")) <= eps
        exact = {r["key"]: r for r in drift.exact_profile(spark.createDataFrame(own[["key", "value"]]), path, start, end).collect()}
        for k, v in own.groupby("key")["value"]:
            assert np.allclose(exact[k]["percentiles"], np.percentile(v, np.arange(0, 101, 10)), rtol=1e-12)
    same = {r["key"]: r for r in drift.check_merged(spark.createDataFrame(pdf[["key", "value"]]).where("NOT isnan(value)"), path).collect()}
    assert all(r["classification"] == "stable" and r["psi"] < 0.05 for r in same.values())
    moved = drift.check_merged(spark.createDataFrame(pd.DataFrame({"key": "step", "value": np.full(500, 3.0)})), path).first()
    assert moved["classification"] == "major_shift"
