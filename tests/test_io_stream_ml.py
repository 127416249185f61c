"""Sinks, readers, streams and models."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equityspark.operators import backtest, ensemble, memory, ml  # noqa: F401
from equityspark.plans import training_set
from equityspark.sources import readers, sinks
from equityspark.streaming import event_log


def test_vendor_rows_and_intervals(spark):
    raw = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 100, 1704153600000)], "o double, h double, l double, c double, v long, t long")
    r = readers.normalize_vendor_bars(raw, "A").first().asDict()
    assert r == {"open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 100, "date": datetime.date(2024, 1, 2), "ticker": "A"}
    assert readers.normalize_columns(spark.createDataFrame([(1,)], "`Adj Close` int")).columns == ["adj_close"]
    with pytest.raises(ValueError):
        readers.bucket_start(F.lit("2024-01-01"), "7y")
    ts = spark.createDataFrame([(datetime.datetime(2024, 5, 17, 10, 44, 9),)], "t timestamp")
    cuts = {i: str(ts.select(readers.bucket_start(F.col("t"), i)).first()[0]) for i in ("5m", "90m", "1wk", "1mo", "3mo")}
    assert cuts == {"5m": "2024-05-17 10:40:00", "90m": "2024-05-17 10:30:00", "1wk": "2024-05-13", "1mo": "2024-05-01", "3mo": "2024-04-01"}


def test_record_projections(spark):
    body = json.dumps({"ticker": "a", "valuation": {"pe_ratio": 12.5}, "analyst_metrics": {"recommendation": "buy"}})
    f = readers.flatten_financials(spark.createDataFrame([(body,)], "b string"), "b")
    assert len(f.columns) == 34 and f.first()["pe_ratio"] == 12.5 and f.first()["ticker"] == "A" and f.first()["recommendation"] == "buy"
    news = [("A", i, json.dumps({"title": f"t{i}", "providerPublishTime": 0 if i == 0 else 1704153600, "thumbnail": {"resolutions": [{"url": "u"}]} if i else None})) for i in range(3)]
    n = readers.project_news(spark.createDataFrame(news, "ticker string, seq int, b string"), "b", limit=2).collect()
    assert [(r["title"], r["published"] is None, r["thumbnail"]) for r in n] == [("t0", True, None), ("t1", False, "u")]
    c = spark.createDataFrame([("A", None, "Short", None, 5.0), (None, "x", "y", "z", 1.0)], "symbol string, longName string, shortName string, sector string, regularMarketPrice double")
    r = readers.project_company(c).collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["sector"], r[0]["current_price"], r[0]["currency"]) == ("Short", "N/A", 5.0, "USD")


def test_replace_upsert_and_universe_files(spark, tmp_path, make_bars):
    path = str(tmp_path / "bars")
    sinks.write_by_ticker(make_bars({"A": [1, 2], "B": [3]}), path, 4)
    sinks.replace_tickers(spark, make_bars({"A": [9]}), path, str(tmp_path / "stage"), 4)
    assert sorted((r["ticker"], r["close"]) for r in spark.read.parquet(path).collect()) == [("A", 9.0), ("B", 3.0)]
    u = spark.createDataFrame([("Tech", "A"), ("Tech", "B"), (None, "C")], "sector string, ticker string")
    folder = tmp_path / "universes"
    folder.mkdir()
    (folder / "mine.json").write_text(json.dumps({"name": "mine", "tickers": ["A", "B", "C"], "sectors": {"Tech": ["A", "B"]}}, indent=1))
    got = {tuple(r) for r in readers.load_universes(spark, str(folder)).collect()}
    assert got == {("mine", "Tech", "A"), ("mine", "Tech", "B"), ("mine", None, "C")}
    sinks.save_universe(u, str(tmp_path / "saved"), "mine", updated="2024-01-01")
    back = spark.read.json(str(tmp_path / "saved")).first()
    assert back["tickers"] == ["A", "B", "C"] and back["sectors"]["Tech"] == ["A", "B"]


def test_stored_prices_are_pruned_by_bucket(spark, tmp_path, make_bars):
    path = str(tmp_path / "prices")
    bars = make_bars({f"T{i}": [1.0, 2.0] for i in range(20)})
    sinks.write_by_ticker(bars, path, 8)
    got = readers.scan_prices(spark.read.parquet(path), ["T3", "T7"], 8)
    assert got.groupBy("ticker").count().count() == 2 and got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ticker_bucket" in plan[plan.index("PartitionFilters"):].split("]")[0] and "In(ticker" in plan


def test_report_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, "A", datetime.date(2024, 1, 1 + i % 2), f"s{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, ticker string, date date, summary string")
    sinks.append_analyses(df, path)
    gone = spark.createDataFrame([(0,), (2,), (1,)], "doc_id long")
    sinks.delete_by_id(spark, path, str(tmp_path / "st"), gone)
    assert [r["doc_id"] for r in spark.read.parquet(path).collect()] == [3]
    df.write.json(str(tmp_path / "backup"))
    sinks.restore_analyses(spark, str(tmp_path / "backup"), path, df.schema)
    assert sorted(r["doc_id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_preparation_job(spark, tmp_path, make_bars):
    rng = np.random.default_rng(5)
    bars = make_bars({t: list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))) for t, n in (("A", 230), ("B", 150), ("SPY", 230))})
    info = spark.createDataFrame([("A", "Tech", "Chips", 1.0)], "ticker string, sector string, industry string, market_cap double")
    out = training_set.prepare(bars, info, str(tmp_path))
    assert out["summary"].first()["n_tickers"] == 3
    rows = spark.read.parquet(str(tmp_path / "training"))
    assert {r["ticker"] for r in rows.select("ticker").distinct().collect()} == {"A", "SPY"}
    csv = spark.read.option("header", True).csv(str(tmp_path / "export_csv"))
    assert csv.columns == training_set.EXPORT_COLUMNS and csv.count() == 2 * 225
    assert out["completeness"].where("column_name = 'close'").first()["complete_pct"] == 100.0


def test_conflict_stream_emits_once_per_change(spark, tmp_path):
    t = datetime.datetime
    rows = [
        [("X", "s1", "buy", t(2024, 1, 1, 1), 1), ("Y", "s1", "buy", t(2024, 1, 1, 1), 2)],
        [("X", "s2", "buy", t(2024, 1, 1, 2), 3), ("X", "s1", "buy", t(2024, 1, 1, 3), 4)],
        # two at one instant: the larger event id wins, in either file order
        [("X", "s2", "sell", t(2024, 1, 1, 5), 7), ("X", "s2", "buy", t(2024, 1, 1, 5), 6)],
        [("Y", "s1", "buy", t(2024, 1, 1, 6), 8)],
        [("X", "s1", "buy", t(2024, 1, 1, 7), 9), ("X", "s2", "buy", t(2024, 1, 1, 4), 5)],
    ]
    schema = "ticker string, source string, recommendation string, ts timestamp, event_id long"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = event_log.conflict_stream(s, str(tmp_path / "out"), str(tmp_path / "cp"), compact_every=2)
    assert q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out" / "conflicts")).collect()
    assert [(r["ticker"], r["recommendations"]) for r in got] == [("X", {"s1": "buy", "s2": "sell"})]
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir()) == ["batch=2", "batch=3", "batch=4"]


def test_log_stream_windows_and_dead_letters(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i // 4), "risk_detected" if i % 2 else "signal_generated", "A0", "X", None) for i in range(12)]
    spark.createDataFrame(rows, event_log.EVENT_SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = event_log.read_events(spark, str(tmp_path / "in"), 1)
    event_log.append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 12 and log.where("data is null").count() == 0
    event_log.compact_log(spark, str(tmp_path / "log"), str(tmp_path / "small"), 5)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "small")).collect()) == [7, 8, 9, 10, 11]
    counts = event_log.windowed_counts(event_log.read_events(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").agg(F.sum("n")).first()[0] == 12
    good, bad = event_log.split_valid(spark.createDataFrame([('{"event_type": "a"}',), ("{oops",), ("{}",)], "b string"), "b", "event_type string")
    assert good.count() == 1 and bad.count() == 2


@pytest.fixture(scope="module")
def train_frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in ("A", "B", "C"):
        x = rng.normal(size=(120, 3))
        y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 120)
        for i in range(120):
            rows.append((t, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), *map(float, x[i]), int(y[i] > 0), float(y[i])))
    return spark.createDataFrame(rows, f"ticker string, date date, f0 double, f1 double, f2 double, {ml.LABEL} int, {ml.TARGET} double").cache()


F3 = ["f0", "f1", "f2"]
TINY = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "boosted": {"maxIter": 3, "maxDepth": 3}}


def test_walk_forward_is_strictly_later_and_expanding(train_frame):
    w = ml.walk_forward(train_frame, 3)
    g = {(r["fold"], r["role"]): r for r in w.groupBy("fold", "role").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).collect()}
    for k in range(3):
        assert g[(k, "train")]["b"] < g[(k, "validation")]["a"]
        assert g[(k, "validation")]["n"] == 90
    assert g[(0, "train")]["n"] < g[(1, "train")]["n"] < g[(2, "train")]["n"]
    rows = ml.walk_forward(train_frame, 3, compat="rows").groupBy("fold", "role").count()
    assert {(r["fold"], r["role"]): r["count"] for r in rows.collect()}[(2, "train")] == 270


def test_training_gate_and_prediction(spark, train_frame, tmp_path):
    out = str(tmp_path / "models")
    v = ml.train_and_save(train_frame, F3, out, ("random_forest",), 2, TINY).first()
    assert v["passed"] and v["accuracy"] > 0.526
    spark.createDataFrame([("random_forest", 1.1)], "model string, accuracy double").write.mode("overwrite").json(f"{out}/metadata")
    assert not ml.train_and_save(train_frame, F3, out, ("random_forest",), 2, TINY).first()["passed"]
    c = ml.train_classifier(train_frame, F3, "boosted", TINY["boosted"])
    g = ml.train_regressor(train_frame, F3, "random_forest", TINY["random_forest"])
    p = ml.predict(train_frame, F3, c, g, "boosted")
    assert p.count() == 360 and p.where("confidence < 50 or confidence > 100 or abs(score) > 100").count() == 0
    assert ml.importance_table(spark, c, F3).first()["feature"] == "f0"
    assert set(ml.select_features(train_frame, F3, top_n=2, rounds=3)) <= set(F3)
    with pytest.raises(ValueError):
        ml.train_classifier(train_frame, F3, "other")


def test_search_records_failures(train_frame):
    best, trials = ml.tune(train_frame, F3, "random_forest", 2, 2, bounds={"numTrees": (2, 4), "maxDepth": (2, 3)}, rungs=(1.0,), eta=1)
    assert 2 <= best["numTrees"] <= 4 and trials.where("state = 'COMPLETE'").count() == 2
    best, trials = ml.tune(train_frame, F3, "random_forest", 1, 2, bounds={"maxDepth": (99, 99)})
    assert best == ml.TUNER_FALLBACK["random_forest"] and trials.first()["state"] == "FAIL"


@pytest.mark.parametrize("method", ["isotonic", "platt"])
def test_calibration_stays_in_range(spark, method):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(300), 2)
    df = spark.createDataFrame(pd.DataFrame({"p_up": p, ml.LABEL: (rng.random(300) < p**2).astype(int)}))
    out = [r["p_calibrated"] for r in ml.Calibrator(method).fit(df).transform(df).orderBy("p_up").collect()]
    assert all(0 <= x <= 1 for x in out) and all(a <= b + 1e-12 for a, b in zip(out, out[1:]))
    few = ml.Calibrator(method).fit(df.limit(50))
    wild = spark.createDataFrame([(-1.0,), (0.4,), (3.0,)], "p_up double")
    assert sorted(r["p_calibrated"] for r in few.transform(wild).collect()) == [0.0, 0.4, 1.0]


def test_stacking(spark, train_frame):
    fam = ("boosted", "random_forest")
    oof = ml.out_of_fold(train_frame, F3, fam, 2, TINY)
    prob = ml.stacking_probability(ml.fit_stacking(oof, fam), oof, fam)
    assert prob.where("direction_probability < 0 or direction_probability > 1").count() == 0 and prob.count() == oof.count()


@pytest.mark.parametrize("block, chunk", [(1000, 10000), (7, 16)])
def test_batch_search_in_blocks_equals_brute_force(spark, block, chunk):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 6))
    vecs[50:60] = vecs[3]  # ties go by id
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(500, None), (501, [0.0] * 6), (502, [1.0, 2.0])]
    store = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    queries = store.where("doc_id % 3 = 0 OR doc_id > 499").withColumnsRenamed({"doc_id": "query_id", "embedding": "query_vec"})
    got = {}
    for r in memory.batch_search(store, queries, 4, "l2sq", block, chunk).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["similarity"]))
    whole = [(i, np.array(v)) for i, v in rows if v is not None]
    for q, v in whole:
        if q % 3 and q < 500:
            continue
        near = sorted(((-round(1 - float(((v - x) ** 2).sum()), 9), i) for i, x in whole if len(x) == len(v)))[:4]
        assert [d for d, _ in got[q]] == [i for _, i in near]
    assert 500 not in got and [d for d, _ in got[502]] == [502]
    cos = memory.batch_search(store, queries, 4, "cosine", block, chunk).where("query_id = 501 OR doc_id = 501").count()
    assert cos == 0 and memory.batch_search(store, queries.limit(0), 4).count() == 0
