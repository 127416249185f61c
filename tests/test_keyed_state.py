"""Keyed state over micro-batches: late and repeated rows, restarts, expiry, reactions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from equityspark.streaming import event_log, keyed_state

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "ticker string, source string, recommendation string, ts timestamp, event_id long"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


BATCHES = [
    [("A", "x", "buy", at(1), 1), ("A", "y", "buy", at(1), 2), ("B", "x", "sell", at(1), 3), ("A", None, "sell", at(1), 90), (None, "x", "buy", at(1), 91)],
    [("A", "y", "sell", at(2), 4), ("A", "x", "sell", at(0.5), 5), ("B", "x", "sell", at(1), 3), ("C", "x", "buy", at(2), 6), ("C", "y", "hold", at(2), 7)],
    [("A", "y", "sell", at(2), 4), ("A", "x", "sell", at(3), 8), ("C", "z", "sell", at(3), 9), ("B", "y", None, at(3), 10), ("B", "z", "buy", at(3), 11)],
]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, root, name, start):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    start(s, f"{root}/{name}", f"{root}/{name}-cp").awaitTermination()


def test_keyed_state_equals_folder_version_over_restarts(spark, tmp_path):
    root = str(tmp_path)
    seen = []
    for rows in BATCHES:  # every micro-batch is a restart from the checkpoint
        feed(spark, f"{root}/in", rows)
        seen += rows
        run(spark, root, "keyed", keyed_state.start_conflicts)
        run(spark, root, "folder", event_log.conflict_stream)
        got = {r["ticker"]: json.loads(r["recommendations"]) for r in keyed_state.open_conflicts(spark.read.parquet(f"{root}/keyed")).collect()}
        batch = event_log.conflicts(spark.createDataFrame([r for r in seen if None not in r[:2]], SCHEMA))
        assert got == {r["ticker"]: r["recommendations"] for r in batch.collect()}
    folder = spark.read.parquet(f"{root}/folder/conflicts").groupBy("ticker").agg(F.max_by("recommendations", "batch").alias("r"))
    assert {r["ticker"]: r["r"] for r in folder.collect() if r["ticker"] in got} == got
    signals = spark.read.parquet(f"{root}/keyed").orderBy("ticker", "seq").collect()
    assert [(r["ticker"], r["seq"], r["kind"]) for r in signals] == [("A", 1, "conflict"), ("A", 2, "resolved"), ("B", 1, "conflict"), ("C", 1, "conflict"), ("C", 2, "conflict")]


def test_silent_sources_expire(spark, tmp_path):
    root = str(tmp_path)
    start = lambda s, path, cp: keyed_state.start_conflicts(s, path, cp, dt.timedelta(hours=6), "1 hour")
    for rows in (
        [("A", "x", "buy", at(0), 1), ("A", "y", "sell", at(0.2), 2), ("B", "x", "buy", at(0), 3), ("B", "y", "sell", at(5), 4)],
        [("A", "x", "buy", at(9), 5), ("Z", "x", "buy", at(9), 6)],
        [("Z", "x", "buy", at(30), 7)],
        [("Z", "x", "buy", at(31), 8)],
    ):
        feed(spark, f"{root}/in", rows)
        run(spark, root, "keyed", start)
    signals = [(r["ticker"], r["kind"], r["n_sources"]) for r in spark.read.parquet(f"{root}/keyed").orderBy("ticker", "seq").collect()]
    assert [s for s in signals if s[0] == "A"] == [("A", "conflict", 2), ("A", "resolved", 1)]
    assert [s for s in signals if s[0] == "B"][:2] == [("B", "conflict", 2), ("B", "resolved", 1)]
    with pytest.raises(ValueError):
        keyed_state.conflict_signals(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), dt.timedelta(hours=1))


def test_reactions_fire_once_per_occasion(spark, tmp_path):
    root = str(tmp_path)
    schema = "event_id long, ts timestamp, event_type string, ticker string"
    for rows in ([(1, at(0), "risk", "A"), (2, at(1), "risk", "A"), (3, at(0), "other", "A"), (4, at(0), "risk", "B")],
                 [(5, at(2.5), "risk", "A"), (6, at(3), "risk", "A"), (7, at(1.9), "risk", "B"), (8, None, "risk", "B")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        with keyed_state.rocksdb(spark):
            q = keyed_state.reactions(s, "risk", dt.timedelta(hours=2)).writeStream.format("parquet").option("path", f"{root}/out")
            q.option("checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["ticker"], r["event_id"]) for r in spark.read.parquet(f"{root}/out").collect()) == [("A", 1), ("A", 5), ("B", 4)]


def test_a_tickers_views_are_read_at_once():
    import pandas as pd

    class Views(dict):
        calls: list = []

        def __getattribute__(self, name):
            if name in ("iterator", "getValue", "containsKey", "updateValue"):
                Views.calls.append(name)
            return super().__getattribute__(name)

        def iterator(self):
            return iter(list(self.items()))

        def containsKey(self, k):  # noqa: N802
            return k in self

        def getValue(self, k):  # noqa: N802
            return self[k]

        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

    class Open:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

    keeper = keyed_state.ConflictKeeper(None)
    keeper.views, keeper.open = Views({("x",): ("buy", 10)}), Open()
    news = pd.DataFrame({"source": ["x", "y", "y", "z"], "recommendation": ["sell", "buy", "sell", None], "ts": pd.to_datetime([5, 20, 20, 30], unit="ms")})
    out = list(keeper.handleInputRows(("A",), iter([news]), None))
    assert Views.calls == ["iterator", "updateValue", "updateValue"]
    assert dict(keeper.views) == {("x",): ("buy", 10), ("y",): ("sell", 20), ("z",): (None, 30)}
    assert [(f["kind"][0], f["n_sources"][0], json.loads(f["recommendations"][0])) for f in out] == [("conflict", 3, {"x": "buy", "y": "sell", "z": None})]
