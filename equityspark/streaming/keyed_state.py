"""Conflicts and rule reactions as keyed state (ids J3, J6).

Two stateful operators in a chain. The first is keyed by (ticker, source) and lets through a
recommendation only if it is newer than the kept one and says something else, so repeated
and late rows stop there and a hot ticker is dealt by source. The second is keyed by ticker
and keeps a map from source to recommendation; it speaks only when the picture changes.
With ``expire`` a timer drops sources that have been silent too long (by event time); a
conflict that ends that way is reported as resolved.

State lives in RocksDB under the query's checkpoint; a restart continues from it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEWS = "ticker string, source string, recommendation string, ts timestamp, event_id long"
SIGNALS = "ticker string, seq long, kind string, ts timestamp, n_sources int, recommendations string"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


class NewestPerSource(StatefulProcessor):
    """Passes a recommendation on if it is the newest of its (ticker, source) and differs from the kept one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "recommendation string, ts timestamp, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            ts, ids = pdf["ts"].to_numpy(), pdf["event_id"].to_numpy()
            known = np.flatnonzero(~(pd.isna(ts) | pd.isna(ids)))
            if len(known):
                i = known[np.lexsort((ids[known], ts[known]))[-1]]
                row = {"ts": pd.Timestamp(ts[i]), "event_id": int(ids[i]), "recommendation": pdf["recommendation"].iat[i]}
                if best is None or (row["ts"], row["event_id"]) > (best["ts"], best["event_id"]):
                    best = row
        if best is None:
            return
        old = self.kept.get()
        if old is not None and (best["ts"], best["event_id"]) <= (pd.Timestamp(old[1]), old[2]):
            return
        said = None if pd.isna(best["recommendation"]) else str(best["recommendation"])
        self.kept.update((said, best["ts"].to_pydatetime(), best["event_id"]))
        # also unchanged views go on: they keep their source alive
        yield pd.DataFrame({"ticker": [key[0]], "source": [key[1]], "recommendation": [said], "ts": [best["ts"]], "event_id": [best["event_id"]]})

    def close(self) -> None:
        pass


class ConflictKeeper(StatefulProcessor):
    """Reports a ticker whenever the picture of disagreeing sources changes."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.views = handle.getMapState("views", "source string", "recommendation string, ms long")
        self.open = handle.getValueState("open", "picture string, seq long")

    def _known(self) -> dict[str, tuple[str | None, int]]:
        """All views of the ticker, read at once: every call to the state is a trip to the JVM."""
        return {k[0]: (v[0], v[1]) for k, v in self.views.iterator()}

    def _report(self, ticker: str, ms: int, known: dict[str, tuple[str | None, int]]) -> Iterator[pd.DataFrame]:
        views = {source: said for source, (said, _) in known.items()}
        said = {v for v in views.values() if v is not None}
        picture = json.dumps(views, sort_keys=True, ensure_ascii=False) if len(views) >= 2 and len(said) > 1 else None
        old, seq = self.open.get() or (None, 0)
        if picture == old:
            return
        self.open.update((picture, seq + 1))
        yield pd.DataFrame({
            "ticker": [ticker], "seq": [seq + 1], "kind": ["conflict" if picture else "resolved"],
            "ts": [pd.Timestamp(ms, unit="ms")], "n_sources": [len(views)], "recommendations": [picture or json.dumps(views, sort_keys=True, ensure_ascii=False)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, known, fresh = 0, self._known(), {}
        for pdf in rows:
            for source, said, ts in zip(pdf["source"], pdf["recommendation"], pdf["ts"], strict=True):
                ms = int(pd.Timestamp(ts).value // 1_000_000)
                newest = max(newest, ms)
                if source not in known or ms >= known[source][1]:
                    known[source] = fresh[source] = (None if pd.isna(said) else str(said), ms)
                    if self.expire_ms is not None:
                        self.handle.registerTimer(ms + self.expire_ms)
        for source, view in fresh.items():
            self.views.updateValue((source,), view)
        yield from self._report(key[0], newest, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = self._known()
        gone = [source for source, (_, ms) in known.items() if ms + self.expire_ms <= now]
        for source in gone:
            self.views.removeKey((source,))
            known.pop(source)
        if gone:
            yield from self._report(key[0], now, known)

    def close(self) -> None:
        pass


def conflict_signals(recommendations: DataFrame, expire: dt.timedelta | None = None, late: str | None = None) -> DataFrame:
    """(ticker, seq, kind, ts, n_sources, recommendations) from a stream of ticker, source, recommendation, ts, event_id.

    ``kind`` is conflict or resolved, ``seq`` counts a ticker's reports, ``recommendations`` is the
    picture as JSON. Rows without ticker, source, ts or event_id are no news. ``expire`` needs
    ``late``, the watermark delay: rows later than that are dropped, as everywhere in a stream.
    """
    if expire is not None and late is None:
        raise ValueError("expire needs the watermark delay late")
    news = recommendations.select("ticker", "source", "recommendation", "ts", "event_id").where("ticker IS NOT NULL AND source IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    news = news.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = expire is not None
    if timed:
        news = news.withWatermark("ts", late)
    changed = news.groupBy("ticker", "source").transformWithStateInPandas(
        NewestPerSource(), NEWS, "Append", "EventTime" if timed else "None", **({"eventTimeColumnName": "ts"} if timed else {}))
    keeper = ConflictKeeper(int(expire.total_seconds() * 1000) if timed else None)
    return changed.groupBy("ticker").transformWithStateInPandas(keeper, SIGNALS, "Append", "EventTime" if timed else "None")


def start_conflicts(recommendations: DataFrame, path: str, checkpoint: str, expire: dt.timedelta | None = None, late: str | None = None) -> StreamingQuery:
    """Append the signals of ``conflict_signals`` to Parquet until the available input is done."""
    with rocksdb(recommendations.sparkSession):
        out = conflict_signals(recommendations, expire, late)
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def open_conflicts(signals: DataFrame) -> DataFrame:
    """Newest signal of each ticker that is a conflict: (ticker, n_sources, recommendations)."""
    last = signals.groupBy("ticker").agg(F.max_by(F.struct("kind", "n_sources", "recommendations"), "seq").alias("s"))
    return last.where("s.kind = 'conflict'").select("ticker", "s.n_sources", "s.recommendations")


class Reaction(StatefulProcessor):
    """First event of a key, then one again only after ``quiet_ms`` of event time: a rule fires once per occasion."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [pdf for pdf in rows if len(pdf)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        state = self.last.get()
        last, fired = (state[0] if state else None), []
        for ts, event_id in zip(pdf["ts"], pdf["event_id"], strict=True):
            ms = int(pd.Timestamp(ts).value // 1_000_000)
            if last is None or ms - last >= self.quiet_ms:
                last = ms
                fired.append((key[0], int(event_id), ts))
        if fired:
            self.last.update((last,))
            yield pd.DataFrame(fired, columns=["ticker", "event_id", "ts"])

    def close(self) -> None:
        pass


def reactions(events: DataFrame, event_type: str, quiet: dt.timedelta) -> DataFrame:
    """(ticker, event_id, ts) of the events of one type that set off the rule, per ticker at most once in ``quiet``.

    Late rows of a ticker count from the last occasion on, in the order they arrive.
    """
    own = events.where(F.col("event_type") == event_type).where("ticker IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    own = own.select("ticker", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return own.groupBy("ticker").transformWithStateInPandas(
        Reaction(int(quiet.total_seconds() * 1000)), "ticker string, event_id long, ts timestamp", "Append", "None")
