"""Intraday series in chunks, and time-bucketed as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.q_indicators import W
from equityspark.catalog.registry import query
from equityspark.catalog.util import keep, r
from equityspark.functions import indicators as ind
from equityspark.operators import asof
from equityspark.plans import long_series
from equityspark.session import materialize
from equityspark.sources import views

oracle.define("ticks", """
  SELECT source_agent AS ticker, ts AS date, value AS open, value + 1.0 AS high, value AS low, value AS close, 1.0::DOUBLE + event_id % 7 AS volume FROM agent_events""")
oracle.over("ticks", "indicators", "ind_vol", "ind_lag", "fwd_labels")


def ticks(spark, d):
    """The series as a stored table: counting and reading are two scans of it."""
    return materialize(views.tick_series(spark, d), "ticks")


@query("e11_tick_indicators", f"SELECT ticker, date, {r(*ind.INDICATOR_COLUMNS)} FROM indicators_ticks")
def e11_ticks(spark, d):
    return keep(long_series.indicator_table(ticks(spark, d), bucket_seconds=60), "ticker", "date", *ind.INDICATOR_COLUMNS)


_LAGS = [f"lag_return_{n}d" for n in (1, 5, 10, 20)]
_STATE = ["obv", "percent_since_start", "drawdown_pct"]


@query("e12_tick_features", f"""SELECT v.ticker, v.date, {', '.join(f'round(lag_{n}, 6) AS lag_return_{n}d' for n in (1, 5, 10, 20))}, {r('atr_14', 'realized_vol_20d')}, volatility_regime,
    round(forward_5d_return, 6) AS forward_5d_return, direction_20d, round(max_drawdown_5d, 6) AS max_drawdown_5d, {r(*_STATE)}, pos, 63 - pos % 63 AS days_to_earnings
  FROM ind_vol_ticks v JOIN ind_lag_ticks g ON g.ticker = v.ticker AND g.date = v.date JOIN fwd_labels_ticks f ON f.ticker = v.ticker AND f.date = v.date
  JOIN (SELECT ticker, date, row_number() OVER {W} - 1 AS pos, sum(s) OVER {W} AS obv, (close - fc) / fc * 100 AS percent_since_start, (close - peak) / peak * 100 AS drawdown_pct
    FROM (SELECT *, coalesce(sign(close - lag(close) OVER {W}) * volume, 0.0) AS s, first_value(close) OVER {W} AS fc, max(close) OVER {W} AS peak FROM ticks)) p ON p.ticker = v.ticker AND p.date = v.date""")
def e12_ticks(spark, d):
    """Only rows with all labels, as in the label table."""
    out = long_series.feature_table(ticks(spark, d), bucket_seconds=60).where("forward_20d_return IS NOT NULL")
    return keep(out, "ticker", "date", *_LAGS, "atr_14", "realized_vol_20d", "volatility_regime", "forward_5d_return", "direction_20d",
                "max_drawdown_5d", *_STATE, "pos", "days_to_earnings")


# As-of joins on timestamps -----------------------------------------------------------
oracle.define("hour_close", """
  SELECT printf('S%04d', user_id) AS ticker, date_trunc('hour', ts) AS date, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2""")
_PEERS = ("S0001", "S0003", "S0005")


def hour_close(spark, d):
    from equityspark.sources.readers import resample_ohlcv

    e = views.agent_events(spark, d).select("ticker", "ts", "value", F.lit(1).cast("long").alias("qty"), "event_id")
    return resample_ohlcv(e, ["ticker"], "ts", "value", "qty", "event_id", "1h").select("ticker", "date", "close")


@query("c05_asof_intraday", f"""SELECT e.event_id, e.ticker, e.ts, q.peer, p.close AS close, p.date AS peer_time
  FROM agent_events e CROSS JOIN (SELECT unnest({list(_PEERS)}) AS peer) q ASOF LEFT JOIN hour_close p ON p.ticker = q.peer AND e.ts >= p.date""")
def c05_intraday(spark, d):
    """Every event with the last hour bar of three peers at or before it."""
    peers = hour_close(spark, d).where(F.col("ticker").isin(*_PEERS)).select(F.col("ticker").alias("peer"), F.col("date").alias("peer_time"), "close")
    events = views.agent_events(spark, d).select("event_id", "ticker", "ts", F.explode(F.array(*[F.lit(p) for p in _PEERS])).alias("peer"))
    got = asof.join(events, peers, ["peer"], "ts", "peer_time", ["close"])
    return got.select("event_id", "ticker", "ts", "peer", "close", "peer_time")


@query("c05_asof_own_series", """SELECT e.event_id, e.ticker, e.ts, p.close AS previous_close, p.date AS previous_hour
  FROM agent_events e ASOF LEFT JOIN hour_close p ON p.ticker = e.ticker AND e.ts - INTERVAL 1 HOUR >= p.date""")
def c05_own(spark, d):
    """Every event with its own ticker's last bar that closed before it (bars are known an hour after their start)."""
    bars = hour_close(spark, d).select("ticker", (F.col("date") + F.expr("INTERVAL 1 HOUR")).alias("known"), F.col("date").alias("previous_hour"), F.col("close").alias("previous_close"))
    events = views.agent_events(spark, d).select("event_id", "ticker", "ts")
    got = asof.join(events, bars, ["ticker"], "ts", "known", ["previous_close", "previous_hour"])
    return got.select("event_id", "ticker", "ts", "previous_close", "previous_hour")


@query("c06_nearest_intraday", """SELECT event_id, ticker, ts, date AS bar_time, close FROM (
    SELECT e.event_id, e.ticker, e.ts, p.date, p.close, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(p.date)), p.date) AS k
    FROM agent_events e JOIN hour_close p ON p.ticker = 'S0001' AND p.date BETWEEN e.ts - INTERVAL 6 HOUR AND e.ts + INTERVAL 6 HOUR) WHERE k = 1""")
def c06_nearest(spark, d):
    """Every event at the nearest bar of one instrument within six hours; the earlier one on ties."""
    bars = hour_close(spark, d).where("ticker = 'S0001'").select(F.lit("S0001").alias("series"), F.col("date").alias("bar_time"), "close")
    events = views.agent_events(spark, d).select("event_id", "ticker", "ts", F.lit("S0001").alias("series"))
    got = asof.join(events, bars, ["series"], "ts", "bar_time", ["close"], direction="nearest", tolerance_seconds=6 * 3600)
    return got.where("bar_time IS NOT NULL").select("event_id", "ticker", "ts", "bar_time", "close")
