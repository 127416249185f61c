"""Long series in chunks: one ticker's rows in many tasks.

A window by ticker sorts the whole series of a ticker in one task. That is bounded for
daily bars, not for intraday ones. Here a long series is cut into chunks of about ``rows``
rows, and every chunk carries a halo: the last rows of the chunks before (for trailing
frames, lags and exponential means, whose memory is finite) and the first rows of those
behind (for forward labels). Inside ``keyed_by("ticker", "_chunk")`` all series expressions
then work on chunks; ``own_rows`` drops the halo. What has unbounded memory (running sums,
positions, running extremes, the first value) is combined from one state row per chunk by
a small window (``prefix``).

Chunks are whole time buckets, found from one partial aggregation (rows per ticker and
bucket); series of at most ``rows`` rows stay one chunk and are never copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions.core import keyed_by, pct, series
from equityspark.operators import features, labels

ROWS = 100_000
CHUNK_KEYS = ("ticker", "_chunk")


def _bucket(df: DataFrame, seconds: int) -> Column:
    """Number of the time bucket of ``date``; a date's bucket is at least a day long."""
    if dict(df.dtypes)["date"] == "date":
        return F.floor(F.unix_date("date") / max(1, seconds // 86400)).cast("long")
    return F.floor(F.unix_seconds(F.col("date").cast("timestamp")) / seconds).cast("long")


def chunk_map(df: DataFrame, before: int, after: int, rows: int, bucket: Column) -> DataFrame:
    """(ticker, _bucket, _home, _from, _to) of series longer than ``rows``: a bucket's own chunk and the chunks it serves.

    ``_from`` to ``_to`` may name a chunk that needs only some of the bucket's rows or none:
    surplus halo rows change nothing.
    """
    sizes = df.groupBy("ticker", bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("ticker")
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n, prior = F.col("_n"), F.col("_prior")
    out = sizes.withColumns({
        "_prior": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(whole), "_most": F.max("_n").over(whole),
    }).where(F.col("_all") > rows)
    out = out.withColumn("_home", F.floor(prior / rows)).withColumn("_last", F.max("_home").over(whole))
    to = F.least(F.col("_last"), F.floor((prior + n + before - 1) / rows)) if before else F.col("_home")
    since = F.greatest(F.lit(0), F.floor((prior - after - F.col("_most")) / rows)) if after else F.col("_home")
    return out.select("ticker", "_bucket", "_home", F.least(since, "_home").alias("_from"), F.greatest(to, "_home").alias("_to"))


def chunked(df: DataFrame, before: int = 0, after: int = 0, rows: int = ROWS, bucket_seconds: int = 3600) -> DataFrame:
    """Rows of ``df`` (ticker, date, ...) with ``_chunk`` and ``_own``; halo rows have ``_own`` false.

    A chunk has at least the ``before`` rows that precede its first own row and the ``after``
    rows behind its last one, as far as the series has them. ``df`` is read twice (once to
    count), so it should be a stored table. Rows need not be unique on (ticker, date); rows
    without a date are in the first chunk of their ticker.
    """
    bucket = _bucket(df, bucket_seconds)
    found = chunk_map(df.where(F.col("date").isNotNull()), before, after, rows, bucket)
    zero = F.lit(0).cast("long")
    placed = df.withColumn("_bucket", bucket).join(found, ["ticker", "_bucket"], "left")
    home = F.coalesce("_home", zero)
    chunk = F.explode(F.sequence(F.coalesce("_from", zero), F.coalesce("_to", zero)))
    return placed.select(*df.columns, home.alias("_home"), chunk.alias("_chunk")).withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def over_chunks(df: DataFrame, work: Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0, rows: int = ROWS, bucket_seconds: int = 3600) -> DataFrame:
    """``work`` (series expressions of finite memory) over chunks with halo, own rows only."""
    with keyed_by(*CHUNK_KEYS):
        return own_rows(work(chunked(df, before, after, rows, bucket_seconds)))


def prefix(df: DataFrame, state: dict[str, Column], combine: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Chunked rows with, for each name in ``state``, the combined state of all earlier chunks of the ticker (null in the first).

    ``state`` are aggregates over a chunk's own rows, ``combine`` how states add up. One row
    per (ticker, chunk) passes the window.
    """
    per_chunk = df.where("_own").groupBy(*CHUNK_KEYS).agg(*[c.alias(n) for n, c in state.items()])
    earlier = Window.partitionBy("ticker").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*CHUNK_KEYS, *[combine[n](F.col(n)).over(earlier).alias(n) for n in state])
    return df.join(carried, list(CHUNK_KEYS), "left")


# Expressions of unbounded memory ---------------------------------------------------
def _so_far():
    return series().rowsBetween(Window.unboundedPreceding, 0)


def add_positions(chunks: DataFrame, out: str = "pos") -> DataFrame:
    """0-based position in the whole series."""
    with keyed_by(*CHUNK_KEYS):
        inside = F.sum(F.col("_own").cast("long")).over(_so_far())
    df = prefix(chunks.withColumn("_in", inside), {"_c": F.count("*")}, {"_c": F.sum})
    return df.withColumn(out, F.col("_in") - 1 + F.coalesce("_c", F.lit(0))).drop("_in", "_c")


def add_obv(chunks: DataFrame, out: str = "obv") -> DataFrame:
    """On-balance volume; the halo needs one row before."""
    with keyed_by(*CHUNK_KEYS):
        step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())) * F.col("volume"), F.lit(0.0))
        df = chunks.withColumn("_step", F.when(F.col("_own"), step).otherwise(0.0))
        df = df.withColumn("_in", F.sum("_step").over(_so_far()))
    df = prefix(df, {"_s": F.sum("_step")}, {"_s": F.sum})
    return df.withColumn(out, F.col("_in") + F.coalesce("_s", F.lit(0.0))).drop("_step", "_in", "_s")


def add_percent_since_start(chunks: DataFrame, out: str = "percent_since_start") -> DataFrame:
    """Change in percent against the first valid close of the whole series."""
    valid = F.when(F.col("_own") & F.col("close").isNotNull(), F.struct("date", "close"))
    df = prefix(chunks, {"_first": F.min(valid)}, {"_first": F.min})
    with keyed_by(*CHUNK_KEYS):
        here = F.first(F.when(F.col("_own"), F.col("close")), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumn(out, pct(F.col("close"), F.coalesce(F.col("_first.close"), here))).drop("_first")


def add_drawdown(chunks: DataFrame, value: str = "close", out: str = "drawdown_pct") -> DataFrame:
    """Fall in percent from the highest value so far; <= 0."""
    with keyed_by(*CHUNK_KEYS):
        peak = F.max(F.when(F.col("_own"), F.col(value))).over(_so_far())
        df = chunks.withColumn("_peak", peak)
    df = prefix(df, {"_top": F.max(F.col(value))}, {"_top": F.max})
    return df.withColumn(out, pct(F.col(value), F.greatest("_peak", "_top"))).drop("_peak", "_top")


# Whole frames ----------------------------------------------------------------------
INDICATOR_MEMORY = max(200, ind.ema_memory(26, 9))
FEATURE_MEMORY = 20 + 60 + 1
LABEL_REACH = max(labels.FORWARD_PERIODS)


def indicator_table(bars: DataFrame, rows: int = ROWS, bucket_seconds: int = 3600) -> DataFrame:
    """``indicators.indicator_table`` over chunks; the exponential means forget what lies before the halo."""
    return over_chunks(bars, ind.indicator_table, before=INDICATOR_MEMORY, rows=rows, bucket_seconds=bucket_seconds)


def feature_table(bars: DataFrame, rows: int = ROWS, bucket_seconds: int = 3600) -> DataFrame:
    """Lags, range, volatility, regime, OBV, position, change since start, drawdown and forward labels in one pass over chunks."""
    out = chunked(bars, FEATURE_MEMORY, LABEL_REACH, rows, bucket_seconds)
    with keyed_by(*CHUNK_KEYS):
        out = labels.add_forward_labels(features.add_volatility(features.add_lags(out)), drop_tail=False)
    out = add_drawdown(add_percent_since_start(add_obv(add_positions(out))))
    earnings = (F.lit(63) - F.pmod("pos", F.lit(63))).cast("long")
    return own_rows(out.withColumn("days_to_earnings", earnings))
