"""Feature columns, training joins and projections (ids B26, B27, C1-C5, E12-E19, H23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions.core import series, full, ratio, trailing

# Neutral sentiment and the base feature list of the trained models.
SENTIMENT_DEFAULTS = {
    "news_sentiment_score": 50.0,
    "news_sentiment_confidence": 0.0,
    "news_sentiment_article_count": 0.0,
    "news_sentiment_trend": 0.0,
    "news_macro_sentiment": 0.0,
    "news_company_expected_revenue_sentiment": 0.0,
    "news_company_specific_sentiment": 0.0,
    "news_industry_peer_sentiment": 0.0,
}
BASE_FEATURES = [
    "open", "high", "low", "close", "volume", "rsi_14", "macd", "macd_signal", "macd_hist",
    "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "bb_upper", "bb_middle", "bb_lower", "volume_sma_20",
]
EXTENDED_FEATURES = [
    "lag_return_1d", "lag_return_5d", "lag_return_10d", "lag_return_20d", "atr_14", "realized_vol_20d",
    "volatility_regime", "bb_pct_b", "bb_width", "day_of_week", "month", "days_to_earnings",
]


def add_lags(df: DataFrame, periods: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    return df.withColumns({f"lag_return_{n}d": ind.lag_return(F.col("close"), n) for n in periods})


def add_volatility(df: DataFrame) -> DataFrame:
    """ATR-14, realised volatility over 20 log returns, and its regime flag."""
    close = F.col("close")
    out = df.withColumns({"atr_14": ind.atr(F.col("high"), F.col("low"), close), "_lr": ind.log_return(close)})
    vol = full(20, F.col("_lr"), F.stddev_samp("_lr").over(trailing(20)))
    out = out.withColumn("realized_vol_20d", vol)
    median = ind.rolling_median(F.col("realized_vol_20d"), 60)
    regime = F.when(F.col("realized_vol_20d").isNotNull(), (F.col("realized_vol_20d") > median).cast("int"))
    return out.withColumn("volatility_regime", regime).drop("_lr")


def benchmark_returns(df: DataFrame, benchmark: str = "SPY", n: int = 20) -> DataFrame:
    """(date, _bench): the benchmark's n-row return; one row per date."""
    own = df.where(F.col("ticker") == benchmark)
    return own.select("date", ind.lag_return(F.col("close"), n).alias("_bench"))


def add_relative_strength(df: DataFrame, benchmark: str = "SPY", n: int = 20, bench: DataFrame | None = None) -> DataFrame:
    """n-row return over the benchmark's return on the same date.

    The benchmark side (``bench`` if it is known from a narrower frame) has one row per date, so
    broadcasting it is bounded by the calendar. Without a benchmark in the data the column is null.
    """
    out = df.withColumn("_ret", ind.lag_return(F.col("close"), n))
    side = benchmark_returns(df, benchmark, n) if bench is None else bench
    return (
        out.join(F.broadcast(side), "date", "left")
        .withColumn("rs_vs_benchmark_20d", ratio(F.col("_ret"), F.col("_bench")))
        .drop("_ret", "_bench")
    )


def add_bands(df: DataFrame) -> DataFrame:
    up, mid, lo = F.col("bb_upper"), F.col("bb_middle"), F.col("bb_lower")
    return df.withColumns({"bb_pct_b": ind.percent_b(F.col("close"), up, lo), "bb_width": ind.band_width(up, mid, lo)})


def add_calendar(df: DataFrame) -> DataFrame:
    """Monday-based weekday, month, and the days-to-earnings proxy; nulls without a date."""
    if "date" not in df.columns:
        null = F.lit(None).cast("int")
        return df.withColumns({"day_of_week": null, "month": null, "days_to_earnings": F.lit(None).cast("long")})
    return df.withColumns(
        {"day_of_week": F.weekday("date"), "month": F.month("date"), "days_to_earnings": ind.days_to_earnings()}
    )


def training_join(bars: DataFrame, indicators: DataFrame, labels: DataFrame, info: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """price x indicators x labels on (ticker, date), left info on ticker, optional left sentiment."""
    out = bars.join(indicators, ["ticker", "date"]).join(labels, ["ticker", "date"]).join(info, "ticker", "left")
    return out.join(sentiment, ["ticker", "date"], "left") if sentiment is not None else out


def export_join(bars: DataFrame, indicators: DataFrame, labels: DataFrame, info: DataFrame) -> DataFrame:
    """All bars that have a 5-row forward return, with whatever else is known.

    The filter on the label side lets Catalyst turn that outer join into an inner one.
    """
    return (
        bars.join(indicators, ["ticker", "date"], "left")
        .join(labels, ["ticker", "date"], "left")
        .join(info, "ticker", "left")
        .where(F.col("forward_5d_return").isNotNull())
    )


def asof_align(main: DataFrame, peer: DataFrame, peer_value: str, out: str) -> DataFrame:
    """Value of ``peer`` at or before each ``main`` date (backward as-of).

    The alignment depends on the date alone, so it is solved once per calendar date:
    union of both date sets, last non-null value in date order. That frame has at most
    one row per calendar date and is broadcast back, so the bars are not shuffled.
    """
    marks = peer.select("date", F.col(peer_value).alias(out))
    days = main.select("date").distinct().withColumn(out, F.lit(None).cast("double")).unionByName(marks)
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    calendar = (
        days.groupBy("date").agg(F.max(out).alias("_v"))
        .select("date", F.last("_v", ignorenulls=True).over(w).alias(out))
    )
    return main.join(F.broadcast(calendar), "date")


def asof_align_peers(main: DataFrame, peers: DataFrame, value: str) -> DataFrame:
    """Long form of several peers: (ticker, date, peer, value at or before the date), null before a peer's start.

    ``peers`` has (peer, date, value). The calendar of all dates is completed per peer, so a
    window holds one row per calendar date.
    """
    marks = peers.select("peer", F.to_date("date").alias("date"), F.col(value).alias("_v"))
    days = main.select(F.to_date("date").alias("date")).distinct()
    grid = days.join(F.broadcast(marks.select("peer").distinct()))  # one row per calendar date and named peer
    w = Window.partitionBy("peer").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        grid.withColumn("_v", F.lit(None).cast("double")).unionByName(marks).groupBy("peer", "date").agg(F.max("_v").alias("_v"))
        .select("peer", "date", F.last("_v", ignorenulls=True).over(w).alias(value))
    )
    return main.select("ticker", "date").join(filled, "date")


def fill_sentiment(df: DataFrame) -> DataFrame:
    have = {k: v for k, v in SENTIMENT_DEFAULTS.items() if k in df.columns}
    return df.fillna(have) if have else df


def model_features(df: DataFrame, feature_set: str = "base", target: tuple[str, str] | None = ("direction_5d", "forward_5d_return")) -> DataFrame:
    """Available feature columns plus three ratios; rows with any null are dropped."""
    wanted = BASE_FEATURES + list(SENTIMENT_DEFAULTS) + (EXTENDED_FEATURES if feature_set == "extended" else [])
    names = [c for c in wanted if c in df.columns]
    out = fill_sentiment(df)
    derived: dict[str, Column] = {}
    if {"close", "sma_20"} <= set(names):
        derived["price_to_sma20"] = ratio(F.col("close"), F.col("sma_20")) - 1.0
    if {"close", "sma_50"} <= set(names):
        derived["price_to_sma50"] = ratio(F.col("close"), F.col("sma_50")) - 1.0
    if {"volume", "volume_sma_20"} <= set(names):
        derived["volume_ratio"] = ratio(F.col("volume"), F.col("volume_sma_20"))
    out = out.withColumns(derived) if derived else out
    features = names + list(derived)
    keys = [c for c in ("ticker", "date") if c in df.columns]
    return out.select(*keys, *features, *(target or ())).dropna(subset=features + list(target or ()))


def inference_features(snapshot: DataFrame, columns: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Latest-row features in training order, missing values 0.

    True opens and EMAs are used; ``compat`` restores the approximation
    (open := close, ema_12 := sma_20, ema_26 := sma_50).
    """
    close = F.col("close")
    out = snapshot
    if compat:
        out = out.withColumns({"open": close, "ema_12": F.col("sma_20"), "ema_26": F.col("sma_50")})
    defaults = {c: close for c in ("sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "bb_upper", "bb_middle", "bb_lower")}
    defaults |= {"rsi_14": F.lit(50.0), "volume_sma_20": F.col("volume")}
    out = out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in out.columns})
    out = out.withColumns(
        {
            "price_to_sma20": ratio(close, F.col("sma_20")) - 1.0,
            "price_to_sma50": ratio(close, F.col("sma_50")) - 1.0,
            "volume_ratio": ratio(F.col("volume"), F.col("volume_sma_20")),
        }
    )
    names = columns or BASE_FEATURES + ["price_to_sma20", "price_to_sma50", "volume_ratio"]
    names = [c for c in names if c in out.columns]
    return out.select("ticker", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def regime_inputs(bars: DataFrame) -> DataFrame:
    """20-row deviation of changes and distance from the 50-row mean, per row, with the
    per-ticker medians (a ticker has at most one row per date, so the median is bounded)."""
    close = F.col("close")
    prev = F.lag("close").over(series())
    out = bars.withColumn("_chg", ratio(close - prev, prev))
    out = out.withColumns(
        {
            "vol_20": full(20, F.col("_chg"), F.stddev_samp("_chg").over(trailing(20))),
            "_sma50": ind.sma(close, 50),
        }
    ).withColumn("dev_50", F.abs(ratio(close - F.col("_sma50"), F.col("_sma50"))))
    whole = Window.partitionBy("ticker")  # joining the medians back would work the series out twice
    out = out.withColumns({"med_vol": F.median("vol_20").over(whole), "med_dev": F.median("dev_50").over(whole)})
    trending = (F.col("vol_20") > F.col("med_vol")) & (F.col("dev_50") > F.col("med_dev"))
    return (
        out.where(F.col("ticker").isNotNull())
        .withColumn("regime", F.when(trending, "trending").otherwise("ranging"))
        .select("ticker", "date", "close", "vol_20", "dev_50", "med_vol", "med_dev", "regime")
    )
