"""Latest-row reports per ticker: indicator snapshot, quick metrics, day metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions import rules
from equityspark.functions.core import series, latest_per, pct, ratio, trailing, truthy

OHLCV = ["open", "high", "low", "close", "volume"]


def latest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns of the newest row of each ticker."""
    return latest_per(df, ["ticker"], "date", cols)


def latest_bar(bars: DataFrame) -> DataFrame:
    return latest(bars, ["date", *OHLCV])


def daily_change(close: Column) -> Column:
    """Percent change against the previous row; 0 on the first row."""
    return F.coalesce(pct(close, F.lag(close).over(series())), F.lit(0.0))


def latest_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Newest RSI, 50 when there are not more than ``n`` rows or it is undefined."""
    b = bars.withColumn("rsi", ind.rsi(F.col("close"), n))
    out = b.groupBy("ticker").agg(F.max_by(F.struct("rsi"), "date").alias("_r"), F.count("*").alias("_n"))
    value = F.when(F.col("_n") > n, F.col("_r.rsi"))
    return out.select("ticker", F.coalesce(value, F.lit(50.0)).alias("rsi"))


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    close = F.col("close")
    b = bars.withColumns(
        {"support": F.min(close).over(trailing(n)), "resistance": F.max(close).over(trailing(n)), "current": close}
    )
    return latest(b, ["support", "resistance", "current"])


def flat_snapshot(bars: DataFrame) -> DataFrame:
    """All indicators and labels at the newest row, one flat row per ticker."""
    last = ind.latest_indicators(bars, ["date", *OHLCV])
    c = F.col
    return last.withColumns(
        {
            "current_price": c("close"),
            "price_high": c("high"),
            "price_low": c("low"),
            "volume_current": c("volume"),
            "volume_average": c("volume_sma_20"),
            "volume_ratio": ratio(c("volume"), c("volume_sma_20")),
            "trend": rules.trend(c("sma_20"), c("sma_50"), c("sma_200")),
            "macd_label": rules.macd_label(c("macd"), c("macd_signal"), c("macd_hist")),
            "rsi_label": rules.rsi_label(c("rsi_14")),
            "vs_sma20": pct(c("close"), truthy(c("sma_20"))),
            "vs_sma50": pct(c("close"), truthy(c("sma_50"))),
            "vs_sma200": pct(c("close"), truthy(c("sma_200"))),
        }
    )


def nested_snapshot(flat: DataFrame) -> DataFrame:
    """The flat snapshot as one record with the grouped structure of the report."""
    c = F.col

    def group(**cols: str) -> Column:
        return F.struct(*[c(v).alias(k) for k, v in cols.items()])

    return flat.select(
        "ticker",
        "date",
        "current_price",
        "price_high",
        "price_low",
        group(value="rsi_14", signal="rsi_label").alias("rsi"),
        group(macd="macd", signal="macd_signal", histogram="macd_hist", signal_interpretation="macd_label").alias("macd"),
        group(SMA_20="sma_20", SMA_50="sma_50", SMA_200="sma_200").alias("moving_averages"),
        group(upper="bb_upper", middle="bb_middle", lower="bb_lower").alias("bollinger_bands"),
        group(current="volume_current", average="volume_average", ratio="volume_ratio").alias("volume"),
        group(support="support", resistance="resistance", current="close").alias("support_resistance"),
        "trend",
        group(vs_SMA20="vs_sma20", vs_SMA50="vs_sma50", vs_SMA200="vs_sma200").alias("price_position"),
    )


def quick_metrics(bars: DataFrame, fundamentals: DataFrame | None = None, info: DataFrame | None = None) -> DataFrame:
    """Screening metrics of the newest row over the given period.

    returns_5d compares with the first row of the period (at least 5 rows), as the
    screens expect; returns_5_rows is the plain 5-row return. Margins, growth, yield
    and return on equity are percent here and fractions in ``fundamentals``.
    """
    close = F.col("close")
    w_all = Window.partitionBy("ticker")
    n = F.col("_n")
    b = bars.withColumns({"_n": F.count("*").over(w_all), "avg_volume": F.avg("volume").over(w_all)})
    b = b.withColumns(
        {
            "returns_1d": F.coalesce(pct(close, F.lag(close).over(series())), F.lit(0.0)),
            "_since": ind.percent_since_start(close),
            "returns_5_rows": pct(close, F.lag(close, 5).over(series())),
            "_rsi": ind.rsi(close),
            "sma_20": ind.sma(close, 20),
            "sma_50": ind.sma(close, 50),
        }
    )
    b = b.withColumns(
        {
            "price": close,
            "returns_5d": F.when(n >= 5, F.col("_since")).otherwise(F.lit(0.0)),
            "rsi": F.when(n > 14, F.coalesce("_rsi", F.lit(50.0))).when(n == 14, F.lit(50.0)),
            "price_vs_sma20": pct(close, F.col("sma_20")),
            "volume_ratio": F.when(F.col("avg_volume") > 0, ratio(F.col("volume"), F.col("avg_volume"))).otherwise(F.lit(1.0)),
        }
    )
    cols = ["price", "volume", "returns_1d", "returns_5d", "returns_5_rows", "rsi", "sma_20", "price_vs_sma20", "sma_50",
            "avg_volume", "volume_ratio"]
    out = latest(b, cols)
    if info is not None:
        out = out.join(info.select("ticker", "market_cap", "sector", "industry"), "ticker", "left").fillna(
            {"sector": "Unknown", "industry": "Unknown", "market_cap": 0.0}
        )
    if fundamentals is not None:
        out = out.join(percent_fundamentals(fundamentals), "ticker", "left").fillna({"dividend_yield": 0.0})
    return out


def percent_fundamentals(fundamentals: DataFrame) -> DataFrame:
    """Fractions to percent; zero counts as missing, a missing yield is 0."""
    out = fundamentals
    for name in ("profit_margin", "roe", "revenue_growth", "earnings_growth"):
        out = out.withColumn(name, truthy(F.col(name)) * 100.0)
    return out.withColumn("dividend_yield", F.coalesce(F.col("dividend_yield") * 100.0, F.lit(0.0)))


def day_metrics(bars: DataFrame) -> DataFrame:
    """Change from open and previous close, volume against the mean, significance."""
    close, volume = F.col("close"), F.col("volume")
    mean = F.avg(volume).over(Window.partitionBy("ticker"))
    out = bars.withColumns(
        {
            "day_change_pct": F.coalesce(pct(close, F.col("open")), F.lit(0.0)),
            "prev_change_pct": daily_change(close),
            "volume_vs_avg": F.coalesce(pct(volume, mean), F.lit(0.0)),
        }
    )
    return out.withColumn("significant", (F.abs("day_change_pct") > 3) | (F.abs("volume_vs_avg") > 50))
