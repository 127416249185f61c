"""Rule-based technical signal, consensus and score choice (ids H13, H18, I18, C13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.functions import rules
from equityspark.functions.core import clamp, points, truthy


# Points of the trend labels.
TREND_POINTS = {"Strong Uptrend": 10.0, "Uptrend": 5.0, "Strong Downtrend": -10.0, "Downtrend": -5.0}


def technical_signal(snapshot: DataFrame) -> DataFrame:
    """Signal score -100..100, direction, confidence, level, recommendation and reasons
    from the flat indicator snapshot.

    Volume and trend rules depend on the running score, so the score is staged.
    """
    c = F.col
    rsi = truthy(c("rsi_14"))
    macd, sig, hist = c("macd"), c("macd_signal"), c("macd_hist")
    macd_known = (macd != 0) & (sig != 0) & (hist != 0)
    s20, s50, s200 = c("sma_20"), c("sma_50"), c("sma_200")
    ma_known = (s20 != 0) & (s50 != 0) & (s200 != 0)
    dist = F.coalesce(c("vs_sma20"), F.lit(0.0))
    vol = truthy(c("volume_ratio"))
    start = (
        points((rsi < 30, 15), (rsi < 40, 5), (rsi > 70, -15), (rsi > 60, -5))
        + points((macd_known & (macd > sig) & (hist > 0), 15), (macd_known & (macd < sig) & (hist < 0), -15))
        + points((macd_known & (hist > 0.1), 5), (macd_known & (hist < -0.1), -5))
        + points(
            (ma_known & (s20 > s50) & (s50 > s200), 25),
            (ma_known & (s20 < s50) & (s50 < s200), -25),
            (ma_known & (s20 > s50), 10),
            (ma_known & (s20 < s50), -10),
        )
        + points((dist > 5, 10), (dist > 2, 5), (dist < -5, -10), (dist < -2, -5))
    )
    s = c("_s")
    confirm = F.when(vol > 1.5, 10.0).otherwise(0.0)
    with_volume = F.when(vol < 0.5, (s * 0.8).cast("int").cast("double")).otherwise(s + F.signum(s) * confirm)
    trend = c("trend")
    by_trend = F.create_map(*[F.lit(x) for kv in TREND_POINTS.items() for x in kv])
    trend_points = F.coalesce(F.element_at(by_trend, trend), F.lit(0.0))
    out = (
        snapshot.withColumn("_s", start)
        .withColumn("_s1", s)
        .withColumn("_s", with_volume)
        .withColumn("signal_score", clamp(c("_s") + trend_points, -100.0, 100.0).cast("int"))
    )
    score = c("signal_score")
    out = out.withColumns(
        {
            "direction": F.when(score > 0, "BULLISH").when(score < 0, "BEARISH").otherwise("NEUTRAL"),
            "confidence": F.abs(score),
            "signals": _reasons(rsi, macd, sig, hist, macd_known, s20, s50, s200, ma_known, dist, vol, trend),
        }
    )
    return out.withColumns(
        {
            "confidence_level": rules.confidence_level(c("confidence")),
            "recommendation": rules.signal_recommendation(c("direction"), c("confidence")),
        }
    ).drop("_s", "_s1")


def _reasons(rsi, macd, sig, hist, macd_known, s20, s50, s200, ma_known, dist, vol, trend) -> Column:
    def fmt(pattern: str, *cols: Column) -> Column:
        return F.format_string(pattern, *cols)

    before = F.col("_s1")
    return F.array_compact(
        F.array(
            F.when(rsi < 30, fmt("RSI oversold at %.1f (bullish)", rsi))
            .when(rsi < 40, fmt("RSI low at %.1f (slightly bullish)", rsi))
            .when(rsi > 70, fmt("RSI overbought at %.1f (bearish)", rsi))
            .when(rsi > 60, fmt("RSI elevated at %.1f (slightly bearish)", rsi)),
            F.when(macd_known & (macd > sig) & (hist > 0), F.lit("MACD bullish crossover")).when(
                macd_known & (macd < sig) & (hist < 0), F.lit("MACD bearish crossover")
            ),
            F.when(macd_known & (hist > 0.1), F.lit("Strong bullish MACD momentum")).when(
                macd_known & (hist < -0.1), F.lit("Strong bearish MACD momentum")
            ),
            F.when(ma_known & (s20 > s50) & (s50 > s200), F.lit("Perfect bullish MA alignment (20>50>200)"))
            .when(ma_known & (s20 < s50) & (s50 < s200), F.lit("Perfect bearish MA alignment (20<50<200)"))
            .when(ma_known & (s20 > s50), F.lit("Short-term bullish (20>50 MA)"))
            .when(ma_known & (s20 < s50), F.lit("Short-term bearish (20<50 MA)")),
            F.when(dist > 5, fmt("Price %.1f%% above 20-day MA (bullish)", dist)).when(
                dist < -5, fmt("Price %.1f%% below 20-day MA (bearish)", F.abs(dist))
            ),
            F.when((vol > 1.5) & (before > 0), fmt("High volume (%.2fx) confirming bullish move", vol))
            .when((vol > 1.5) & (before < 0), fmt("High volume (%.2fx) confirming bearish move", vol))
            .when(vol < 0.5, fmt("Low volume (%.2fx) - reduced confidence", vol)),
            F.when(trend == "Strong Uptrend", F.lit("Strong uptrend in place"))
            .when(trend == "Uptrend", F.lit("Uptrend in place"))
            .when(trend == "Strong Downtrend", F.lit("Strong downtrend in place"))
            .when(trend == "Downtrend", F.lit("Downtrend in place")),
        )
    )


def fundamental_table(fundamentals: DataFrame) -> DataFrame:
    out = fundamentals.withColumns(
        {"fundamental_score": rules.fundamental_score(), "fundamental_signals": rules.fundamental_reasons()}
    )
    return out.withColumn("rating", rules.fundamental_rating(F.col("fundamental_score")))


def consensus_table(technical: DataFrame, fundamental: DataFrame) -> DataFrame:
    """Votes of technical direction and fundamental rating; either side may be missing."""
    both = technical.select("ticker", "direction").join(fundamental.select("ticker", "rating"), "ticker", "full_outer")
    return both.withColumn("consensus", rules.consensus(F.col("direction"), F.col("rating")))


def choose_score(rule: DataFrame, model: DataFrame) -> DataFrame:
    """Model score where a prediction exists, else the rule score.

    ``model``: (ticker, score, direction, confidence, recommendation) of the newest prediction.
    """
    m = model.select("ticker", *[F.col(c).alias("_m_" + c) for c in ("score", "direction", "confidence", "recommendation")])
    j = rule.join(m, "ticker", "left")
    has = F.col("_m_score").isNotNull()
    return j.select(
        "ticker",
        F.when(has, F.col("_m_score")).otherwise(F.col("signal_score").cast("double")).alias("signal_score"),
        F.when(has, F.upper("_m_direction")).otherwise(F.col("direction")).alias("direction"),
        F.when(has, F.col("_m_confidence")).otherwise(F.col("confidence").cast("double")).alias("confidence"),
        F.when(has, F.col("_m_recommendation")).otherwise(F.col("recommendation")).alias("recommendation"),
        has.alias("ml_powered"),
    )
