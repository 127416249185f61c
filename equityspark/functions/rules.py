"""Rule labels and scores as plain Column expressions (ids H1-H5, H12-H21, E-free)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clamp, points, truthy


def trend(s20: Column, s50: Column, s200: Column) -> Column:
    s20, s50, s200 = truthy(s20), truthy(s50), truthy(s200)
    known = s20.isNotNull() & s50.isNotNull() & s200.isNotNull()
    label = (
        F.when((s20 > s50) & (s50 > s200), "Strong Uptrend")
        .when(s20 > s50, "Uptrend")
        .when((s20 < s50) & (s50 < s200), "Strong Downtrend")
        .when(s20 < s50, "Downtrend")
        .otherwise("Sideways")
    )
    return F.when(known, label).otherwise("Unknown")


def macd_label(macd: Column, signal: Column, hist: Column) -> Column:
    m, s = truthy(macd), truthy(signal)
    return F.when((m > s) & (hist > 0), "Bullish").when((m < s) & (hist < 0), "Bearish").otherwise("Neutral")


def rsi_label(rsi: Column) -> Column:
    x = truthy(rsi)
    return F.when(x > 70, "Overbought").when(x < 30, "Oversold").otherwise("Neutral")


# Label words and their sign.
SENTIMENT_SIGN = {"positive": 1.0, "bullish": 1.0, "neutral": 0.0, "negative": -1.0, "bearish": -1.0}
TREND_SIGN = {"improving": 1.0, "stable": 0.0, "deteriorating": -1.0}


def _sign(x: Column, table: dict[str, float]) -> Column:
    key = F.lower(F.trim(x))
    expr = F.lit(0.0)
    for word, value in table.items():
        expr = F.when(key == word, F.lit(value)).otherwise(expr)
    return expr


def sentiment_sign(x: Column) -> Column:
    return _sign(x, SENTIMENT_SIGN)


def trend_sign(x: Column) -> Column:
    return _sign(x, TREND_SIGN)


def recommendation(direction: Column, confidence: Column, expected: Column) -> Column:
    bull, bear = direction == "bullish", direction == "bearish"
    return (
        F.when(bull & (confidence > 70) & (expected > 3), "STRONG BUY")
        .when(bull & (confidence > 60) & (expected > 1), "BUY")
        .when(bear & (confidence > 70) & (expected < -3), "STRONG SELL")
        .when(bear & (confidence > 60) & (expected < -1), "SELL")
        .otherwise("HOLD")
    )


def prediction_score(direction: Column, confidence: Column, expected: Column) -> Column:
    up = F.least(F.lit(100.0), confidence + expected * 5.0)
    down = F.greatest(F.lit(-100.0), -confidence + expected * 5.0)
    return F.when(direction == "bullish", up).when(direction == "bearish", down).otherwise(F.lit(0.0))


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence > 70, "Very High").when(confidence > 50, "High").when(confidence > 30, "Medium")
        .when(confidence > 15, "Low").otherwise("Very Low")
    )


def signal_recommendation(direction: Column, confidence: Column) -> Column:
    bull, bear = direction == "BULLISH", direction == "BEARISH"
    return (
        F.when(bull & (confidence > 50), "STRONG BUY").when(bull & (confidence > 30), "BUY")
        .when(bear & (confidence > 50), "STRONG SELL").when(bear & (confidence > 30), "SELL").otherwise("HOLD")
    )


def signal_from_score(score: Column) -> Column:
    return F.when(score >= 65, "bullish").when(score <= 35, "bearish").otherwise("neutral")


def fundamental_rating(score: Column) -> Column:
    return (
        F.when(score >= 80, "STRONG BUY").when(score >= 65, "BUY").when(score >= 35, "HOLD")
        .when(score >= 20, "SELL").otherwise("STRONG SELL")
    )


def fundamental_score() -> Column:
    """0-100 from flat ratio columns (fractions; debt_to_equity in percent units).

    Zero counts as missing everywhere except debt_to_equity.
    """
    pe, peg = truthy(F.col("pe_ratio")), truthy(F.col("peg_ratio"))
    margin, roe = truthy(F.col("profit_margin")), truthy(F.col("roe"))
    rev, eps = truthy(F.col("revenue_growth")), truthy(F.col("earnings_growth"))
    debt, cr = F.col("debt_to_equity"), truthy(F.col("current_ratio"))
    total = (
        F.lit(50.0)
        + points((pe < 15, 10), (pe > 30, -10))
        + points((peg < 1, 10), (peg > 2, -5))
        + points((margin > 0.20, 10), (margin < 0.05, -10))
        + points((roe > 0.15, 10), (roe < 0.05, -5))
        + points((rev > 0.15, 10), (rev < 0, -10))
        + points((eps > 0.15, 5), (eps < 0, -5))
        + points((debt < 50, 5), (debt > 150, -10))
        + points((cr > 1.5, 5), (cr < 1, -10))
    )
    return clamp(total, 0.0, 100.0)


def fundamental_reasons() -> Column:
    """Texts of the fundamental rules that fired, in rule order."""

    def said(name: str, low, high, fmt: str, low_text: str, high_text: str, scale: float = 1.0, zero_ok: bool = False) -> list[Column]:
        x = F.col(name) if zero_ok else truthy(F.col(name))
        shown = F.format_string(fmt, x * scale)
        return [
            F.when(low(x), F.concat(F.lit(low_text + " ("), shown, F.lit(")"))).when(
                high(x), F.concat(F.lit(high_text + " ("), shown, F.lit(")"))
            )
        ]

    parts = (
        said("pe_ratio", lambda x: x < 15, lambda x: x > 30, "%.1f", "Attractive P/E ratio", "High P/E ratio")
        + said("peg_ratio", lambda x: x < 1, lambda x: x > 2, "%.2f", "Strong PEG ratio", "Elevated PEG ratio")
        + said("profit_margin", lambda x: x > 0.20, lambda x: x < 0.05, "%.1f%%", "Strong profit margin", "Weak profit margin", 100.0)
        + said("roe", lambda x: x > 0.15, lambda x: x < 0.05, "%.1f%%", "Healthy ROE", "Low ROE", 100.0)
        + said("revenue_growth", lambda x: x > 0.15, lambda x: x < 0, "%.1f%%", "Strong revenue growth", "Declining revenue", 100.0)
        + said("earnings_growth", lambda x: x > 0.15, lambda x: x < 0, "%.1f%%", "Strong earnings growth", "Declining earnings", 100.0)
        + said("debt_to_equity", lambda x: x < 50, lambda x: x > 150, "D/E: %.1f", "Low debt levels", "High debt levels", 1.0, True)
        + said("current_ratio", lambda x: x > 1.5, lambda x: x < 1, "CR: %.2f", "Strong liquidity", "Liquidity concerns")
    )
    return F.array_compact(F.array(*parts))


def quick_score() -> Column:
    """0-100 from quick metrics; absent metrics take neutral defaults."""
    rsi = F.coalesce(F.col("rsi"), F.lit(50.0))
    dist = F.coalesce(F.col("price_vs_sma20"), F.lit(0.0))
    vol = F.coalesce(F.col("volume_ratio"), F.lit(1.0))
    pe = truthy(F.col("pe_ratio"))
    ret = F.coalesce(F.col("returns_5d"), F.lit(0.0))
    total = (
        F.lit(50.0)
        + points((rsi < 30, 20), (rsi > 70, -20), ((rsi >= 40) & (rsi <= 60), 5))
        + points((dist > 5, 10), (dist > 0, 5), (dist < -5, -10))
        + points((vol > 1.5, 5))
        + points(((pe > 10) & (pe < 25), 10), (pe > 50, -5))
        + points((ret > 5, 10), (ret > 0, 5), (ret < -5, -10))
    )
    return clamp(total, 0.0, 100.0)


def medium_score(quick: Column, technical: Column, fundamental: Column) -> Column:
    """Quick score moved by the technical signal and the fundamental score."""
    tech = points((technical == "bullish", 15), (technical == "bearish", -15))
    return clamp(quick + tech + (F.coalesce(fundamental, F.lit(50.0)) - 50.0) / 5.0, 0.0, 100.0)


def consensus(direction: Column, rating: Column) -> Column:
    up = points((direction == "BULLISH", 1)) + points((rating.contains("BUY"), 1))
    down = points((direction == "BEARISH", 1)) + points((rating.contains("BUY"), 0), (rating.contains("SELL"), 1))
    return F.when(up > down, "BULLISH").when(down > up, "BEARISH").otherwise("MIXED")


def sentiment_split(label: Column) -> Column:
    """Approximate bullish/bearish/neutral percentages of a sentiment class."""

    def split(a: float, b: float, c: float) -> Column:
        return F.struct(F.lit(a).alias("bullish_pct"), F.lit(b).alias("bearish_pct"), F.lit(c).alias("neutral_pct"))

    return F.when(label == "Bullish", split(65.0, 15.0, 20.0)).when(label == "Bearish", split(15.0, 65.0, 20.0)).otherwise(
        split(30.0, 30.0, 40.0)
    )
