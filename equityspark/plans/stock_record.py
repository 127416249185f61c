"""Period summary and the complete record of an instrument (ids C14, D2, H28, H33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.functions.core import pct, top_n


def period_summary(bars: DataFrame) -> DataFrame:
    """Points, range, latest price and volume, change and mean volume per ticker."""
    g = bars.groupBy("ticker").agg(
        F.count("*").alias("data_points"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.max_by("close", "date").alias("latest_price"),
        F.max_by("volume", "date").alias("_v"),
        F.max("high").alias("period_high"),
        F.min("low").alias("period_low"),
        F.min_by("close", "date").alias("_first"),
        F.avg("volume").alias("_avg"),
    )
    return g.select(
        "ticker", "data_points", "start_date", "end_date", "latest_price",
        F.col("_v").cast("long").alias("latest_volume"),
        "period_high", "period_low",
        (F.col("latest_price") - F.col("_first")).alias("price_change"),
        pct(F.col("latest_price"), F.col("_first")).alias("price_change_percent"),
        F.floor("_avg").cast("long").alias("average_volume"),
    )


def stock_record(info: DataFrame, bars: DataFrame, fundamentals: DataFrame, news: DataFrame, earnings: DataFrame, n: int = 10) -> DataFrame:
    """One row per instrument: info, price summary, ratios, newest ``n`` articles and dates.

    Lists are cut to the top ``n`` before they are gathered into an array.
    """
    top_news = top_n(news, ["ticker"], [F.desc("published"), F.asc("article_id")], n)
    articles = top_news.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("rn", "title", "publisher", "published"))).alias("recent_news"))
    top_dates = top_n(earnings.select("ticker", "date", "upcoming").distinct(), ["ticker"], [F.desc("date"), F.desc("upcoming")], n)
    dates = top_dates.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "upcoming"))).alias("earnings_dates"))
    out = info.join(period_summary(bars), "ticker", "left").join(fundamentals, "ticker", "left")
    return out.join(articles, "ticker", "left").join(dates, "ticker", "left")


def summary_line(as_of: str) -> Column:
    """One-line searchable text of an analysis."""
    return F.concat(
        F.format_string("Stock analysis for %s on %s. ", F.col("ticker"), F.lit(as_of)),
        F.format_string("%s - %s. ", F.coalesce("name", F.col("ticker")), F.coalesce("sector", F.lit("Unknown sector"))),
        F.format_string("Price: $%.2f, ", F.coalesce("latest_price", F.lit(0.0))),
        F.format_string("Change: %.2f%%", F.coalesce("price_change_percent", F.lit(0.0))),
    )


def record_text() -> Column:
    """Readable text of a stock record."""

    def ratio_line(label: str, name: str) -> Column:
        return F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(name).cast("string"), F.lit("N/A")))

    return F.concat_ws(
        "\n",
        F.format_string("Stock Analysis Data for %s", F.col("ticker")),
        F.format_string("- Name: %s", F.coalesce("name", F.lit("N/A"))),
        F.format_string("- Sector: %s", F.coalesce("sector", F.lit("N/A"))),
        F.format_string("- Industry: %s", F.coalesce("industry", F.lit("N/A"))),
        F.format_string("- Price: $%.2f", F.coalesce("latest_price", F.lit(0.0))),
        F.format_string("- Market Cap: $%,.0f", F.coalesce("market_cap", F.lit(0.0))),
        F.format_string("- Period Change: %.2f%%", F.coalesce("price_change_percent", F.lit(0.0))),
        F.format_string("- Period High: $%.2f", F.coalesce("period_high", F.lit(0.0))),
        F.format_string("- Period Low: $%.2f", F.coalesce("period_low", F.lit(0.0))),
        *[ratio_line(label, c) for label, c in (
            ("P/E Ratio", "pe_ratio"), ("PEG Ratio", "peg_ratio"), ("Price to Book", "price_to_book"),
            ("Profit Margin", "profit_margin"), ("ROE", "roe"), ("Debt to Equity", "debt_to_equity"), ("Current Ratio", "current_ratio"))],
    )


def indicator_text() -> Column:
    """Readable text of the flat indicator snapshot."""
    c = F.col

    def money(label: str, name: str) -> Column:
        return F.format_string(f"- {label}: $%.2f", F.coalesce(c(name), F.lit(0.0)))

    return F.concat_ws(
        "\n",
        F.lit("Technical Analysis Indicators"),
        F.format_string("Current Price: $%.2f", c("current_price")),
        F.format_string("Trend: %s", c("trend")),
        F.format_string("- RSI (14): %.2f - %s", c("rsi_14"), c("rsi_label")),
        F.format_string("- MACD: %.4f (Signal: %.4f)", c("macd"), c("macd_signal")),
        F.format_string("- MACD Signal: %s", c("macd_label")),
        *[F.format_string(f"- SMA {n}: $%.2f (%+.2f%%)", F.coalesce(c(f"sma_{n}"), F.lit(0.0)), F.coalesce(c(f"vs_sma{n}"), F.lit(0.0))) for n in (20, 50, 200)],
        money("Upper", "bb_upper"), money("Middle", "bb_middle"), money("Lower", "bb_lower"),
        F.format_string("- Volume Ratio: %.2fx", c("volume_ratio")),
        money("Resistance", "resistance"), money("Support", "support"),
    )


def signal_text() -> Column:
    """Readable text of a technical signal row."""
    c = F.col
    return F.concat_ws(
        "\n",
        F.format_string("Overall Signal: %s", c("direction")),
        F.format_string("Recommendation: %s", c("recommendation")),
        F.format_string("Confidence: %d/100 (%s)", c("confidence"), c("confidence_level")),
        F.array_join(F.transform("signals", lambda s: F.concat(F.lit("  • "), s)), "\n"),
        F.format_string("A score of %+d/100 indicates %s sentiment with %s confidence.", c("signal_score"), F.lower("direction"), F.lower("confidence_level")),
    )


def medium_text() -> Column:
    """Readable text of a medium analysis row (technical_signal, fundamental_score, price, rsi)."""
    c = F.col
    tech, fund = F.coalesce("technical_signal", F.lit("neutral")), F.coalesce("fundamental_score", F.lit(50.0))
    closing = (
        F.when((tech == "bullish") & (fund > 60), "Strong buy candidate with positive technical and fundamental signals.")
        .when((tech == "bearish") | (fund < 40), "Caution advised. Weak technical or fundamental indicators.")
        .otherwise("Mixed signals. Further analysis recommended.")
    )
    return F.concat_ws(
        "\n",
        F.format_string("%s Analysis Summary\n", c("ticker")),
        F.format_string("Price: $%.2f", F.coalesce("price", F.lit(0.0))),
        F.format_string("Technical Signal: %s", F.upper(tech)),
        F.format_string("Fundamental Score: %.0f/100", fund),
        F.format_string("RSI: %.1f\n", F.coalesce("rsi", F.lit(50.0))),
        closing,
    )
