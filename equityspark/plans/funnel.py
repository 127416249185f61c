"""Batch scoring and the tiered quick -> medium -> deep funnel (ids F3, F4, D38, H14-H16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityspark.functions import rules
from equityspark.functions.core import clamp
from equityspark.session import cut_lineage


def quick_scores(metrics: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Quick score and signal per ticker; wanted tickers without data get 'error' and 0."""
    out = metrics.withColumn("score", rules.quick_score())
    out = out.withColumn("signal", rules.signal_from_score(F.col("score")))
    if wanted is None:
        return out
    joined = wanted.select("ticker").join(out, "ticker", "left")
    return joined.fillna({"score": 0.0, "signal": "error"})


def medium_scores(quick: DataFrame, technical: DataFrame, fundamental: DataFrame) -> DataFrame:
    """Adds medium_score from the technical direction and the fundamental score."""
    t = technical.select("ticker", F.lower("direction").alias("technical_signal"), F.col("signal_score"))
    f = fundamental.select("ticker", "fundamental_score")
    out = quick.join(t, "ticker", "left").join(f, "ticker", "left")
    return out.withColumn(
        "medium_score", rules.medium_score(F.col("score"), F.col("technical_signal"), F.col("fundamental_score"))
    )


def _only(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the tickers in ``kept``, which is a top-k."""
    return df.where(F.col("ticker").isin([r["ticker"] for r in kept.select("ticker").collect()]))


def tiered(
    quick: DataFrame, technical: DataFrame, fundamental: DataFrame, sentiment: DataFrame,
    quick_top: int = 20, medium_top: int = 10, deep_top: int = 5,
) -> DataFrame:
    """Ranked rows of the three tiers: (tier, rank, ticker, score, signal).

    Each tier only scores what the tier before it kept, and every cut is a top-k.
    The deep score joins the three signals: technical (rescaled to 0-100), fundamental
    and news sentiment, equally weighted. The rows a tier keeps are written and their few
    names become a filter, which Spark moves below the series windows of the next tier's inputs.
    """
    ranked = cut_lineage(quick.where(F.col("signal") != "error").orderBy(F.desc("score"), "ticker").limit(quick_top))
    medium = medium_scores(ranked, _only(technical, ranked), _only(fundamental, ranked))
    medium = cut_lineage(medium.orderBy(F.desc("medium_score"), "ticker").limit(medium_top))
    s = _only(sentiment, medium).select("ticker", F.col("news_sentiment_score").alias("_sent"))
    deep = medium.join(s, "ticker", "left").withColumn(
        "deep_score",
        clamp(
            ((F.coalesce(F.col("signal_score"), F.lit(0)) + 100.0) / 2.0
             + F.coalesce(F.col("fundamental_score"), F.lit(50.0))
             + F.coalesce(F.col("_sent"), F.lit(50.0))) / 3.0, 0.0, 100.0),
    ).orderBy(F.desc("deep_score"), "ticker").limit(deep_top)

    def tier(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("tier"), "ticker", F.col(column).alias("score"))

    out = tier(ranked, "quick", "score").unionByName(tier(medium, "medium", "medium_score")).unionByName(tier(deep, "deep", "deep_score"))
    return out.withColumn("signal", rules.signal_from_score(F.col("score")))


def tier_summary(screened: DataFrame, tiers: DataFrame) -> DataFrame:
    """Rows screened and kept per tier."""
    total = screened.agg(F.count("*").alias("n")).select(F.lit("screened").alias("tier"), "n")
    return total.unionByName(tiers.groupBy("tier").agg(F.count("*").alias("n")))
