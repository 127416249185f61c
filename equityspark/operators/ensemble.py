"""Combining model predictions per (ticker, date) (ids I10-I12, I14, I15, E29).

Input is the long form (ticker, date, model, direction, confidence, expected_return),
unique on (ticker, date, model); a failed model has a null direction. Every strategy is
one hash aggregation over a handful of models per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions import rules
from equityspark.functions.core import ratio, top_n

UNANIMOUS_BONUS = 15.0
VOTING_BONUS = 10.0


def _base(predictions: DataFrame) -> DataFrame:
    ok = F.col("direction").isNotNull()
    bull, bear = F.lower("direction") == "bullish", F.lower("direction") == "bearish"

    def mean(c: str, cond: Column) -> Column:
        return F.avg(F.when(cond, F.col(c)))

    votes = F.array_join(
        F.array_sort(F.collect_list(F.when(ok, F.concat(F.col("model"), F.lit(": "), F.col("direction"))))), ", "
    )
    return predictions.groupBy("ticker", "date").agg(
        F.count_if(ok).alias("n_models"),
        F.count_if(ok & bull).alias("n_bull"),
        F.count_if(ok & bear).alias("n_bear"),
        mean("confidence", ok).alias("conf_all"),
        mean("expected_return", ok).alias("ret_all"),
        mean("confidence", ok & bull).alias("conf_bull"),
        mean("expected_return", ok & bull).alias("ret_bull"),
        mean("confidence", ok & bear).alias("conf_bear"),
        mean("expected_return", ok & bear).alias("ret_bear"),
        votes.alias("model_votes"),
    )


def _finish(df: DataFrame, extra: list[str]) -> DataFrame:
    """Score, recommendation, the neutral error row, and the published rounding."""
    c = F.col
    failed = c("n_models") == 0
    out = df.withColumns(
        {
            "direction": F.when(failed, "neutral").otherwise(c("direction")),
            "confidence": F.when(failed, 0.0).otherwise(c("confidence")),
            "expected_return": F.when(failed, 0.0).otherwise(c("expected_return")),
        }
    )
    args = (c("direction"), c("confidence"), c("expected_return"))
    out = out.withColumns(
        {
            "score": rules.prediction_score(*args),
            "recommendation": rules.recommendation(*args),
            "error": F.when(failed, "All models failed"),
        }
    )
    return out.select(
        "ticker",
        "date",
        "direction",
        F.round("confidence", 1).alias("confidence"),
        F.round("expected_return", 2).alias("expected_return"),
        F.round("score", 1).alias("score"),
        "recommendation",
        "n_models",
        "error",
        *extra,
    )


def voting(predictions: DataFrame) -> DataFrame:
    """Majority direction with the means of the agreeing models; ties are neutral."""
    c = F.col
    up, down = c("n_bull") > c("n_bear"), c("n_bear") > c("n_bull")

    def pick(name: str) -> Column:
        return F.when(up, c(f"{name}_bull")).when(down, c(f"{name}_bear")).otherwise(c(f"{name}_all"))

    agree = F.when(up, c("n_bull")).when(down, c("n_bear")).otherwise(c("n_models"))
    out = _base(predictions).withColumns(
        {
            "direction": F.when(up, "bullish").when(down, "bearish").otherwise("neutral"),
            "n_agree": agree,
            "expected_return": pick("ret"),
            "bullish_pct": F.coalesce(ratio(c("n_bull"), c("n_models")) * 100.0, F.lit(0.0)),
            "bearish_pct": F.coalesce(ratio(c("n_bear"), c("n_models")) * 100.0, F.lit(0.0)),
        }
    )
    whole = (c("n_agree") == c("n_models")) & (c("direction") != "neutral")
    out = out.withColumn("confidence", F.when(whole, F.least(F.lit(100.0), pick("conf") + VOTING_BONUS)).otherwise(pick("conf")))
    text = F.format_string("%d/%d models agree", c("n_agree"), c("n_models"))
    return _finish(out.withColumn("ensemble_agreement", text), ["n_agree", "bullish_pct", "bearish_pct", "ensemble_agreement", "model_votes"])


def averaging(predictions: DataFrame) -> DataFrame:
    """Means over all models; direction by the mean return outside +-0.5."""
    r = F.col("ret_all")
    out = _base(predictions).withColumns(
        {
            "direction": F.when(r > 0.5, "bullish").when(r < -0.5, "bearish").otherwise("neutral"),
            "confidence": F.col("conf_all"),
            "expected_return": r,
        }
    )
    return _finish(out, [])


def unanimous(predictions: DataFrame) -> DataFrame:
    """All models on one side, or neutral with nothing."""
    c = F.col
    up = (c("n_bull") == c("n_models")) & (c("n_models") > 0)
    down = (c("n_bear") == c("n_models")) & (c("n_models") > 0)
    all_agree = up | down
    out = _base(predictions).withColumns(
        {
            "unanimous": all_agree,
            "direction": F.when(up, "bullish").when(down, "bearish").otherwise("neutral"),
            "confidence": F.when(all_agree, F.least(F.lit(100.0), c("conf_all") + UNANIMOUS_BONUS)).otherwise(F.lit(0.0)),
            "expected_return": F.when(all_agree, c("ret_all")).otherwise(F.lit(0.0)),
        }
    )
    return _finish(out, ["unanimous"])


def rolling_weights(accuracy: DataFrame, n: int = 30) -> DataFrame:
    """Mean of the newest ``n`` accuracy observations (model, ts, accuracy) per model."""
    recent = top_n(accuracy, ["model"], [F.desc("ts")], n)
    return recent.groupBy("model").agg(F.avg("accuracy").alias("weight"))


def normalised_weights(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """(ticker, date, model, weight): the shares that dynamic weighting gives the models that answered;
    unknown models weigh 1, all-zero weights are equal."""
    known = predictions.where(F.col("direction").isNotNull()).select("ticker", "date", "model")
    w = Window.partitionBy("ticker", "date")  # as many rows as models
    raw = known.join(F.broadcast(weights), "model", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))  # one row per model
    total = F.sum("w").over(w)
    share = F.when(total == 0, F.try_divide(F.lit(1.0), F.count("*").over(w))).otherwise(F.try_divide(F.col("w"), total))
    return raw.select("ticker", "date", "model", share.alias("weight"))


def dynamic_weighting(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Means weighted by recent accuracy; unknown models weigh 1, all-zero weights are equal.

    The weights have one row per model and are broadcast: a shuffle by model would give each model's rows to one task.
    """
    c = F.col
    ok = c("direction").isNotNull()
    p = predictions.join(F.broadcast(weights), "model", "left").withColumn("w", F.when(ok, F.coalesce("weight", F.lit(1.0))))
    bull, bear = F.lower("direction") == "bullish", F.lower("direction") == "bearish"
    one = F.when(ok, F.lit(1.0))

    def sums(w: Column, tag: str) -> list[Column]:
        return [
            F.sum(w).alias(f"_t{tag}"),
            F.sum(w * c("confidence")).alias(f"_c{tag}"),
            F.sum(w * c("expected_return")).alias(f"_r{tag}"),
            F.sum(F.when(bull, w)).alias(f"_u{tag}"),
            F.sum(F.when(bear, w)).alias(f"_d{tag}"),
        ]

    g = p.groupBy("ticker", "date").agg(F.count_if(ok).alias("n_models"), *sums(c("w"), "w"), *sums(one, "e"))
    flat = c("_tw") == 0

    def pick(k: str) -> Column:
        return F.coalesce(F.when(flat, c(f"_{k}e")).otherwise(c(f"_{k}w")), F.lit(0.0))

    out = g.withColumns({"_up": pick("u"), "_down": pick("d"), "_total": pick("t")})
    out = out.withColumns(
        {
            "direction": F.when(c("_up") > c("_down"), "bullish").when(c("_down") > c("_up"), "bearish").otherwise("neutral"),
            "confidence": ratio(pick("c"), c("_total")),
            "expected_return": ratio(pick("r"), c("_total")),
        }
    )
    return _finish(out, [])


def stacked(predictions: DataFrame, probability: DataFrame) -> DataFrame:
    """Direction from the meta-learner's P(up) per (ticker, date): above 0.55, below 0.45.

    Without a fitted meta-learner use ``averaging``.
    """
    p = F.col("direction_probability")
    base = _base(predictions).join(probability, ["ticker", "date"])
    out = base.withColumns(
        {
            "direction": F.when(p > 0.55, "bullish").when(p < 0.45, "bearish").otherwise("neutral"),
            "confidence": p * 100.0,
            "expected_return": F.col("ret_all"),
            "direction_probability": F.round(p, 4),
        }
    )
    return _finish(out, ["direction_probability"])


STRATEGIES = {"voting": voting, "averaging": averaging, "unanimous": unanimous}


def combine(predictions: DataFrame, strategy: str = "voting", weights: DataFrame | None = None) -> DataFrame:
    if strategy == "dynamic_weighting":
        return dynamic_weighting(predictions, weights) if weights is not None else averaging(predictions)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](predictions)
