"""Time-bucketed as-of join on timestamps (ids C5, C6).

A window per key would sort all rows of a key in one task. Here both sides are cut into
time buckets: the last row of every (key, bucket) of the right side is carried forward over
bucket heads (one small row per bucket), and inside a bucket the two sides are merged by
time. The left side takes part with its distinct instants only, so a bucket's window is
bounded by the clock and not by the number of rows at an instant; the answers are joined
back to the left rows by instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("backward", "forward", "nearest")


def _carried(keys: list[str], forward: bool) -> Column:
    """Nearest known row on one side: in the bucket itself, else the head of the nearest other bucket."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_t") if forward else F.asc("_t"))
    here = F.last("_right", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.coalesce(here, F.col("_next" if forward else "_prev"))


def join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], *,
    direction: str = "backward", tolerance_seconds: float | None = None, bucket_seconds: int = 86_400,
) -> DataFrame:
    """Left rows with ``values`` and ``right_time`` of the right row of their keys that is nearest in the direction.

    backward: the last right row at or before the left time; forward: the first at or after;
    nearest: the closer of both, the earlier one on ties. Without such a row, or with one
    farther than the tolerance, the added columns are null; so for left rows with a null key
    or time. Of right rows at one instant the greatest ``values`` count. Every left row is
    kept once; its columns must differ from the added ones.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; known: {', '.join(DIRECTIONS)}")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = bucket_seconds * 1_000_000
    body = F.struct(F.col(right_time).alias("time"), *[F.col(v) for v in values])
    r = right.where(F.col(right_time).isNotNull()).select(*keys, micros(right_time).alias("_t"), body.alias("_right"))
    r = r.groupBy(*keys, "_t").agg(F.max("_right").alias("_right"))
    instants = left.where(F.col(left_time).isNotNull()).select(*keys, micros(left_time).alias("_t")).distinct()
    both = r.select(*keys, "_t", "_right", F.lit(False).alias("_ask")).unionByName(
        instants.select(*keys, "_t", F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.lit(True).alias("_ask")))
    both = both.withColumn("_bucket", F.floor(F.col("_t") / width))
    known = F.when(F.col("_right").isNotNull(), F.col("_right"))
    heads = both.groupBy(*keys, "_bucket").agg(
        F.max_by(known, F.when(~F.col("_ask"), F.col("_t"))).alias("_tail"), F.min_by(known, F.when(~F.col("_ask"), F.col("_t"))).alias("_head"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    heads = heads.select(
        *keys, "_bucket",
        F.last("_tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.first("_head", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    merged = both.join(heads, [*keys, "_bucket"])
    sides = {}
    if direction != "forward":
        sides["_back"] = _carried(keys, False)
    if direction != "backward":
        sides["_ahead"] = _carried(keys, True)
    answers = merged.withColumns(sides).where("_ask")
    if direction == "nearest":
        back, ahead = F.col("_t") - micros_of("_back"), micros_of("_ahead") - F.col("_t")
        hit = F.when(F.col("_ahead").isNull() | (back <= ahead), F.col("_back")).otherwise(F.col("_ahead"))
    else:
        hit = F.col("_back" if direction == "backward" else "_ahead")
    answers = answers.select(*keys, "_t", hit.alias("_hit"))
    if tolerance_seconds is not None:
        answers = answers.where(F.abs(micros_of("_hit") - F.col("_t")) <= int(tolerance_seconds * 1_000_000))
    out = left.withColumn("_t", micros(left_time)).join(answers, [*keys, "_t"], "left")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], F.col("_hit.time").alias(right_time), *[F.col(f"_hit.`{v}`").alias(v) for v in values])


def micros_of(c: str) -> Column:
    return F.unix_micros(F.col(f"{c}.time").cast("timestamp"))
