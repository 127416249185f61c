"""Exact order statistics over unbounded groups, without gathering a group on one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which
does not survive a feature column with billions of values. Here a mergeable sketch (KLL)
brackets each wanted rank, everything outside the brackets is only counted, and just the
few values inside a bracket are ranked. Brackets that would still hold too many values are
narrowed by a sketch of their own values first; a rank that a bracket misses is looked for
again in a wider one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions.core import attach_row
from equityspark.session import materialize

SKETCH_SIZE = 8192
GRID = 1000
INSIDE_MOST = 4_000_000  # values of a key that one bracket may hold when it is ranked


def rank_error(size: int) -> float:
    """Normalised rank error of a KLL sketch of ``size`` (99 % of the time, one rank)."""
    return 2.296 / size**0.9021


def sketches(df: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(key, value) rows to one row per key: n, min, max and a KLL ``sketch``; nulls and NaN are no values."""
    size = max(8, min(65535, size))
    return known_values(df).groupBy("key").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(size)).alias("sketch"))


def known_values(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select("key", "value")


def sketch_grid(sketch: str) -> Column:
    """Quantiles of a sketch at the middles of ``GRID`` equal shares (the function takes constants only)."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*[F.lit((j + 0.5) / GRID) for j in range(GRID)]))


def _at(sketch: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(max(0.0, min(1.0, p))))


def _brackets(found: DataFrame, probs: list[float], size: int, width: float) -> DataFrame:
    """(key, n, _min, _max, _l0, _h0, ...): where the order statistics around p * (n - 1) must lie."""
    whole = (F.col("n") <= size) | F.lit(width >= 0.5)
    # KLL of doubles: other numeric types are compared as doubles
    cols = []
    for i, p in enumerate(probs):
        low = F.when(whole | F.lit(p <= width), F.col("min").cast("double")).otherwise(_at("sketch", p - width))
        high = F.when(whole | F.lit(p >= 1 - width), F.col("max").cast("double")).otherwise(_at("sketch", p + width))
        cols += [low.alias(f"_l{i}"), high.alias(f"_h{i}")]
    return found.select("key", "n", F.col("min").alias("_min"), F.col("max").alias("_max"), *cols)


def _narrowed(df: DataFrame, brackets: DataFrame, probs: list[float], size: int) -> DataFrame:
    """Brackets inside the given ones, from exact counts below them and sketches of the values in them."""
    v = F.col("value").cast("double")
    aggs = []
    for i in range(len(probs)):
        inside = (v >= F.col(f"_l{i}")) & (v <= F.col(f"_h{i}"))
        aggs += [F.count_if(v < F.col(f"_l{i}")).alias(f"_b{i}"), F.count_if(inside).alias(f"_c{i}"),
                 F.kll_sketch_agg_double(F.when(inside, v), F.lit(size)).alias(f"_s{i}")]
    per_key = df.join(F.broadcast(brackets), "key").groupBy("key").agg(*aggs)
    j = brackets.join(per_key, "key")
    cols = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        first, last = F.floor(pos) - F.col(f"_b{i}"), F.ceil(pos) - F.col(f"_b{i}")
        hit = (first >= 0) & (last < F.col(f"_c{i}")) & (F.col(f"_c{i}") > size)
        grid = sketch_grid(f"_s{i}")
        place = lambda r, c=f"_c{i}": F.try_divide(r.cast("double") * GRID, F.col(c))
        slack = 1 + math.ceil(2 * rank_error(size) * GRID)
        below, above = F.floor(place(first)).cast("int") - slack, F.ceil(place(last + 1)).cast("int") + slack
        low = F.when(hit & (below >= 0), F.get(grid, below)).otherwise(F.col(f"_l{i}"))
        high = F.when(hit & (above < GRID), F.get(grid, above)).otherwise(F.col(f"_h{i}"))
        cols += [low.alias(f"_l{i}"), high.alias(f"_h{i}")]
    return j.select("key", "n", "_min", "_max", *cols)


def _ranked(df: DataFrame, brackets: DataFrame, probs: list[float]) -> DataFrame:
    """key, n, quantiles, below; quantiles are null where a rank lies outside its bracket.

    Rows collapse to (key, class, value-if-inside) with map-side combining, where class is the
    number of brackets that start at or below the value; classes are ordered and inside a
    class the bracket values come before the rest, so running counts are exact ranks.
    """
    v = F.col("value")
    cls, inside = F.lit(0), F.lit(False)
    for i in range(len(probs)):
        cls = cls + (v >= F.col(f"_l{i}")).cast("int")
        inside = inside | ((v >= F.col(f"_l{i}")) & (v <= F.col(f"_h{i}")))
    counted = (
        df.join(F.broadcast(brackets.drop("n", "_min", "_max")), "key")  # one row per key
        .groupBy("key", cls.alias("cls"), F.when(inside, v).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    per_class = counted.groupBy("key", "cls").agg(F.sum("c").alias("_size"))
    before = Window.partitionBy("key").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_class.select(
        "key",
        "cls",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
        F.sum("_size").over(Window.partitionBy("key")).alias("n"),
    )
    run = Window.partitionBy("key", "cls").orderBy(F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_run", F.sum("c").over(run)).join(F.broadcast(offsets), ["key", "cls"])
    end = F.col("_off") + F.col("_run")
    start = end - F.col("c")
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        for name, rank in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            hit = (start <= rank) & (rank < end) & F.col("v").isNotNull()
            picks.append(F.max(F.when(hit, F.struct(F.col("v"), start.alias("s")))).alias(f"_{name}{i}"))
    got = placed.groupBy("key").agg(F.max("n").alias("n"), *picks)
    quantiles, below = [], []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        q = a["v"] + (b["v"] - a["v"]) * (pos - F.floor(pos))
        quantiles.append(F.when(a.isNotNull() & b.isNotNull(), q))
        below.append(F.when(q <= a["v"], a["s"]).otherwise(b["s"]))
    return got.select("key", "n", F.array(*quantiles).alias("quantiles"), F.array(*below).alias("below"))


def exact_quantiles(df: DataFrame, probs: list[float], size: int = SKETCH_SIZE, found: DataFrame | None = None, inside_most: int = INSIDE_MOST) -> DataFrame:
    """(key, value) rows to one row per key: n, quantiles (linear interpolation) and
    ``below``, the number of values strictly less than each quantile.

    ``probs`` ascending. One pass makes the sketches (none if ``found`` has stored ones of the
    same rows: key, n, min, max, sketch), one counts. Brackets are two rank errors wide on
    both sides; keys with at most ``size`` rows are bracketed by their min and max. While a
    bracket may hold more than ``inside_most`` values it is narrowed (one pass more, less
    than a hundredth left); keys with a rank outside its bracket take another pass with a bracket
    eight times as wide. The result (one row per key) is written and read again.
    """
    size = max(8, min(65535, size))
    rows = known_values(df)
    found = materialize(sketches(df, size) if found is None else found.select("key", "n", "min", "max", "sketch"), "sketches")
    width, done, open_, left = 2 * rank_error(size), [], found, rows
    while True:
        brackets = _brackets(open_, probs, size, width)
        most = (open_.agg(F.max("n")).first()[0] or 0) * 2 * width
        while most > inside_most and size >= 64:
            brackets = materialize(_narrowed(left, brackets, probs, size), "brackets")
            most *= 4 / GRID + 6 * rank_error(size)
        got = materialize(_ranked(left, brackets, probs), "quantiles")
        missed = F.exists("quantiles", lambda q: q.isNull())
        done.append(got.where(~missed))
        again = got.where(missed).select("key")
        if width >= 0.5 or not again.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        open_, left, width = open_.join(again, "key", "left_semi"), rows.join(again, "key", "left_semi"), width * 8


def global_rank(df: DataFrame, order: list[str], out: str, buckets: int = 256) -> DataFrame:
    """1-based position in the total order of ``order`` (at least two columns), distributed.

    Rows are cut by sketched quantiles of the first column. A value that is itself a
    cut gets its own bucket, split further by the second column, so a value that a
    third of all rows share is spread over many tasks. A rank is the number of rows in
    lower buckets, plus lower sub-buckets, plus the position inside.
    """
    first, second = F.col(order[0]), F.col(order[1])
    cuts = df.agg(
        F.array_distinct(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 10 * buckets)).alias("_cuts")
    )
    tagged = attach_row(df, cuts)
    is_cut = F.array_contains("_cuts", first)
    tagged = tagged.withColumns(
        {
            "_bucket": F.size(F.filter("_cuts", lambda c: c < first)) * 2 + is_cut.cast("int"),
            "_sub": F.when(is_cut, second),  # in its own type and order; null elsewhere
        }
    ).drop("_cuts")
    sizes = tagged.groupBy("_bucket", "_sub").agg(F.count("*").alias("_size"))
    before_sub = Window.partitionBy("_bucket").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(before_sub), F.lit(0)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = (  # at most 2 * buckets rows
        sizes.groupBy("_bucket").agg(F.sum("_size").alias("_t"))
        .select("_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_top"))
    )
    offsets = subs.join(F.broadcast(tops), "_bucket").select("_bucket", "_sub", (F.col("_in") + F.col("_top")).alias("_off"))
    w = Window.partitionBy("_bucket", "_sub").orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(w))
        .join(
            offsets.withColumnsRenamed({"_bucket": "_b", "_sub": "_s"}),
            (F.col("_bucket") == F.col("_b")) & F.col("_sub").eqNullSafe(F.col("_s")),
        )
        .withColumn(out, F.col("_rn") + F.col("_off"))
        .drop("_bucket", "_sub", "_b", "_s", "_rn", "_off")
    )
