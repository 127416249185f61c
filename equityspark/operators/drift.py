"""Feature drift against a stored baseline (ids D20-D25, A16, F9).

Features travel in long form (key, value): one aggregation serves any number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equityspark.functions.core import top_n
from equityspark.functions.quantiles import exact_quantiles, known_values, sketch_grid

BUCKETS = 10
EPSILON = 1e-6
RETRAIN_AT = 0.2


def to_long(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns to (key, value) rows; missing values (null or NaN) are dropped."""
    cols = [F.col(f).cast("double").alias(f) for f in features]
    return df.select(*cols).unpivot([], features, "key", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def profile(long: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Baseline per feature: n, mean, population std, min, max and the percentile edges."""
    stats = long.groupBy("key").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    q = exact_quantiles(long, [i / buckets for i in range(buckets + 1)])
    return stats.join(q.withColumnRenamed("quantiles", "percentiles"), "key")


def sample_values(long: DataFrame, n: int = 1000) -> DataFrame:
    """Deterministic sample of ``n`` values per feature (hash order instead of file order)."""
    hashed = long.withColumn("_h", F.xxhash64("key", F.col("value")))
    return top_n(hashed, ["key"], [F.asc("_h"), F.asc("value")], n).drop("_h", "rn")


def _edges(prof: DataFrame) -> DataFrame:
    """(key, inner, expected) from a profile: interior edges of the bins, whose outer ends
    are open, and how many baseline values each bin holds.

    The counts come from the ranks that the quantile selection already knows, so the
    baseline is not read again.
    """
    pairs = F.array_distinct(F.arrays_zip(F.col("percentiles").alias("e"), F.col("below").alias("b")))
    inner = F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 2, F.lit(0)))
    out = prof.select("key", "n", pairs.alias("_p")).select("key", "n", inner.alias("_i"), F.size("_p").alias("n_edges"))
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_i", lambda x: x["b"]), F.array(F.col("n")))
    counts = F.transform(F.sequence(F.lit(0), F.size("_i")), lambda i: F.get("_c", i + 1) - F.get("_c", i))
    return out.withColumn("_c", cuts).select("key", "n_edges", F.transform("_i", lambda x: x["e"]).alias("inner"), counts.alias("expected"))


def _psi(edges: DataFrame, actual: DataFrame) -> DataFrame:
    """One pass over ``actual``: rows per (key, bin), then everything is one short row per key."""
    v = F.col("value")
    bins = F.size(F.filter("inner", lambda e: e <= v))
    joined = actual.join(F.broadcast(edges.select("key", "inner")), "key")  # one row per feature
    counts = joined.groupBy("key", bins.alias("bin")).agg(F.count("*").alias("c"))
    per_key = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_m"), F.sum("c").alias("ta"))
    j = edges.join(per_key, "key").withColumn("te", F.aggregate("expected", F.lit(0).cast("long"), lambda a, x: a + x))

    def share(n: Column, total: str) -> Column:
        x = n / F.col(total)
        return F.when(x > 0, x).otherwise(F.lit(EPSILON))

    def term(i: Column) -> Column:
        pe, pa = share(F.get("expected", i), "te"), share(F.element_at("_m", i), "ta")
        return (pa - pe) * F.ln(pa / pe)

    total = F.aggregate(F.sequence(F.lit(0), F.size("expected") - 1), F.lit(0.0), lambda a, i: a + term(i))
    value = F.when(F.col("n_edges") < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), total))
    return j.select("key", value.alias("psi"))


def psi(expected: DataFrame, actual: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, psi) of ``actual`` against ``expected``, both long.

    Edges are the distinct percentiles of the expected values with open ends; bins are
    half-open, an empty bin counts as 1e-6. Features known on one side only are skipped,
    a feature with a single distinct edge has psi 0.
    """
    q = exact_quantiles(expected, [i / buckets for i in range(buckets + 1)])
    return _psi(_edges(q.withColumnRenamed("quantiles", "percentiles")), actual)


def classify(x: Column) -> Column:
    return F.when(x < 0.1, "stable").when(x < 0.2, "minor_shift").otherwise("major_shift")


def check(expected: DataFrame, actual: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Drift per feature with its class."""
    return psi(expected, actual, buckets).withColumn("classification", classify(F.col("psi")))


def should_retrain(drift: DataFrame, threshold: float = RETRAIN_AT) -> DataFrame:
    return drift.agg(F.coalesce(F.bool_or(F.col("psi") >= threshold), F.lit(False)).alias("should_retrain"))


def summary(drift: DataFrame) -> DataFrame:
    c = F.col("classification")
    return drift.agg(
        F.count("*").alias("total_features"),
        F.count_if(c == "stable").alias("stable"),
        F.count_if(c == "minor_shift").alias("minor_shift"),
        F.count_if(c == "major_shift").alias("major_shift"),
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
    )


def top_drifted(drift: DataFrame, n: int = 10) -> DataFrame:
    return drift.orderBy(F.desc("psi"), "key").limit(n)


def store_baseline(long: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the profile; it carries the count of every bin, so later checks compare with
    the whole baseline without reading it again."""
    profile(long, buckets).write.mode("overwrite").parquet(path)


def check_stored(actual: DataFrame, path: str) -> DataFrame | None:
    """Drift against the stored baseline; without one, ``actual`` becomes the baseline and
    there is nothing to report yet."""
    from pyspark.errors import AnalysisException

    try:
        stored = actual.sparkSession.read.parquet(path)
    except AnalysisException:
        store_baseline(actual, path)
        return None
    return _psi(_edges(stored), actual).withColumn("classification", classify(F.col("psi")))


# Stored mergeable profiles ---------------------------------------------------------------
DAY_SKETCH = 4096


def day_profiles(long: DataFrame, size: int = DAY_SKETCH) -> DataFrame:
    """(day, key, value) rows to one mergeable row per (day, key): n, mean, var, min, max and a KLL sketch."""
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("day", "key").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def append_days(long: DataFrame, path: str, size: int = DAY_SKETCH) -> None:
    """Store the profiles of new days; a day that is there already is replaced, the others are not read."""
    day_profiles(long, size).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged_profile(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Profile of any range of stored days without their values: n, mean, std, min, max exact, ``percentiles``
    and ``below`` from the merged sketch (rank error below ``rank_error`` of its size), and the ``sketch``.
    """
    days = spark.read.parquet(path)
    if start is not None:
        days = days.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.where(F.col("day") <= F.lit(end).cast("date"))
    whole = days.groupBy("key").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("mean")).alias("_s"))
    around = days.join(whole.withColumn("_mean", F.col("_s") / F.col("_n")), "key")
    off = F.col("mean") - F.col("_mean")
    g = around.groupBy("key").agg(
        F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("n") * (F.col("var") + off * off)).alias("_m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))
    g = g.withColumn("std", F.sqrt(F.col("_m2") / F.col("n"))).drop("_m2")
    edges = [F.col("min"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(i / buckets)) for i in range(1, buckets)], F.col("max")]
    g = g.withColumn("_grid", sketch_grid("sketch")).withColumn("percentiles", F.array(*edges))
    less = F.transform("percentiles", lambda e: F.round(F.size(F.filter("_grid", lambda x: x < e)).cast("double") / F.size("_grid") * F.col("n")).cast("long"))
    return g.withColumn("below", less).drop("_grid")


def check_merged(actual: DataFrame, path: str, start: str | None = None, end: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Drift of ``actual`` against a range of stored days: the baseline's values are never read.

    Shares of the baseline's bins are those of its sketch, so psi is exact up to the sketch's rank error.
    """
    stored = merged_profile(actual.sparkSession, path, start, end, buckets)
    return _psi(_edges(stored), actual).withColumn("classification", classify(F.col("psi")))


def exact_profile(long: DataFrame, path: str, start: str | None = None, end: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``profile`` of the values of the stored days in one pass: their merged sketches give the brackets.

    ``long`` must hold just the values that were stored for the range.
    """
    stored = merged_profile(long.sparkSession, path, start, end, buckets)
    q = exact_quantiles(known_values(long), [i / buckets for i in range(buckets + 1)], DAY_SKETCH, stored)
    return stored.select("key", "mean", "std", "min", "max").join(q.withColumnRenamed("quantiles", "percentiles"), "key")
