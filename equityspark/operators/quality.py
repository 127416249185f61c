"""Bar validity, outliers and completeness (ids B21, B25, D3, D4, E24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.functions.core import series, attach_row, ratio, sanitize  # noqa: F401 - sanitize is B21

Z_LIMIT = 5.0


def is_valid_bar() -> Column:
    positive = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0) & (F.col("volume") > 0)
    return F.coalesce((F.col("high") >= F.col("low")) & positive, F.lit(False))


def valid_bars(bars: DataFrame) -> DataFrame:
    return bars.where(is_valid_bar())


def _with_change(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(series())
    return bars.withColumn("price_change", ratio(F.col("close") - prev, prev))


def change_stats(bars: DataFrame) -> DataFrame:
    """One row: mean, deviation and number of the per-ticker changes of all tickers."""
    return _with_change(bars).agg(
        F.avg("price_change").alias("_mean"), F.stddev_samp("price_change").alias("_std"), F.count("*").alias("_rows")
    )


def with_z_score(bars: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Adds ``z_score`` of the per-ticker change against all changes of all tickers.

    Mean and deviation are one aggregated row (``stats`` if they are known from a narrower
    frame of the same rows), broadcast; an unpartitioned window would have pulled every bar to one task.
    """
    usable = (F.col("_rows") > 10) & (F.col("_std") > 0)
    z = F.when(usable, ratio(F.col("price_change") - F.col("_mean"), F.col("_std")))
    out = attach_row(_with_change(bars), change_stats(bars) if stats is None else stats)
    return out.withColumn("z_score", z).drop("_mean", "_std", "_rows")


def drop_outliers(bars: DataFrame, limit: float = Z_LIMIT, stats: DataFrame | None = None) -> DataFrame:
    """Rows with |z| above the limit are dropped, rows without a z-score are kept."""
    keep = F.coalesce(F.abs("z_score") <= limit, F.lit(True))
    return with_z_score(bars, stats).where(keep).drop("price_change", "z_score")


def quality_counters(bars: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """One row: total_rows, invalid_ohlcv, outliers_detected, rows_excluded."""
    total = bars.agg(
        F.count("*").alias("total_rows"), F.sum((~is_valid_bar()).cast("long")).alias("invalid_ohlcv")
    )
    outliers = with_z_score(valid_bars(bars)).agg(
        F.sum(F.coalesce((F.abs("z_score") > limit).cast("long"), F.lit(0).cast("long"))).alias("outliers_detected")
    )
    return attach_row(total, outliers).select(
        "total_rows",
        "invalid_ohlcv",
        "outliers_detected",
        (F.col("invalid_ohlcv") + F.col("outliers_detected")).alias("rows_excluded"),
    )


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: nulls and share of filled values in percent, in one scan."""
    columns = columns or df.columns
    counts = df.agg(
        F.count("*").alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]
    )
    long = counts.unpivot(["_n"], columns, "column_name", "null_count")
    return long.select(
        "column_name",
        "null_count",
        (100.0 * (1.0 - ratio(F.col("null_count"), F.col("_n")))).alias("complete_pct"),
    )
