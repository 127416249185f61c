"""End-to-end training frame and the preparation job (ids I19, I20, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.functions.core import series
from equityspark.operators import features, labels, quality
from equityspark.sources import readers, sinks


def assemble(
    bars: DataFrame, info: DataFrame, sentiment: DataFrame | None = None, *, start: str | None = None, end: str | None = None,
    benchmark: str = "SPY", z_limit: float = quality.Z_LIMIT,
) -> DataFrame:
    """Bars to the full training frame for all tickers.

    Indicators and labels are computed on the bars' own window, which equals joining the
    stored indicator and label tables on (ticker, date) but needs no join: everything runs on
    one exchange by ticker and nothing is written. Rows without a 20-row label are dropped,
    then invalid and outlying rows; lag, volatility, strength, calendar and band features look
    at the remaining rows. What the outlier filter and the relative strength must know
    beforehand (one row of statistics, the benchmark's returns) comes from bars alone.
    """
    price = ["ticker", "date", "open", "high", "low", "close", "volume"]
    stats = quality.change_stats(_kept_bars(bars.select(*price), start, end))
    own = quality.drop_outliers(_kept_bars(bars.select(*price).where(F.col("ticker") == benchmark), start, end), z_limit, stats)
    out = ind.indicator_table(labels.add_forward_labels(bars, drop_tail=False))
    out = out.where(F.col(f"forward_{max(labels.FORWARD_PERIODS)}d_return").isNotNull())
    out = out.join(info, "ticker", "left")
    if sentiment is not None:
        out = out.join(sentiment, ["ticker", "date"], "left")
    out = readers.date_range(out, start, end)
    out = quality.drop_outliers(quality.valid_bars(out), z_limit, stats)
    out = features.add_lags(out)
    out = features.add_volatility(out)
    out = features.add_relative_strength(out, benchmark, bench=features.benchmark_returns(own, benchmark))
    out = features.add_calendar(out)
    return features.add_bands(out)


def _kept_bars(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Valid bars that have the longest forward label, inside the range: the rows the outlier filter sees."""
    ahead = F.lead("close", max(labels.FORWARD_PERIODS)).over(series())
    out = bars.withColumn("_ahead", ahead).where(F.col("_ahead").isNotNull()).drop("_ahead")
    return quality.valid_bars(readers.date_range(out, start, end))


def summary(bars: DataFrame) -> DataFrame:
    """Store summary: tickers, rows, first and last date."""
    return bars.agg(
        F.count_distinct("ticker").alias("n_tickers"),
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def tickers_per_sector(bars: DataFrame, info: DataFrame) -> DataFrame:
    have = bars.select("ticker").distinct()
    return have.join(info.select("ticker", "sector"), "ticker", "left").groupBy("sector").agg(F.count("*").alias("n_tickers"))


EXPORT_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume", *ind.INDICATOR_COLUMNS,
                  *[f"forward_{n}d_return" for n in (1, 5, 10, 20)], *[f"direction_{n}d" for n in (1, 5, 10, 20)],
                  "max_drawdown_5d", "sector", "industry"]


def export_frame(bars: DataFrame, info: DataFrame) -> DataFrame:
    """Rows with a 5-row forward return, one column per name."""
    out = ind.indicator_table(labels.add_forward_labels(bars, drop_tail=False))
    out = out.join(info.select("ticker", "sector", "industry"), "ticker", "left")
    return out.where(F.col("forward_5d_return").isNotNull()).select(*EXPORT_COLUMNS)


def prepare(bars: DataFrame, info: DataFrame, out_dir: str, benchmark: str = "SPY") -> dict[str, DataFrame]:
    """Preparation job: gate short histories, write indicators and training rows, report.

    The training frame is written once and the reports read the written table, so the
    window pipeline runs a single time.
    """
    spark = bars.sparkSession
    gated = readers.min_history(bars, 200)
    assemble(gated, info, benchmark=benchmark).write.mode("overwrite").parquet(f"{out_dir}/training")
    written = spark.read.parquet(f"{out_dir}/training")
    sinks.export_csv(export_frame(gated, info), f"{out_dir}/export_csv")
    return {
        "summary": summary(bars),
        "sectors": tickers_per_sector(bars, info),
        "completeness": quality.completeness(written),
        "quality": quality.quality_counters(gated),
    }
