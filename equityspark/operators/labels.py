"""Forward labels and label transforms (ids E20, E22, E30, H22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions.core import series, pct
from equityspark.functions.quantiles import exact_quantiles, global_rank

FORWARD_PERIODS = (1, 5, 10, 20)


def max_forward_drawdown(close: Column, rows: int = 5) -> Column:
    """Deepest fall in percent from the running peak over the next ``rows`` rows; <= 0."""
    peak, worst = close, F.lit(0.0)
    for i in range(1, rows + 1):
        nxt = F.lead(close, i).over(series())
        peak = F.greatest(peak, nxt)
        worst = F.least(worst, pct(nxt, peak))
    return F.when(F.lead(close, rows).over(series()).isNotNull(), worst)


def add_forward_labels(df: DataFrame, periods: tuple[int, ...] = FORWARD_PERIODS, drop_tail: bool = True) -> DataFrame:
    """Adds forward_<n>d_return (percent), direction_<n>d and max_drawdown_5d; the tail
    without a label for the longest period is dropped unless told otherwise."""
    close = F.col("close")
    cols = {"max_drawdown_5d": max_forward_drawdown(close)}
    for n in periods:
        ret = pct(F.lead(close, n).over(series()), close)
        cols[f"forward_{n}d_return"] = ret
        cols[f"direction_{n}d"] = F.when(ret.isNotNull(), (ret > 0).cast("int"))
    out = df.withColumns({**cols, "_h": F.lead(close, max(periods)).over(series())})
    return (out.where(F.col("_h").isNotNull()) if drop_tail else out).drop("_h")


def forward_labels(bars: DataFrame, periods: tuple[int, ...] = FORWARD_PERIODS) -> DataFrame:
    """The label table (ticker, date, labels)."""
    names = [f"forward_{n}d_return" for n in periods] + [f"direction_{n}d" for n in periods] + ["max_drawdown_5d"]
    return add_forward_labels(bars.select("ticker", "date", "close"), periods).select("ticker", "date", *names)


def threshold_labels(df: DataFrame, value: str, threshold: float, out: str = "label") -> DataFrame:
    """1/0 by sign; rows inside the band are dropped."""
    return df.where(F.abs(F.col(value)) >= threshold).withColumn(out, (F.col(value) > 0).cast("int"))


def tertile_labels(df: DataFrame, value: str, order: list[str], out: str = "tertile") -> DataFrame:
    """0/1/2 by the exact one-third and two-third quantiles of the whole column.

    When edges collapse (heavy ties) rows are split by rank instead, ties by ``order``.
    Rows whose value is null or NaN keep a null label either way.
    The quantiles come from a distributed selection, the rank from two-level counting;
    only the four edges (one row) reach the driver, to choose between the two.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    q = exact_quantiles(df.select(F.lit("v").alias("key"), F.col(value).alias("value")), [0.0, 1 / 3, 2 / 3, 1.0]).first()
    if q is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    edges = q["quantiles"]
    x = F.col(value)
    if len(set(edges)) == 4:
        return df.withColumn(out, F.when(known, (x > edges[1]).cast("int") + (x > edges[2]).cast("int")))
    ranked = global_rank(df.where(known), [value, *order], "_rank")
    third = q["n"] / 3
    labelled = ranked.withColumn(
        out, (F.col("_rank") > third).cast("int") + (F.col("_rank") > 2 * third).cast("int")
    ).drop("_rank")
    return labelled.unionByName(df.where(F.coalesce(~known, F.lit(True))).withColumn(out, F.lit(None).cast("int")))
