"""Technical indicators as window expressions over one (ticker, date) series.

All of them share ``Window.partitionBy("ticker").orderBy("date")``; Spark plans one
exchange on ``ticker`` for any number of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import full, pct, ratio, series, series_keys, trailing

EMA_BLOCK = 512
SUM_ROWS = 20  # rows of the sums that longer sums are put together from


def trailing_sum(x: Column, n: int) -> Column:
    """Sum of the last ``n`` rows as a double, null unless all of them hold a value.

    A sliding frame is added up anew for every row, so a long one costs its length per row. Here
    only frames of at most ``SUM_ROWS`` rows slide; a longer sum adds what they gave some rows ago.
    """
    x = x.cast("double")

    def short(rows: int) -> Column:
        return full(rows, x, F.sum(x).over(trailing(rows)))

    if n <= SUM_ROWS:
        return short(n)
    out = short(SUM_ROWS)
    for back in range(SUM_ROWS, n, SUM_ROWS):
        out = out + F.lag(short(min(SUM_ROWS, n - back)), back).over(series())
    return out


def sma(x: Column, n: int) -> Column:
    return trailing_sum(x, n) / n


def rsi(x: Column, n: int = 14) -> Column:
    """Simple-mean RSI; the first difference counts as 0, so row ``n`` is the first value."""
    change = _change(x)
    return _rsi_value(_mean_gain(change, n), _mean_gain(-change, n), F.count(F.lit(1)).over(trailing(n)) == n)


def _change(x: Column) -> Column:
    return F.coalesce(x - F.lag(x).over(series()), F.lit(0.0))


def _mean_gain(change: Column, n: int) -> Column:
    return F.avg(F.greatest(change, F.lit(0.0))).over(trailing(n))


def _rsi_value(gain: Column, loss: Column, enough: Column) -> Column:
    value = F.when(loss > 0, 100.0 - 100.0 / (1.0 + ratio(gain, loss))).when(gain > 0, F.lit(100.0))
    return F.when(enough, value)


def bollinger(x: Column, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """(upper, middle, lower) with the sample standard deviation."""
    mid = sma(x, n)
    sd = full(n, x, F.stddev_samp(x).over(trailing(n)))
    return mid + k * sd, mid, mid - k * sd


def obv(close: Column, volume: Column) -> Column:
    step = F.coalesce(F.signum(close - F.lag(close).over(series())) * volume, F.lit(0.0))
    return F.sum(step).over(series().rowsBetween(Window.unboundedPreceding, 0))


def lag_return(close: Column, n: int) -> Column:
    """Fractional return against the row ``n`` back, never across tickers."""
    prev = F.lag(close, n).over(series())
    return ratio(close - prev, prev)


def atr(high: Column, low: Column, close: Column, n: int = 14) -> Column:
    prev = F.lag(close).over(series())
    true_range = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    return full(n, high - low, F.avg(true_range).over(trailing(n)))


def log_return(close: Column) -> Column:
    return F.ln(ratio(close, F.lag(close).over(series())))


def rolling_median(x: Column, n: int) -> Column:
    """Median of the non-null values among the last ``n`` rows (at least one).

    A sorted bounded array beats the ``percentile`` aggregate here, which would
    rebuild a hash map of boxed values for every row of the frame.
    """
    arr = F.sort_array(F.collect_list(x).over(trailing(n)))
    size = F.size(arr)
    lo = F.get(arr, F.floor((size - 1) / 2).cast("int"))
    hi = F.get(arr, F.floor(size / 2).cast("int"))
    return (lo + hi) / 2.0


def percent_b(close: Column, upper: Column, lower: Column) -> Column:
    return ratio(close - lower, upper - lower)


def band_width(upper: Column, middle: Column, lower: Column) -> Column:
    return ratio(upper - lower, middle)


def days_to_earnings(cycle: int = 63) -> Column:
    """Quarterly proxy counted from the first row of each ticker."""
    return (F.lit(cycle) - F.pmod(F.row_number().over(series()) - 1, F.lit(cycle))).cast("long")


def _blocked(df: DataFrame, block: int) -> DataFrame:
    """Position in the series, block number and place inside the block."""
    pos = F.col("_pos")
    return df.withColumn("_pos", F.row_number().over(series()) - 1).withColumns(
        {"_blk": F.floor(pos / block).cast("int"), "_k": (pos % block).cast("int")}
    )


def _block_for(span: int, block: int) -> int:
    """At least ``block`` rows and so many that at most 128 earlier blocks matter.

    A block of a sixth of the span keeps q^-block below e, so it cannot overflow.
    """
    return max(block, -(-(span + 1) // 6))


def _ema(x: Column, span: int, block: int) -> Column:
    """EMA of ``x`` over rows prepared by ``_blocked``."""
    if span < 2:
        raise ValueError("span must be at least 2")
    w_block = Window.partitionBy(*series_keys(), "_blk").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    w_range = Window.partitionBy(*series_keys()).orderBy("_blk")
    alpha = 2.0 / (span + 1.0)
    q = 1.0 - alpha
    weighted = F.when(F.col("_pos") == 0, x).otherwise(alpha * x)
    local = F.sum(weighted * F.pow(F.lit(q), -F.col("_k"))).over(w_block) * F.pow(F.lit(q), F.col("_k"))
    tail = weighted * F.pow(F.lit(q), F.lit(block - 1) - F.col("_k"))
    reach = max(1, math.ceil(math.log(1e-17) / (block * math.log(q))))
    carry = F.lit(0.0)
    for j in range(1, reach + 1):
        part = F.sum(tail).over(w_range.rangeBetween(-j, -j))
        carry = carry + F.coalesce(part, F.lit(0.0)) * (q ** (block * (j - 1)))
    return local + carry * F.pow(F.lit(q), F.col("_k") + 1)


def ema_memory(*spans: int) -> int:
    """Rows after which an EMA of an EMA ... of these spans has forgotten a value (below 1e-17 of it)."""
    return sum(math.ceil(math.log(1e-17) / math.log(1.0 - 2.0 / (span + 1.0))) for span in spans)


def add_ema(df: DataFrame, col: str, spans: dict[str, int], block: int = EMA_BLOCK) -> DataFrame:
    """Exponential means (``adjust=False``) for several spans, without Python workers.

    The recurrence e[t] = q*e[t-1] + a*x[t] is unrolled in blocks of ``block`` rows.
    Inside a block a running sum of a*x*q^-k gives the block-local part; what earlier
    blocks leave behind is a few RANGE frames on the block number. Terms that have
    decayed below 1e-17 are not representable in the result and are not generated.
    q^-block stays far from overflow for every span >= 2, however long the series is; very
    long spans get a larger block of their own.
    """
    for size in sorted({_block_for(span, block) for span in spans.values()}):
        own = {name: span for name, span in spans.items() if _block_for(span, block) == size}
        df = _blocked(df, size).withColumns({name: _ema(F.col(col), span, size) for name, span in own.items()}).drop("_pos", "_blk", "_k")
    return df


def add_macd(df: DataFrame, col: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, block: int = EMA_BLOCK) -> DataFrame:
    """Adds ema_<fast>, ema_<slow>, macd, macd_signal and macd_hist.

    Both EMA stages use one block layout, hence one sort.
    """
    fast_name, slow_name = f"ema_{fast}", f"ema_{slow}"
    x = F.col(col)
    if len({_block_for(span, block) for span in (fast, slow, signal)}) > 1:
        out = add_ema(df, col, {fast_name: fast, slow_name: slow}, block).withColumn("macd", F.col(fast_name) - F.col(slow_name))
        out = add_ema(out, "macd", {"macd_signal": signal}, block)
        return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    block = _block_for(slow, block)
    out = _blocked(df, block).withColumns({fast_name: _ema(x, fast, block), slow_name: _ema(x, slow, block)})
    out = out.withColumn("macd", F.col(fast_name) - F.col(slow_name))
    out = out.withColumn("macd_signal", _ema(F.col("macd"), signal, block))
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_pos", "_blk", "_k")


def indicator_table(bars: DataFrame) -> DataFrame:
    """The thirteen stored indicators for all tickers in one pass over one exchange.

    Spark works a window expression out once per use, so what several indicators share gets a column of its own.
    """
    close, volume = F.col("close"), F.col("volume")
    given = bars.columns
    out = bars.withColumn("_change", _change(close)).withColumns(
        {
            "_gain": _mean_gain(F.col("_change"), 14),
            "_loss": _mean_gain(-F.col("_change"), 14),
            "_rows": F.count(F.lit(1)).over(trailing(14)),
            "_sum_10": trailing_sum(close, 10),
            "_sum_20": trailing_sum(close, 20),
            "_sd_20": full(20, close, F.stddev_samp(close).over(trailing(20))),
            "volume_sma_20": sma(volume, 20),
        }
    )
    back = lambda name, rows: F.lag(name, rows).over(series())
    out = out.withColumns(
        {
            "sma_50": (F.col("_sum_20") + back("_sum_20", 20) + back("_sum_10", 40)) / 50,
            "sma_200": reduce(Column.__add__, [F.col("_sum_20"), *[back("_sum_20", i) for i in range(20, 200, 20)]]) / 200,
        }
    )
    mid, sd = F.col("_sum_20") / 20, F.col("_sd_20")
    out = out.withColumns(
        {
            "rsi_14": _rsi_value(F.col("_gain"), F.col("_loss"), F.col("_rows") == 14),
            "sma_20": mid, "bb_upper": mid + 2.0 * sd, "bb_middle": mid, "bb_lower": mid - 2.0 * sd,
        }
    )
    first = ["rsi_14", "sma_20", "sma_50", "sma_200", "bb_upper", "bb_middle", "bb_lower", "volume_sma_20"]
    return add_macd(out.select(*[c for c in given if c not in first], *first))


def latest_indicators(bars: DataFrame, cols: list[str], lows: int = 20) -> DataFrame:
    """(ticker, ``cols``, indicators, support, resistance) of the newest row of each ticker.

    Equals the newest row of ``indicator_table``, but only the means of the MACD line are worked out for every
    row. All else is one aggregate in which a row counts by its distance from the newest one, so no frame slides: the
    signal is a weighted sum, and rows it has forgotten (below 1e-17) take no part.
    """
    fast, slow, signal = 12, 26, 9
    block, ends = _block_for(slow, EMA_BLOCK), ("ema_12", "ema_26", "macd")
    rows = _blocked(bars.withColumn("_change", _change(F.col("close"))), block)
    rows = rows.withColumns({f"ema_{n}": _ema(F.col("close"), n, block) for n in (fast, slow)}).withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*series_keys()))).withColumn("_d", F.col("_n") - 1 - F.col("_pos"))
    rows = rows.where(F.col("_d") < max(200, ema_memory(signal)))
    close, d = F.col("close").cast("double"), F.col("_d")

    def last(n: int, x: Column) -> Column:
        return F.when(d < n, x)

    def whole(n: int, x: Column, value: Column) -> Column:
        return F.when(F.count(last(n, x)) == n, value)

    def mean(n: int, x: Column) -> Column:
        return whole(n, x, F.avg(last(n, x)))

    alpha = 2.0 / (signal + 1.0)
    weight = F.when(F.col("_pos") == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), d)
    volume = F.col("volume").cast("double")
    newest = (d == 0) & F.col("date").isNotNull()
    g = rows.groupBy(*series_keys()).agg(
        *[F.max(F.when(newest, F.col(c))).alias(c) for c in [*cols, *ends]], F.max(F.when(newest, True)).alias("_dated"),
        F.avg(last(14, F.greatest(F.col("_change"), F.lit(0.0)))).alias("_gain"), F.avg(last(14, F.greatest(-F.col("_change"), F.lit(0.0)))).alias("_loss"),
        F.max("_n").alias("_rows"), *[mean(n, close).alias(f"sma_{n}") for n in (20, 50, 200)],
        whole(20, close, F.stddev_samp(last(20, close))).alias("_sd"), mean(20, volume).alias("volume_sma_20"),
        F.sum(F.col("macd") * weight).alias("_signal"),
        F.min(last(lows, F.col("close"))).alias("support"), F.max(last(lows, F.col("close"))).alias("resistance"),
    )
    mid, macd = F.col("sma_20"), F.col("macd")
    known = F.when(macd.isNotNull(), F.col("_signal"))  # a block of rows without a price has neither
    g = g.withColumns(
        {
            "rsi_14": _rsi_value(F.col("_gain"), F.col("_loss"), F.col("_rows") >= 14),
            "macd_signal": known, "macd_hist": macd - known,
            "bb_upper": mid + 2.0 * F.col("_sd"), "bb_middle": mid, "bb_lower": mid - 2.0 * F.col("_sd"),
        }
    )
    # without any dated row there is no newest one
    return g.select(*series_keys(), *[F.when(F.col("_dated"), F.col(c)).alias(c) for c in [*cols, *INDICATOR_COLUMNS, "support", "resistance"]])


INDICATOR_COLUMNS = [
    "rsi_14", "macd", "macd_signal", "macd_hist", "sma_20", "sma_50", "sma_200",
    "ema_12", "ema_26", "bb_upper", "bb_middle", "bb_lower", "volume_sma_20",
]


def percent_since_start(close: Column) -> Column:
    """Change in percent against the first valid close of the series."""
    first = F.first(close, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return pct(close, first)
