"""Backtest of dated predictions and its metrics (ids B28, C8, C9, C16, D5-D19, E27, E28, H27, I16, I17).

The trade list is one projection over the priced predictions: entry at the close of the
signal row, exit ``holding_rows`` rows later by ``lead``. A ticker trades at most once per
date, so per-ticker groups are bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions.core import half_up_mean, pct, ratio, series
from equityspark.operators.features import regime_inputs
from equityspark.sources.readers import numbered, warmup_range

TRADING_DAYS = 252


def entry_filter(confidence: float = 60.0, min_return: float = 2.0, direction: str = "both") -> Column:
    """Predictions worth trading; failed predictions (null direction) never are."""
    ok = F.col("direction").isNotNull() & (F.col("confidence") >= confidence) & (F.abs("expected_return") >= min_return)
    return ok if direction == "both" else ok & (F.lower("direction") == direction)


def priced_entries(bars: DataFrame, holding_rows: int = 5, warmup_rows: int = 50, min_rows: int = 100) -> DataFrame:
    """Possible entries: enough history before, an exit row after."""
    b = numbered(bars.select("ticker", "date", "close")).withColumns(
        {"exit_date": F.lead("date", holding_rows).over(series()), "exit_price": F.lead("close", holding_rows).over(series())}
    )
    usable = (F.col("n_rows") >= min_rows) & (F.col("pos") >= warmup_rows) & (F.col("pos") < F.col("n_rows") - holding_rows - 1)
    return b.where(usable).select("ticker", "date", F.col("close").alias("entry_price"), "exit_date", "exit_price")


def simulate(
    bars: DataFrame, predictions: DataFrame, start: str, end: str, *, holding_rows: int = 5, confidence: float = 60.0,
    min_return: float = 2.0, cost_pct: float = 0.2, direction: str = "both", compat: bool = False, side_aware: bool = False,
) -> DataFrame:
    """Trade list with the published rounding.

    Entries lie in [start, end]; ``compat`` also keeps entries of the 100-day warm-up.
    Returns are long-only unless ``side_aware``.
    """
    entries = priced_entries(warmup_range(bars, start, end), holding_rows)
    if not compat:
        entries = entries.where(F.col("date") >= F.lit(start).cast("date"))
    signals = predictions.where(entry_filter(confidence, min_return, direction))
    t = entries.join(signals, ["ticker", "date"])
    gross = pct(F.col("exit_price"), F.col("entry_price"))
    predicted = F.lower("direction")
    if side_aware:
        gross = F.when(predicted == "bearish", -gross).otherwise(gross)
    actual = F.when(F.col("exit_price") > F.col("entry_price"), "bullish").otherwise("bearish")
    net = gross - cost_pct
    return t.select(
        "ticker",
        F.col("date").alias("entry_date"),
        "exit_date",
        F.lit(holding_rows).alias("holding_days"),
        F.round("entry_price", 2).alias("entry_price"),
        F.round("exit_price", 2).alias("exit_price"),
        F.round(gross, 2).alias("gross_return_pct"),
        F.round(net, 2).alias("net_return_pct"),
        F.round("confidence", 1).alias("ml_confidence"),
        F.round("expected_return", 2).alias("ml_expected_return"),
        predicted.alias("ml_direction"),
        actual.alias("actual_direction"),
        (actual == predicted).alias("prediction_correct"),
        (net > 0).alias("profitable"),
    )


def _r() -> Column:
    return F.col("net_return_pct")


def _share(hit: Column) -> Column:
    """Percentage of hits with one decimal, rounded half up exactly."""
    return half_up_mean(1000 * F.count_if(hit), F.count("*"), 1)


def _cents() -> Column:
    """Returns have two decimals; their sum is exact in whole hundredths."""
    return F.sum(F.round(_r() * 100).cast("long"))


def trade_stats(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, rates, return statistics, profit factor, expectancy and trade Sharpe per key."""
    r, win = _r(), _r() > 0
    gains = F.coalesce(F.sum(F.when(win, r)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(r <= 0, r)), F.lit(0.0)))
    g = trades.groupBy(*(keys or ["ticker"])).agg(
        F.count("*").alias("total_trades"),
        F.count_if(win).alias("winning_trades"),
        F.count_if(r <= 0).alias("losing_trades"),
        F.avg(r).alias("avg_return_per_trade"),
        F.median(r).alias("median_return"),
        F.sum(r).alias("total_return"),
        F.coalesce(F.avg(F.when(win, r)), F.lit(0.0)).alias("avg_winner"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loser"),
        F.max(r).alias("best_trade"),
        F.min(r).alias("worst_trade"),
        (F.avg(F.col("prediction_correct").cast("double")) * 100.0).alias("prediction_accuracy"),
        F.avg("ml_confidence").alias("avg_ml_confidence"),
        F.stddev_samp(r).alias("_sd"),
        gains.alias("_gains"),
        losses.alias("_losses"),
    )
    c = F.col
    return g.withColumns(
        {
            "win_rate": ratio(c("winning_trades"), c("total_trades")) * 100.0,
            "profit_factor": profit_factor(c("_gains"), c("_losses")),
            "expectancy": ratio(c("winning_trades"), c("total_trades")) * c("avg_winner")
            - ratio(c("losing_trades"), c("total_trades")) * F.abs(c("avg_loser")),
            "trade_sharpe": F.when(
                (c("total_trades") >= 2) & (c("_sd") > 0), ratio(c("avg_return_per_trade"), c("_sd")) * math.sqrt(TRADING_DAYS)
            ).otherwise(F.lit(0.0)),
        }
    ).drop("_sd", "_gains", "_losses")


def profit_factor(gains: Column, losses: Column) -> Column:
    """Gains over losses; without losses inf if anything was gained, else 0."""
    return F.when(losses > 0, ratio(gains, losses)).when(gains > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


RETURN_BINS = ["big_loss", "loss", "small_gain", "medium_gain", "big_gain"]


def return_distribution(trades: DataFrame) -> DataFrame:
    """Trades per ticker in five return bins: <-5, [-5,0), [0,2), [2,5), >=5."""
    r = _r()
    tests = [r < -5, (r >= -5) & (r < 0), (r >= 0) & (r < 2), (r >= 2) & (r < 5), r >= 5]
    return trades.groupBy("ticker").agg(*[F.count_if(t).alias(n) for n, t in zip(RETURN_BINS, tests)])


def accuracy_by_confidence(trades: DataFrame) -> DataFrame:
    c = F.col("ml_confidence")
    bucket = F.when(c > 70, "high").when(c > 60, "medium").when(c > 50, "low")
    return (
        trades.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy("ticker", "bucket")
        .agg(
            F.count("*").alias("count"),
            _share(F.col("prediction_correct")).alias("accuracy"),
            _share(_r() > 0).alias("win_rate"),
            half_up_mean(_cents(), F.count("*"), 2).alias("avg_return"),
        )
    )


def streaks(trades: DataFrame) -> DataFrame:
    """Longest runs of winning and losing trades per ticker, in entry order."""
    w = Window.partitionBy("ticker").orderBy("entry_date")
    win = _r() > 0
    marked = trades.withColumn("win", win).withColumn(
        "island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("ticker", "win").orderBy("entry_date"))
    )
    runs = marked.groupBy("ticker", "win", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("ticker").agg(
        F.coalesce(F.max(F.when(F.col("win"), F.col("n"))), F.lit(0)).alias("max_consecutive_wins"),
        F.coalesce(F.max(F.when(~F.col("win"), F.col("n"))), F.lit(0)).alias("max_consecutive_losses"),
    )


def equity_curve(trades: DataFrame, start: str, end: str, tickers: DataFrame | None = None) -> DataFrame:
    """Calendar-day equity per ticker from 100, multiplied on every exit day.

    Exits are first reduced to one factor per (ticker, date); a ticker's curve has one
    row per calendar day. Tickers without trades stay flat when ``tickers`` lists them.
    The product runs over the exit days and the first day only; the days up to the next
    exit are filled in last, so no calendar row is shuffled or sorted.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    sold = F.when(F.col("ticker").isNotNull() & F.col("exit_date").between(first, last), F.col("exit_date"))
    begin = F.struct(first.alias("date"), F.lit(None).cast("double").alias("factor"))
    point = F.struct(sold.alias("date"), (1.0 + _r() / 100.0).alias("factor"))
    if tickers is None:
        steps = trades.select("ticker", F.inline(F.array(begin, point)))  # the trades are read once
    else:
        who = tickers.select("ticker").distinct()
        steps = trades.join(who, "ticker", "left_semi").select("ticker", F.inline(F.array(point)))
        steps = steps.unionByName(who.select("ticker", F.inline(F.array(begin))))
    steps = steps.where(F.col("date").isNotNull())
    factors = steps.groupBy("ticker", "date").agg(F.product("factor").alias("factor"))
    run = series().rowsBetween(Window.unboundedPreceding, 0)
    curve = factors.select(
        "ticker", "date", (F.product(F.coalesce("factor", F.lit(1.0))).over(run) * 100.0).alias("equity"),
        F.lead("date").over(series()).alias("_next"),
    )
    days = F.sequence(F.col("date"), F.coalesce(F.date_sub("_next", 1), last))
    return curve.select("ticker", F.explode(days).alias("date"), "equity")


def equity_metrics(curve: DataFrame) -> DataFrame:
    """Sharpe, Sortino, maximum drawdown and Calmar per ticker from an equity curve."""
    prev = F.lag("equity").over(series())
    peak = F.max("equity").over(series().rowsBetween(Window.unboundedPreceding, 0))
    d = curve.withColumns({"chg": ratio(F.col("equity") - prev, prev), "dd": pct(F.col("equity"), peak)})
    g = d.groupBy("ticker").agg(
        F.count("*").alias("_n"),
        F.avg("chg").alias("_mean"),
        F.stddev_samp("chg").alias("_sd"),
        F.count_if(F.col("chg") < 0).alias("_neg"),
        F.sqrt(F.avg(F.when(F.col("chg") < 0, F.col("chg") * F.col("chg")))).alias("_down"),
        F.min("dd").alias("_dd"),
        F.min_by("equity", "date").alias("_first"),
        F.max_by("equity", "date").alias("_last"),
    )
    c = F.col
    enough = c("_n") >= 2
    inf = F.lit(float("inf"))
    root = math.sqrt(TRADING_DAYS)
    total = ratio(c("_last") - c("_first"), c("_first"))
    annual = F.pow(1.0 + total, ratio(F.lit(float(TRADING_DAYS)), c("_n"))) - 1.0
    return g.select(
        "ticker",
        F.when(enough & (c("_sd") > 0), ratio(c("_mean"), c("_sd")) * root).otherwise(F.lit(0.0)).alias("sharpe_ratio"),
        F.when(~enough, F.lit(0.0))
        .when(c("_neg") == 0, F.when(c("_mean") > 0, inf).otherwise(F.lit(0.0)))
        .when(c("_down") > 0, ratio(c("_mean"), c("_down")) * root)
        .otherwise(F.lit(0.0)).alias("sortino_ratio"),
        F.when(enough, F.coalesce("_dd", F.lit(0.0))).otherwise(F.lit(0.0)).alias("max_drawdown"),
        F.when(~enough, F.lit(0.0))
        .when(c("_dd") == 0, F.when(annual > 0, inf).otherwise(F.lit(0.0)))
        .otherwise(ratio(annual, F.abs(c("_dd") / 100.0))).alias("calmar_ratio"),
    )


def buy_and_hold(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Change in percent from first to last close in the range; 0 with fewer than 2 rows."""
    g = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("ticker").agg(
        F.min_by("close", "date").alias("_a"), F.max_by("close", "date").alias("_b"), F.count("*").alias("_n")
    )
    value = F.when(F.col("_n") >= 2, pct(F.col("_b"), F.col("_a"))).otherwise(F.lit(0.0))
    return g.select("ticker", value.alias("buy_hold_return"))


def calibration_curve(trades: DataFrame, bins: int = 10) -> DataFrame:
    """Mean confidence against hit rate per quantile bin (right-closed, lowest included).

    Confidences have one decimal in 0..100, so a group has at most 1,001 distinct values
    and the exact ``percentile`` stays small. Equal edges are merged; a group whose
    confidences are all equal has no bins.
    """
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = trades.groupBy("ticker").agg(F.array_distinct(F.percentile("ml_confidence", probs)).alias("_e"))
    c = F.col("ml_confidence")
    below = F.size(F.filter("_e", lambda e: e < c))
    binned = (
        trades.join(edges, "ticker").where(F.size("_e") >= 2)
        .withColumn("bin", F.greatest(below - 1, F.lit(0)).cast("long"))
    )
    g = binned.groupBy("ticker", "bin").agg(
        half_up_mean(F.sum(F.round(F.col("ml_confidence") * 10).cast("long")), F.count("*"), 1).alias("avg_confidence"),
        _share(F.col("prediction_correct")).alias("actual_win_rate"),
        F.count("*").alias("count"),
    )
    return g


def by_regime(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trade results in trending and ranging markets at entry."""
    regimes = regime_inputs(bars).select("ticker", F.col("date").alias("entry_date"), "regime")
    return trades.join(regimes, ["ticker", "entry_date"]).groupBy("ticker", "regime").agg(
        F.count("*").alias("count"),
        _share(_r() > 0).alias("win_rate"),
        half_up_mean(_cents(), F.count("*"), 2).alias("avg_return"),
        _share(F.col("prediction_correct")).alias("prediction_accuracy"),
    )


def aggregate_tickers(trades: DataFrame, n_tickers: DataFrame) -> DataFrame:
    """One row over all tickers; ``n_tickers`` is a one-row frame with total_tickers.

    Trades are first reduced to one row per ticker; the mean over all trades is rebuilt
    from sums. Best and worst ticker go by rounded mean return, ties by name.
    """
    per = trades.groupBy("ticker").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("profitable")).alias("wins"),
        _cents().alias("ret"),
        F.count_if(F.col("prediction_correct")).alias("hits"),
        F.sum(F.round(F.col("ml_confidence") * 10).cast("long")).alias("conf"),
        half_up_mean(_cents(), F.count("*"), 2).alias("avg"),
    )
    c = F.col
    total = per.agg(
        F.count("*").alias("successful_tickers"),
        F.sum("n").alias("total_trades"),
        half_up_mean(1000 * F.sum("wins"), F.sum("n"), 1).alias("win_rate"),
        half_up_mean(F.sum("ret"), F.sum("n"), 2).alias("avg_return_per_trade"),
        (F.sum("ret") / 100.0).alias("total_return"),
        half_up_mean(1000 * F.sum("hits"), F.sum("n"), 1).alias("prediction_accuracy"),
        half_up_mean(F.sum("conf"), F.sum("n"), 1).alias("avg_confidence"),
        F.min_by("ticker", F.struct(-c("avg"), c("ticker"))).alias("best_ticker"),
        F.min_by("ticker", F.struct(c("avg"), c("ticker"))).alias("worst_ticker"),
    )
    return n_tickers.join(F.broadcast(total))


def assessment() -> Column:
    """Graded remarks (array) from win_rate, avg_return_per_trade, prediction_accuracy, profit_factor."""
    w, a, p, f = (F.col(x) for x in ("win_rate", "avg_return_per_trade", "prediction_accuracy", "profit_factor"))

    def grade(*steps: tuple[Column, str], last: str) -> Column:
        expr = None
        for cond, text in steps:
            expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
        return expr.otherwise(F.lit(last))

    return F.array_compact(
        F.array(
            grade(
                (w > 60, "✓ Excellent win rate (>60%) - Strong signal quality"), (w > 55, "✓ Good win rate (55-60%) - Signals have edge"),
                (w > 50, "○ Marginal win rate (50-55%) - Slight edge"), last="✗ Poor win rate (<50%) - No edge detected",
            ),
            grade(
                (a > 2, "✓ Strong average returns (>2%) per trade"), (a > 1, "○ Moderate average returns (1-2%) per trade"),
                (a > 0, "○ Weak average returns (0-1%) per trade"), last="✗ Negative average returns - Losing strategy",
            ),
            grade(
                (p > 60, "✓ High ML accuracy (>60%) - Model is predictive"), (p > 55, "○ Moderate ML accuracy (55-60%)"),
                (p > 50, "○ Weak ML accuracy (50-55%) - Barely better than random"), last="✗ Poor ML accuracy (<50%) - Model not predictive",
            ),
            F.when(
                f != float("inf"),
                grade(
                    (f > 2, "✓ Excellent profit factor (>2.0) - Wins >> Losses"), (f > 1.5, "✓ Good profit factor (1.5-2.0)"),
                    (f > 1, "○ Marginal profit factor (1.0-1.5)"), last="✗ Poor profit factor (<1.0) - Losses > Wins",
                ),
            ),
            grade(
                ((w > 55) & (a > 1.5) & (p > 55), "Strategy shows PROMISE - Consider live paper trading"),
                ((w > 50) & (a > 0.5), "Strategy has WEAK EDGE - Needs optimization"),
                last="Strategy NEEDS WORK - Not ready for live trading",
            ),
        )
    )


def verdict(strategy: Column, hold: Column) -> Column:
    beat = F.format_string("✓ Strategy BEAT buy-and-hold by %+.2f%%", strategy - hold)
    lost = F.format_string("✗ Strategy UNDERPERFORMED buy-and-hold by %.2f%%", hold - strategy)
    return F.when(strategy > hold, beat).otherwise(lost)


def report(trades: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """All single-ticker figures in one row per ticker, rounded as published, with verdict,
    remarks and the report text."""
    stats = trade_stats(trades)
    curve = equity_curve(trades, start, end)
    out = stats.join(equity_metrics(curve), "ticker").join(buy_and_hold(bars, start, end), "ticker", "left")
    one = ["win_rate", "prediction_accuracy", "avg_ml_confidence"]
    two = [
        "avg_return_per_trade", "median_return", "total_return", "avg_winner", "avg_loser", "best_trade", "worst_trade",
        "profit_factor", "buy_hold_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio",
    ]
    out = out.withColumns({c: _round_finite(c, 1) for c in one} | {c: _round_finite(c, 2) for c in two})
    out = out.withColumns({"assessment": assessment(), "verdict": verdict(F.col("total_return"), F.col("buy_hold_return"))})
    return out.withColumn("report", report_text(start, end))


def _round_finite(name: str, digits: int) -> Column:
    """``round`` fails on infinities, which profit factor and Sortino may be."""
    x = F.col(name)
    return F.when(F.abs(x) == float("inf"), x).otherwise(F.round(F.when(F.abs(x) != float("inf"), x), digits))


def report_text(start: str, end: str) -> Column:
    fields = [
        ("Total Trades", "%d", "total_trades"), ("Winning Trades", "%d", "winning_trades"), ("Win Rate", "%.1f%%", "win_rate"),
        ("Average Return/Trade", "%+.2f%%", "avg_return_per_trade"), ("Median Return/Trade", "%+.2f%%", "median_return"),
        ("Total Return (all)", "%+.2f%%", "total_return"), ("Average Winner", "%+.2f%%", "avg_winner"),
        ("Average Loser", "%+.2f%%", "avg_loser"), ("Best Trade", "%+.2f%%", "best_trade"), ("Worst Trade", "%+.2f%%", "worst_trade"),
        ("Profit Factor", "%.2f", "profit_factor"), ("Sharpe Ratio", "%.2f", "sharpe_ratio"), ("Sortino Ratio", "%.2f", "sortino_ratio"),
        ("Max Drawdown", "%.2f%%", "max_drawdown"), ("Calmar Ratio", "%.2f", "calmar_ratio"),
        ("Prediction Accuracy", "%.1f%%", "prediction_accuracy"), ("Avg ML Confidence", "%.1f%%", "avg_ml_confidence"),
        ("Buy & Hold Return", "%+.2f%%", "buy_hold_return"),
    ]
    head = F.format_string(f"BACKTEST RESULTS - %s\nPeriod: {start} to {end}", F.col("ticker"))
    lines = [F.format_string(f"{label}: {fmt}", F.col(c)) for label, fmt, c in fields]
    return F.concat_ws("\n", head, *lines, F.col("verdict"), F.array_join("assessment", "\n"))
