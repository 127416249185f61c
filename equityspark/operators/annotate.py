"""Chart annotations: events and news placed on trading days (ids B29, C6, C7, C11, C12, F8, G6, H10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equityspark.functions.core import top_n
from equityspark.operators.text import first_keyword
from equityspark.plans.snapshot import daily_change

SNAP_DAYS = 7


def visible_events(events: DataFrame, hidden: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Events of shown categories inside the chart range."""
    out = events.where(~F.col("category").isin(hidden)) if hidden else events
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end is not None else out


def snap_to_trading_day(events: DataFrame, trading_days: DataFrame, days: int = SNAP_DAYS) -> DataFrame:
    """Each event on its own date if traded, else the nearest trading day within ``days``
    (earlier one on ties), else dropped. Adds ``chart_date``.

    Solved once per calendar date: for every event date the last trading day before and
    the first one after come from one pass over the calendar (at most one row per date);
    the date mapping is broadcast, so events are never shuffled, however skewed by date.
    """
    traded = trading_days.select("date").distinct().withColumn("_t", F.col("date"))
    wanted = events.select("date").distinct().withColumn("_t", F.lit(None).cast("date"))
    days_all = traded.unionByName(wanted).groupBy("date").agg(F.max("_t").alias("_t"))
    w = Window.orderBy("date")
    prev = F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_t", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    placed = days_all.withColumns({"_p": prev, "_n": nxt})
    back, ahead = F.datediff("date", "_p"), F.datediff("_n", "date")
    near = F.when(F.col("_n").isNull() | (back <= ahead), F.col("_p")).otherwise(F.col("_n"))
    mapping = placed.select("date", near.alias("chart_date")).where(F.abs(F.datediff("date", "chart_date")) <= days)
    return events.join(F.broadcast(mapping), "date")


def news_around(days: DataFrame, news: DataFrame, window_days: int = 3, n: int = 5) -> DataFrame:
    """For each (ticker, date) the ``n`` articles published within +-``window_days``, closest
    first, with the number of all articles in the window.

    An article belongs to at most 2*window_days+1 dates, so it is expanded to those and
    equi-joined; there is no inequality join. (ticker, date) holds the articles of one week.
    """
    at = F.col("published")
    spread = F.sequence(F.date_sub(F.to_date(at), window_days), F.date_add(F.to_date(at), window_days))
    near = news.select("ticker", "article_id", "published", F.explode(spread).alias("date"))  # titles stay behind
    gap = F.abs(F.unix_timestamp("published") - F.unix_timestamp(F.col("date").cast("timestamp")))
    near = near.withColumn("gap_seconds", gap).where(F.col("gap_seconds") <= window_days * 86400)
    keys = days.select("ticker", "date").distinct()
    inside = near.join(keys, ["ticker", "date"], "left_semi")
    week = Window.partitionBy("ticker", "date")
    rank = F.row_number().over(week.orderBy("gap_seconds", "article_id"))
    top = inside.withColumns({"rank": rank, "n_articles": F.count("*").over(week)}).where(F.col("rank") <= n)
    return top.join(news.select("ticker", "article_id", "title"), ["ticker", "article_id"])


def news_on_trading_days(news: DataFrame, bars: DataFrame) -> DataFrame:
    """Articles joined to the bar of their publication day, with that day's change."""
    b = bars.withColumn("change_pct", daily_change(F.col("close"))).select("ticker", "date", "close", "change_pct")
    return news.withColumn("date", F.to_date("published")).join(b, ["ticker", "date"])


def important_news(news: DataFrame, bars: DataFrame, keywords: list[str] | None = None, move: float = 3.0) -> DataFrame:
    """News events: a keyword in the title or a large move that day; reason says which."""
    j = news_on_trading_days(news, bars)
    j = j.withColumn("keyword", first_keyword(F.col("title"), keywords) if keywords else first_keyword(F.col("title")))
    big = F.abs("change_pct") > move
    reason = F.coalesce(F.col("keyword"), F.format_string("%.1f%% price move", F.abs("change_pct")))
    return j.where(F.col("keyword").isNotNull() | big).withColumns({"significant_move": big, "reason": reason})


def one_per_date(events: DataFrame) -> DataFrame:
    """First event per (ticker, date) by article id; ``min_by`` combines before the shuffle."""
    rest = [c for c in events.columns if c not in ("ticker", "date")]
    out = events.groupBy("ticker", "date").agg(F.min_by(F.struct(*rest), "article_id").alias("_r"))
    return out.select("ticker", "date", *[F.col(f"_r.{c}").alias(c) for c in rest])


def volatile_days(news: DataFrame, bars: DataFrame, exclude: DataFrame, n: int = 5, move: float = 2.0) -> DataFrame:
    """For tickers without any important event: first article on the ``n`` most volatile
    days, where the day moved more than ``move`` percent."""
    b = bars.withColumn("change_pct", daily_change(F.col("close"))).select("ticker", "date", "change_pct")
    quiet = b.join(exclude.select("ticker").distinct(), "ticker", "left_anti")
    top = top_n(quiet, ["ticker"], [F.desc(F.abs("change_pct")), F.asc("date")], n).where(F.abs("change_pct") > move)
    day_news = news.withColumn("date", F.to_date("published"))
    return one_per_date(day_news.join(top, ["ticker", "date"]).select("ticker", "date", "article_id", "title", "change_pct"))


def earnings_on_chart(earnings: DataFrame, bars: DataFrame) -> DataFrame:
    """Reporting dates that are trading days of the ticker."""
    return earnings.join(bars.select("ticker", "date"), ["ticker", "date"], "left_semi")


def chart_events(earnings: DataFrame, important: DataFrame, bars: DataFrame) -> DataFrame:
    """Earnings and important news on one timeline, at most one important event per date."""
    e = earnings_on_chart(earnings, bars).select(
        "ticker", "date", F.lit("earnings").alias("type"),
        F.when(F.col("upcoming"), "Upcoming earnings").otherwise("Historical earnings").alias("description"),
    ).distinct()
    i = one_per_date(important).select("ticker", "date", F.lit("important").alias("type"), F.col("reason").alias("description"))
    return e.unionByName(i)
