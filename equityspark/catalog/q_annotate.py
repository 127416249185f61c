"""Chart annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.q_text import important
from equityspark.catalog.registry import query
from equityspark.catalog.util import keep
from equityspark.operators import annotate, features
from equityspark.sources import views

HIDDEN = ["5-LOW", "3-MEDIUM"]
_HID = "category NOT IN ('5-LOW', '3-MEDIUM')"


@query("b29_visible_events", f"SELECT global_id, date, category FROM global_events WHERE {_HID} AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def b29(spark, d):
    e = annotate.visible_events(views.global_events(spark, d), HIDDEN, "1996-01-01", "2000-12-31")
    return e.select("global_id", "date", "category")


@query("c06_snap_events", f"""SELECT global_id, date, chart_date FROM (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY abs(chart_date - date), chart_date) AS k
    FROM (SELECT e.global_id, e.date, b.date AS chart_date FROM global_events e JOIN bench b ON b.date BETWEEN e.date - 7 AND e.date + 7 WHERE {_HID})) WHERE k = 1""")
def c06(spark, d):
    e = annotate.visible_events(views.global_events(spark, d), HIDDEN)
    return annotate.snap_to_trading_day(e, views.bench(spark, d)).select("global_id", "date", "chart_date")


@query("c07_news_around", """SELECT ticker, date, article_id, CAST(k AS INTEGER) AS rank, n_articles FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY gap, article_id) AS k, count(*) OVER (PARTITION BY ticker, date) AS n_articles
    FROM (SELECT b.ticker, b.date, n.article_id, abs(epoch(n.published) - epoch(CAST(b.date AS TIMESTAMP))) AS gap FROM bars b JOIN news n
      ON n.ticker = b.ticker AND abs(epoch(n.published) - epoch(CAST(b.date AS TIMESTAMP))) <= 3 * 86400)) WHERE k <= 5""")
def c07(spark, d):
    return annotate.news_around(views.bars(spark, d), views.news(spark, d)).select("ticker", "date", "article_id", "rank", "n_articles")


@query("c11_news_on_day", "SELECT n.article_id, n.ticker, b.date, round(b.change_pct, 6) AS change_pct FROM news n JOIN day_change b ON b.ticker = n.ticker AND b.date = CAST(n.published AS DATE)")
def c11(spark, d):
    return keep(annotate.news_on_trading_days(views.news(spark, d), views.bars(spark, d)), "article_id", "ticker", "date", "change_pct")


@query("c12_earnings_on_chart", "SELECT e.ticker, e.date, round(e.reported, 6) AS reported, e.upcoming FROM earnings e WHERE EXISTS (SELECT 1 FROM bars b WHERE b.ticker = e.ticker AND b.date = e.date)")
def c12(spark, d):
    return keep(annotate.earnings_on_chart(views.earnings(spark, d), views.bars(spark, d)), "ticker", "date", "reported", "upcoming")


oracle.define("important_one", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY article_id) AS k FROM important) WHERE k = 1")


@query("g06_chart_events", """SELECT DISTINCT e.ticker, e.date, 'earnings' AS type, CASE WHEN e.upcoming THEN 'Upcoming earnings' ELSE 'Historical earnings' END AS description
    FROM earnings e WHERE EXISTS (SELECT 1 FROM bars b WHERE b.ticker = e.ticker AND b.date = e.date)
    UNION ALL SELECT ticker, date, 'important', reason FROM important_one""")
def g06(spark, d):
    return annotate.chart_events(views.earnings(spark, d), important(spark, d), views.bars(spark, d))


@query("f08_volatile_days", """SELECT ticker, date, article_id, round(change_pct, 6) AS change_pct FROM (
    SELECT v.ticker, v.date, n.article_id, v.change_pct, row_number() OVER (PARTITION BY v.ticker, v.date ORDER BY n.article_id) AS k
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(change_pct) DESC, date) AS vk FROM day_change
        WHERE ticker NOT IN (SELECT ticker FROM important WHERE keyword = 'fine')) WHERE vk <= 5 AND abs(change_pct) > 2) v
    JOIN news n ON n.ticker = v.ticker AND CAST(n.published AS DATE) = v.date) WHERE k = 1""")
def f08(spark, d):
    out = annotate.volatile_days(views.news(spark, d), views.bars(spark, d), important(spark, d).where("keyword = 'fine'"))
    return keep(out, "ticker", "date", "article_id", "change_pct")


@query("c05_asof_peer", """SELECT b.ticker, b.date, round(p.close, 6) AS peer_close FROM bars b ASOF LEFT JOIN (SELECT date, close FROM bench) p ON b.date >= p.date""")
def c05(spark, d):
    peer = views.bench(spark, d).select("date", "close")
    return keep(features.asof_align(views.bars(spark, d), peer, "close", "peer_close"), "ticker", "date", "peer_close")


@query("c05_asof_peers", """SELECT b.ticker, b.date, q.peer, p.close AS close FROM bars b CROSS JOIN (SELECT unnest(['S0000', 'S0002', 'S0004']) AS peer) q
    ASOF LEFT JOIN bars p ON p.ticker = q.peer AND b.date >= p.date WHERE q.peer IN (SELECT ticker FROM bars)""")
def c05_peers(spark, d):
    b = views.bars(spark, d)
    peers = b.where(F.col("ticker").isin("S0000", "S0002", "S0004")).select(F.col("ticker").alias("peer"), "date", "close")
    return keep(features.asof_align_peers(b, peers, "close"), "ticker", "date", "peer", "close")


@query("e23_peer_percent", """SELECT b.ticker, b.date, round((p.close - f.fc) / f.fc * 100, 6) AS peer_percent FROM bars b ASOF LEFT JOIN (SELECT date, close FROM bench) p ON b.date >= p.date
    LEFT JOIN (SELECT ticker, arg_min(pc, date) AS fc FROM (SELECT b.ticker, b.date, p.close AS pc FROM bars b ASOF JOIN (SELECT date, close FROM bench) p ON b.date >= p.date) GROUP BY 1) f ON f.ticker = b.ticker""")
def e23_peer(spark, d):
    from equityspark.functions import indicators as ind

    peer = views.bench(spark, d).select("date", "close")
    out = features.asof_align(views.bars(spark, d), peer, "close", "peer_close")
    return keep(out.withColumn("peer_percent", ind.percent_since_start(F.col("peer_close"))), "ticker", "date", "peer_percent")
