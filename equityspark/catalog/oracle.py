"""DuckDB side: the test-table views as CTEs, composed on demand."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    CTES[name] = body


def sql(body: str) -> str:
    """Prefix ``body`` with the CTEs it mentions, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, cte in CTES.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(cte)
                order.append(name)

    visit(body)
    if not order:
        return body
    with_part = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {with_part} {body}"


def over(base: str, *roots: str) -> None:
    """Define ``<name>_<base>`` for each of ``roots`` and what it needs, with ``base`` in place of ``bars``."""
    need: set[str] = set()

    def visit(name: str) -> None:
        if name not in need and name != "bars":
            need.add(name)
            for other in CTES:
                if re.search(rf"\b{other}\b", CTES[name]):
                    visit(other)

    for root in roots:
        visit(root)
    own = {n for n in need if _reaches(n, "bars")}
    for name in own:
        body = re.sub(r"\bbars\b", base, CTES[name])
        define(f"{name}_{base}", re.sub(rf"\b({'|'.join(sorted(own))})\b", rf"\1_{base}", body))


def _reaches(name: str, target: str, seen: frozenset = frozenset()) -> bool:
    return name == target or any(
        n not in seen and n != name and re.search(rf"\b{n}\b", CTES[name]) and _reaches(n, target, seen | {name}) for n in CTES)


define("bars", """
  SELECT printf('S%04d', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
    first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open,
    max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close,
    sum(l_quantity) AS volume
  FROM (SELECT *, 100.0 + l_extendedprice / l_quantity / 10000.0 AS price FROM lineitem)
  GROUP BY 1, 2""")
define("bench", "SELECT * FROM bars WHERE ticker = 'S0000'")
define("instrument", """
  SELECT printf('S%04d', s_suppkey) AS ticker, s_name AS name, r_name AS sector, n_name AS industry,
    s_acctbal AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("universe", """
  SELECT 'all' AS universe, sector, ticker FROM instrument
  UNION ALL SELECT 'large_cap', sector, ticker FROM instrument WHERE market_cap > 5000""")
define("fundamentals", """
  SELECT printf('S%04d', k) AS ticker,
    CASE WHEN k % 11 <> 0 THEN (k * 37 % 60) + 5.0::DOUBLE END AS pe_ratio,
    CASE WHEN k % 13 <> 0 THEN (k * 29 % 300)::DOUBLE / 100 END AS peg_ratio,
    (k * 17 % 80)::DOUBLE / 10 AS price_to_book,
    (k * 13 % 60)::DOUBLE / 1000 AS dividend_yield,
    ((k * 7 % 40) - 5.0::DOUBLE) / 100 AS profit_margin,
    ((k * 11 % 45) - 5.0::DOUBLE) / 100 AS roe,
    CASE WHEN k % 17 = 0 THEN NULL WHEN k % 2 = 0 THEN (k * 19 % 250)::DOUBLE / 100
      ELSE (k * 19 % 250)::DOUBLE END AS debt_to_equity,
    ((k * 23 % 60) - 15.0::DOUBLE) / 100 AS revenue_growth,
    ((k * 31 % 70) - 20.0::DOUBLE) / 100 AS earnings_growth,
    (k * 41 % 300)::DOUBLE / 100 AS current_ratio
  FROM (SELECT s_suppkey AS k FROM supplier)""")
define("n_instrument", "SELECT count(*) AS n_inst FROM supplier")
define("news", """
  SELECT doc_id AS article_id, printf('S%04d', doc_id % n_inst) AS ticker, text AS title, source AS publisher,
    TIMESTAMP '1995-01-02' + to_days(CAST(doc_id * 7919 % 2500 AS INTEGER)) AS published
  FROM documents, n_instrument""")
define("posts", """
  SELECT CASE event_type WHEN 'view' THEN 'twitter' WHEN 'error' THEN 'twitter' WHEN 'click' THEN 'reddit'
      WHEN 'signup' THEN 'tiktok' WHEN 'purchase' THEN 'instagram' END AS platform,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) <> 13 THEN event_id END AS id,
    printf('S%04d', user_id) AS ticker,
    '$' || printf('S%04d', user_id) || ' ' || event_type AS text,
    CAST(floor(value) AS BIGINT) - copy AS likes, CAST(json_extract_string(props, '$.k') AS BIGINT) AS comments,
    CAST(0 AS BIGINT) AS shares, ts, copy
  FROM events, (VALUES (0), (1)) c(copy)""")
define("pred_base", """
  SELECT b.ticker, b.date, b.close, i.rsi_14 AS rsi, i.sma_20 AS s20, i.sma_50 AS s50, l.lag_5 * 100 AS r5
  FROM bars b JOIN ind_rsi i USING (ticker, date) JOIN ind_lag l USING (ticker, date)
  WHERE i.sma_50 IS NOT NULL AND i.rsi_14 IS NOT NULL""")
define("predictions", """
  SELECT ticker, date, 'rsi' AS model,
    CASE WHEN 50 - rsi > 2 THEN 'bullish' WHEN 50 - rsi < -2 THEN 'bearish' ELSE 'neutral' END AS direction,
    least(100.0, 50 + abs(50 - rsi)) AS confidence, (50 - rsi) / 5 AS expected_return FROM pred_base
  UNION ALL SELECT ticker, date, 'trend',
    CASE WHEN s20 > s50 THEN 'bullish' WHEN s20 < s50 THEN 'bearish' ELSE 'neutral' END,
    least(100.0, 50 + abs((s20 - s50) / s50 * 100) * 25), (s20 - s50) / s50 * 100 * 4 FROM pred_base
  UNION ALL SELECT ticker, date, 'momentum',
    CASE WHEN r5 > 0.25 THEN 'bullish' WHEN r5 < -0.25 THEN 'bearish' ELSE 'neutral' END,
    least(100.0, 50 + abs(r5) * 10), r5 FROM pred_base""")
define("recommendations", """
  SELECT event_id, printf('S%04d', user_id) AS ticker, event_type AS source,
    CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'hold' ELSE 'sell' END AS recommendation, ts
  FROM events""")
define("agent_events", """
  SELECT event_id, ts, event_type, 'A' || CAST(event_id % 5 AS VARCHAR) AS source_agent,
    printf('S%04d', user_id) AS ticker, value, props AS data FROM events""")
define("analyses", """
  SELECT vec_id AS doc_id, 'L' || CAST(label AS VARCHAR) AS ticker,
    TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id AS INTEGER)) AS ts,
    CAST(TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id AS INTEGER)) AS DATE) AS date,
    'analysis ' || CAST(vec_id AS VARCHAR) AS summary, embedding FROM embeddings""")
define("messages", "SELECT conv_id, turn, role, text AS content FROM conversations")
define("global_events", """
  SELECT o_orderkey AS global_id, CAST(o_orderdate AS DATE) AS date, 'event ' || CAST(o_orderkey AS VARCHAR) AS title,
    o_orderpriority AS category, o_orderstatus AS impact FROM orders""")
define("earnings", """
  SELECT printf('S%04d', o_custkey % n_inst) AS ticker, CAST(o_orderdate AS DATE) AS date, o_totalprice AS reported,
    o_orderstatus = 'O' AS upcoming FROM orders, n_instrument""")
define("sent_feat", """
  SELECT ticker, date, ts, event_id,
    CASE WHEN event_id * 7 % 101 = 0 THEN 50.0 ELSE (event_id * 7 % 101)::DOUBLE END AS news_sentiment_score,
    floor(value) AS news_sentiment_confidence,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS news_sentiment_article_count,
    CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE -1.0 END::DOUBLE AS news_sentiment_trend,
    (CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END)::DOUBLE AS news_macro_sentiment,
    (CASE (event_id + 1) % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END)::DOUBLE AS news_company_expected_revenue_sentiment,
    (CASE (event_id + 2) % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END)::DOUBLE AS news_company_specific_sentiment,
    (CASE (event_id + 3) % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END)::DOUBLE AS news_industry_peer_sentiment
  FROM (SELECT *, printf('S%04d', user_id) AS ticker, CAST(ts AS DATE) AS date FROM events)""")

# Indicators -------------------------------------------------------------------
define("ind_rsi", """
  SELECT *, CASE WHEN n14 = 14 THEN CASE WHEN ls > 0 THEN 100 - 100 / (1 + gn / ls) WHEN gn > 0 THEN 100.0 END END AS rsi_14
  FROM (SELECT ticker, date, close, high, low, open, volume,
      count(*) OVER r14 AS n14, avg(greatest(d, 0)) OVER r14 AS gn, avg(greatest(-d, 0)) OVER r14 AS ls,
      CASE WHEN count(*) OVER r20 = 20 THEN avg(close) OVER r20 END AS sma_20,
      CASE WHEN count(*) OVER r50 = 50 THEN avg(close) OVER r50 END AS sma_50,
      CASE WHEN count(*) OVER r200 = 200 THEN avg(close) OVER r200 END AS sma_200,
      CASE WHEN count(*) OVER r20 = 20 THEN stddev_samp(close) OVER r20 END AS sd_20,
      CASE WHEN count(*) OVER r20 = 20 THEN avg(volume) OVER r20 END AS volume_sma_20
    FROM (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) AS d FROM bars)
    WINDOW r14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING),
      r20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING),
      r50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING),
      r200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING))""")
define("ind_lag", """
  SELECT ticker, date, close, (close - lag(close, 1) OVER w) / lag(close, 1) OVER w AS lag_1,
    (close - lag(close, 5) OVER w) / lag(close, 5) OVER w AS lag_5,
    (close - lag(close, 10) OVER w) / lag(close, 10) OVER w AS lag_10,
    (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS lag_20
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
define("numbered", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars")
define("ema_rec", """
  SELECT ticker, date, rn, close, close AS ema_12, close AS ema_26, 0.0::DOUBLE AS macd_signal
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.date, n.rn, n.close,
    e.ema_12 + (2.0::DOUBLE / 13) * (n.close - e.ema_12), e.ema_26 + (2.0::DOUBLE / 27) * (n.close - e.ema_26),
    e.macd_signal + (2.0::DOUBLE / 10) * (
      (e.ema_12 + (2.0::DOUBLE / 13) * (n.close - e.ema_12)) - (e.ema_26 + (2.0::DOUBLE / 27) * (n.close - e.ema_26)) - e.macd_signal)
  FROM ema_rec e JOIN numbered n ON n.ticker = e.ticker AND n.rn = e.rn + 1""")
define("indicators", """
  SELECT i.*, e.ema_12, e.ema_26, e.ema_12 - e.ema_26 AS macd, e.macd_signal,
    e.ema_12 - e.ema_26 - e.macd_signal AS macd_hist,
    sma_20 + 2 * sd_20 AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd_20 AS bb_lower
  FROM ind_rsi i JOIN ema_rec e USING (ticker, date)""")
