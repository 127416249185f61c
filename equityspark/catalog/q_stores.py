"""Writes read back, record projections and text recovery, each against SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog.q_backtest import ENS_COLS, accuracy, drift_features, trades
from equityspark.catalog.registry import ORACLE, query
from equityspark.catalog.util import keep, rounded
from equityspark.operators import drift, ensemble, memory, text
from equityspark.session import scratch_folder
from equityspark.sources import readers, sinks, views
from equityspark.sources.versions import VersionedTable

OHLCV = ["open", "high", "low", "close", "volume"]


@query("a03_vendor_bars", "SELECT ticker, date, open, high, low, close, volume FROM bars")
def a03(spark, d):
    """Bars written the way a vendor sends them (short names, epoch milliseconds) and normalised again."""
    ms = F.unix_millis(F.col("date").cast("timestamp"))
    short = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "ticker": "T"}
    vendor = views.bars(spark, d).withColumn("t", ms).drop("date").withColumnsRenamed(short)
    return readers.normalize_vendor_bars(vendor).select("ticker", "date", *OHLCV)


@query("a05_replace_tickers", "SELECT ticker, date, CASE WHEN ticker LIKE '%3' THEN close * 2 ELSE close END AS close FROM bars WHERE NOT (ticker LIKE '%3' AND extract(year FROM date) = 1995)")
def a05(spark, d):
    """A stored price table in which some tickers are replaced by a new, shorter series."""
    path, staging = scratch_folder(spark, "prices"), scratch_folder(spark, "staging")
    bars = views.bars(spark, d).select("ticker", "date", "close")
    sinks.write_by_ticker(bars, path, 16)
    new = bars.where(F.col("ticker").like("%3") & (F.year("date") != 1995)).withColumn("close", F.col("close") * 2)
    sinks.replace_tickers(spark, new, path, staging, 16)
    return spark.read.parquet(path).select("ticker", "date", "close")


_RATIOS = ["pe_ratio", "peg_ratio", "price_to_book", "dividend_yield", "profit_margin", "roe", "debt_to_equity", "revenue_growth", "earnings_growth", "current_ratio"]


@query("a07_flatten_financials", f"SELECT ticker, {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)}, CAST(NULL AS DOUBLE) AS market_cap, CAST(NULL AS VARCHAR) AS recommendation FROM fundamentals")
def a07(spark, d):
    """Ratios as the nested JSON record of a vendor, flattened to typed columns."""
    f = views.fundamentals(spark, d)
    groups = [F.struct(*[F.col(c) for c in names if c in f.columns]).alias(g) for g, names in readers.FINANCIAL_GROUPS.items() if set(names) & set(f.columns)]
    body = f.select(F.to_json(F.struct(F.lower("ticker").alias("ticker"), *groups)).alias("body"))
    return keep(readers.flatten_financials(body, "body"), "ticker", *_RATIOS, "market_cap", "recommendation")


@query("a08_project_news", """SELECT ticker, coalesce(title, '') AS title, coalesce(publisher, '') AS publisher, 'http://n/' || article_id AS link, published, '' AS type, CASE WHEN article_id % 3 = 0 THEN 'http://t/' || article_id END AS thumbnail
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY article_id) AS k FROM news) WHERE k <= 10""")
def a08(spark, d):
    """Articles as vendor JSON, projected to the first ten per ticker."""
    n = views.news(spark, d)
    link = F.concat(F.lit("http://n/"), F.col("article_id"))
    image = F.when(F.col("article_id") % 3 == 0, F.struct(F.array(F.struct(F.concat(F.lit("http://t/"), F.col("article_id")).alias("url"))).alias("resolutions")))
    body = F.to_json(F.struct("title", "publisher", link.alias("link"), F.unix_timestamp("published").alias("providerPublishTime"), image.alias("thumbnail")))
    return readers.project_news(n.select("ticker", F.col("article_id").alias("seq"), body.alias("body")), "body")


_TRADE = ["ticker", "entry_date", "exit_date", "entry_price", "net_return_pct", "ml_direction", "profitable"]


@query("a11_trades_csv", f"SELECT {', '.join(_TRADE)} FROM trades")
def a11(spark, d):
    path = scratch_folder(spark, "trades")
    t = trades(spark, d).select(*_TRADE)
    sinks.export_csv(t, path)
    return spark.read.schema(t.schema).option("header", True).csv(path)


@query("a11_results_json", "SELECT ticker, count(*) AS total_trades, count(*) FILTER (net_return_pct > 0) AS winning_trades, round(min(net_return_pct), 6) AS worst_trade FROM trades GROUP BY ticker")
def a11_json(spark, d):
    from equityspark.operators import backtest

    path = scratch_folder(spark, "results")
    s = backtest.trade_stats(trades(spark, d)).select("ticker", "total_trades", "winning_trades", "worst_trade")
    sinks.export_json(s, path)
    return rounded(spark.read.schema(s.schema).json(path))


_KEPT = "doc_id % 7 <> 0 AND date <> DATE '2024-01-05'"


@query("a12_add_delete", f"SELECT doc_id, ticker, ts, date, summary FROM analyses WHERE {_KEPT}")
def a12_change(spark, d):
    """Reports appended in two parts, then deleted by id, among them all of one day."""
    path, staging = scratch_folder(spark, "reports"), scratch_folder(spark, "staging")
    a = views.analyses(spark, d).drop("embedding")
    sinks.append_analyses(a.where("doc_id % 2 = 0"), path)
    sinks.append_analyses(a.where("doc_id % 2 = 1"), path)
    sinks.delete_by_id(spark, path, staging, a.where(f"NOT ({_KEPT})"))
    return spark.read.schema(a.schema).parquet(path).select("doc_id", "ticker", "ts", "date", "summary")


@query("a13_load_universe", "SELECT DISTINCT sector, ticker FROM universe WHERE universe = 'all'")
def a13(spark, d):
    """A universe saved as JSON and loaded from its folder; the file's stem is the universe."""
    path = scratch_folder(spark, "universe")
    sinks.save_universe(views.universe(spark, d).where("universe = 'all'"), path, "all")
    return readers.load_universes(spark, path).select("sector", "ticker")


@query("a15_company_records", """SELECT ticker AS symbol, CASE WHEN market_cap > 0 THEN name ELSE ticker END AS name, sector, 'N/A' AS industry, CAST(market_cap AS DOUBLE) AS market_cap,
  CAST(CASE WHEN market_cap > 0 THEN NULL ELSE market_cap END AS DOUBLE) AS current_price, 'USD' AS currency, 'N/A' AS exchange, industry AS description FROM instrument""")
def a15(spark, d):
    """Vendor company records with missing fields, and one group of rows without a symbol."""
    i = views.instrument(spark, d)
    rich = F.col("market_cap") > 0
    raw = i.select(
        F.col("ticker").alias("symbol"), F.when(rich, F.col("name")).alias("longName"), F.col("ticker").alias("shortName"), "sector",
        F.col("market_cap").alias("marketCap"), F.when(~rich, F.col("market_cap")).alias("regularMarketPrice"), F.col("industry").alias("longBusinessSummary"))
    return readers.project_company(raw.unionByName(raw.withColumn("symbol", F.lit(None).cast("string"))))


@query("a16_stored_baseline", ORACLE["d20_baseline_profile"])
def a16(spark, d):
    path = scratch_folder(spark, "baseline")
    drift.store_baseline(drift_features(spark, d)[0], path)
    p = spark.read.parquet(path)
    return rounded(p.select("key", "n", "mean", "std", "min", "max", *[F.col("percentiles")[i].alias(f"p{i * 10}") for i in range(11)]))


@query("a17_restore_backup", "SELECT doc_id, ticker, ts, date, summary FROM analyses")
def a17(spark, d):
    """A store with a third of the reports, restored from a JSON backup of all of them."""
    path, backup = scratch_folder(spark, "reports"), scratch_folder(spark, "backup")
    a = views.analyses(spark, d).drop("embedding")
    sinks.append_analyses(a.where("doc_id % 3 = 0"), path)
    sinks.export_json(a, backup)
    sinks.restore_analyses(spark, backup, path, a.schema)
    return spark.read.schema(a.schema).parquet(path).select("doc_id", "ticker", "ts", "date", "summary")


@query("a18_saved_universe", "SELECT 'mine' AS name, sector, count(DISTINCT ticker) AS tickers, (SELECT count(DISTINCT ticker) FROM universe WHERE universe = 'large_cap') AS listed FROM universe WHERE universe = 'large_cap' GROUP BY sector")
def a18(spark, d):
    path = scratch_folder(spark, "universe")
    sinks.save_universe(views.universe(spark, d).where("universe = 'large_cap'"), path, "mine", updated="2024-01-31")
    u = spark.read.schema("name string, tickers array<string>, sectors map<string, array<string>>").json(path)
    return u.select("name", F.size("tickers").cast("long").alias("listed"), F.explode("sectors").alias("sector", "t")).select("name", "sector", F.size("t").cast("long").alias("tickers"), "listed")


@query("h24_recover_json", """SELECT article_id, CASE WHEN article_id % 5 = 4 THEN NULL ELSE article_id END AS id, CASE WHEN article_id % 5 = 4 THEN NULL ELSE ticker END AS ticker FROM news""")
def h24(spark, d):
    """Records inside model text: bare, fenced, fenced with a language, between words, and broken."""
    n = views.news(spark, d)
    j = F.to_json(F.struct(F.col("article_id").alias("id"), "ticker"))
    kind = F.col("article_id") % 5
    raw = (
        F.when(kind == 0, j).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```\nDone.")))
        .when(kind == 2, F.concat(F.lit("```\n"), j, F.lit("\n```"))).when(kind == 3, F.concat(F.lit("Result "), j, F.lit(" as asked")))
        .otherwise(F.concat(F.lit("no record {"), F.col("ticker"))))
    got = n.select("article_id", text.recover_json(raw, "id long, ticker string").alias("r"))
    return got.select("article_id", "r.id", "r.ticker")


@query("h30_sections", """SELECT ticker, CASE WHEN k % 4 = 3 THEN '' ELSE 'First ' || name || ' second ' || sector END AS risks, CASE WHEN k % 4 = 3 THEN 'only ' || name ELSE '' END AS outlook
  FROM (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS k FROM instrument)""")
def h30(spark, d):
    """Report texts with the wanted heading in bold, hash or plain form, or without it."""
    i = views.instrument(spark, d).withColumn("k", F.substr("ticker", F.lit(2)).cast("int") % 4)
    body = F.concat(F.lit("First "), F.col("name"), F.lit("\n\nsecond "), F.col("sector"))
    report = (
        F.when(F.col("k") == 0, F.concat(F.lit("Intro\n**Risk Factors**:\n\n"), body, F.lit("\n**Next**\nx")))
        .when(F.col("k") == 1, F.concat(F.lit("## Risk Factors\n"), body, F.lit("\n# Next\nx")))
        .when(F.col("k") == 2, F.concat(F.lit("Risk Factors:\n\n"), body, F.lit("\n\nNext part")))
        .otherwise(F.concat(F.lit("Outlook\nonly "), F.col("name"))))
    r = i.select("ticker", report.alias("r"))
    return r.select("ticker", text.extract_section(F.col("r"), "Risk Factors").alias("risks"), text.extract_section(F.col("r"), "Outlook").alias("outlook"))


@query("a14_session_lines", """SELECT conv_id, 0 AS part, CAST(NULL AS BIGINT) AS turn, '{"conv_id":' || conv_id || ',"messages":' || count(*) || ',"first_turn":' || min(turn) || ',"last_turn":' || max(turn) || '}' AS body FROM messages GROUP BY conv_id
  UNION ALL SELECT conv_id, 1, NULL, '{"key":"last_role","value":' || to_json(arg_max(role, turn)) || '}' FROM messages GROUP BY conv_id
  UNION ALL SELECT conv_id, 2, turn, '{"turn":' || turn || ',"role":' || to_json(role) || ',"content":' || to_json(content) || '}' FROM messages""")
def a14_lines(spark, d):
    """Sessions as JSON lines: metadata, scratchpad (the last role) and messages."""
    m = views.messages(spark, d)
    notes = memory.scratchpad(m.select("conv_id", F.lit("last_role").alias("key"), F.col("role").alias("value"), "turn"), ["conv_id", "key"], ["turn"])
    return memory.session_json(m, notes).select("conv_id", "part", "turn", "body")


@query("l05_strategy_by_name", ORACLE["i10_voting"])
def l05(spark, d):
    """The strategy chosen by its name gives what the strategy itself gives; so do the other names below."""
    return keep(ensemble.combine(views.predictions(spark, d), "voting"), *ENS_COLS, "n_agree", "bullish_pct")


# The same changes on versioned tables: deletes are keys, versions are manifests ----------
@query("a05_versioned_replace", ORACLE["a05_replace_tickers"])
def a05_versioned(spark, d):
    bars = views.bars(spark, d).select("ticker", F.year("date").alias("year"), "date", "close")
    prices = VersionedTable(spark, scratch_folder(spark, "prices"), ["ticker"], "year")
    prices.append(bars)
    prices.replace(bars.where(F.col("ticker").like("%3") & (F.col("year") != 1995)).withColumn("close", F.col("close") * 2))
    return prices.read().select("ticker", "date", "close")


@query("a12_versioned_delete", ORACLE["a12_add_delete"])
def a12_versioned(spark, d):
    """Reports appended in two versions, deleted by id in a third, folded in by a fourth."""
    a = views.analyses(spark, d).drop("embedding")
    reports = VersionedTable(spark, scratch_folder(spark, "reports"), ["doc_id"], "date")
    reports.append(a.where("doc_id % 2 = 0"))
    reports.append(a.where("doc_id % 2 = 1"))
    reports.delete(a.where(f"NOT ({_KEPT})"))
    reports.compact()
    return reports.read().select("doc_id", "ticker", "ts", "date", "summary")


@query("a17_versioned_restore", ORACLE["a17_restore_backup"])
def a17_versioned(spark, d):
    a = views.analyses(spark, d).drop("embedding")
    backup = scratch_folder(spark, "backup")
    sinks.export_json(a, backup)
    reports = VersionedTable(spark, scratch_folder(spark, "reports"), ["doc_id"], "date")
    reports.append(a.where("doc_id % 3 = 0"))
    reports.append_new(spark.read.schema(a.schema).json(backup))
    return reports.read().select("doc_id", "ticker", "ts", "date", "summary")


@query("l05_averaging_by_name", ORACLE["i11_averaging"])
def l05_averaging(spark, d):
    return keep(ensemble.combine(views.predictions(spark, d), "averaging"), *ENS_COLS)


@query("l05_unanimous_by_name", ORACLE["i12_unanimous"])
def l05_unanimous(spark, d):
    return keep(ensemble.combine(views.predictions(spark, d), "unanimous"), *ENS_COLS, "unanimous")


@query("l05_weighted_by_name", ORACLE["i14_dynamic_weighting"])
def l05_weighted(spark, d):
    return keep(ensemble.combine(views.predictions(spark, d), "dynamic_weighting", ensemble.rolling_weights(accuracy(spark, d))), *ENS_COLS)
