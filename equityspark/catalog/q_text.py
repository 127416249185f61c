"""News, report and social text queries. All of them read whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.registry import query
from equityspark.catalog.util import keep, r
from equityspark.functions import rules
from equityspark.operators import annotate, features, social, text
from equityspark.sources import views

# Words that occur in the synthetic prose, so that every branch is reached.
LOCAL_CATEGORIES = {
    "company_expected_revenue_news": ["thineri", "onionre", "sales"],
    "macro_news": ["eauaux", "fed", "oil", "rates"],
    "industry_peer_news": ["auto", "peer", "ndered"],
}
LOCAL_THEMES = {
    "growth": ["thin", "increase"], "earnings": ["ering", "eps"], "innovation": ["new", "eau"],
    "risk": ["fall", "erst"], "market": ["sector", "oura"], "guidance": ["expect", "ndon"],
}
LOCAL_KEYWORDS = ["fine", "deal", "split", "halt", "eauoi", "thenti", "ceo", "release", "onent"]


def _cat_sql(cats: dict, default: str, col: str = "title") -> str:
    parts = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in cats.items()
    )
    return f"CASE {parts} ELSE '{default}' END"


@query("h06_news_category_v1", f"SELECT article_id, {_cat_sql(text.CATEGORIES_V1, text.DEFAULT_V1)} AS category FROM news")
def h06(spark, d):
    return views.news(spark, d).select("article_id", text.news_category(F.col("title")).alias("category"))


@query("h07_news_category_v2", f"SELECT article_id, {_cat_sql(text.CATEGORIES_V2, text.DEFAULT_V2)} AS category FROM news")
def h07(spark, d):
    return views.news(spark, d).select(
        "article_id", text.news_category(F.col("title"), text.CATEGORIES_V2, text.DEFAULT_V2).alias("category")
    )


@query("h06_news_category_custom", f"SELECT article_id, {_cat_sql(LOCAL_CATEGORIES, text.DEFAULT_V1)} AS category FROM news")
def h06_custom(spark, d):
    return views.news(spark, d).select("article_id", text.news_category(F.col("title"), LOCAL_CATEGORIES).alias("category"))


def _theme_sql(themes: dict) -> str:
    return ", ".join("(" + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + f") AS {n}" for n, words in themes.items())


@query("h08_theme_flags", f"SELECT article_id, {_theme_sql(text.THEMES)} FROM news")
def h08(spark, d):
    flags = text.theme_flags(F.col("title"))
    return views.news(spark, d).select("article_id", *[c.alias(n) for n, c in flags.items()])


_SUMS = ", ".join(f"CAST(sum(CAST({n} AS BIGINT)) AS BIGINT) AS {n}" for n in LOCAL_THEMES)
_BEST = "greatest(" + ", ".join(LOCAL_THEMES) + ")"
_DOM = "CASE WHEN " + _BEST + " = 0 THEN 'Mixed' " + " ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in LOCAL_THEMES) + " END"
_KINDS = " + ".join(f"CAST({n} > 0 AS BIGINT)" for n in LOCAL_THEMES)


@query("d32_theme_counts", f"""SELECT *, {_DOM} AS dominant_theme, {_KINDS} AS theme_count FROM (SELECT ticker, {_SUMS} FROM (
    SELECT ticker, {_theme_sql(LOCAL_THEMES)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published DESC, article_id) AS k FROM news) WHERE k <= 10) GROUP BY ticker)""")
def d32(spark, d):
    return text.theme_counts(views.news(spark, d), [F.desc("published"), F.asc("article_id")], 10, LOCAL_THEMES)


@query("d39_category_counts", f"SELECT ticker, {_cat_sql(text.CATEGORIES_V1, text.DEFAULT_V1)} AS category, count(*) AS n FROM news GROUP BY 1, 2")
def d39(spark, d):
    return text.category_counts(views.news(spark, d))


def _first_kw(words) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(title), '{w}') THEN '{w}'" for w in words) + " END"


@query("h09_headline_keyword", f"SELECT article_id, {_first_kw(text.IMPORTANT_KEYWORDS)} AS keyword FROM news")
def h09(spark, d):
    return views.news(spark, d).select("article_id", text.first_keyword(F.col("title")).alias("keyword"))


oracle.define("day_change", "SELECT ticker, date, close, coalesce((close - lag(close) OVER w) / lag(close) OVER w * 100, 0) AS change_pct FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
oracle.define("important", f"""SELECT *, coalesce(keyword, printf('%.1f%% price move', abs(change_pct))) AS reason, abs(change_pct) > 3 AS significant_move FROM (
  SELECT n.article_id, n.ticker, n.title, n.publisher, b.date, b.change_pct, {_first_kw(LOCAL_KEYWORDS)} AS keyword
  FROM news n JOIN day_change b ON b.ticker = n.ticker AND b.date = CAST(n.published AS DATE)) WHERE keyword IS NOT NULL OR abs(change_pct) > 3""")


def important(spark, d):
    return annotate.important_news(views.news(spark, d), views.bars(spark, d), LOCAL_KEYWORDS)


@query("h10_important_news", "SELECT article_id, ticker, date, round(change_pct, 6) AS change_pct, reason, significant_move FROM important")
def h10(spark, d):
    return keep(important(spark, d), "article_id", "ticker", "date", "change_pct", "reason", "significant_move")


@query("h04_sentiment_labels", f"SELECT event_id, {r('news_sentiment_trend', 'news_macro_sentiment', 'news_industry_peer_sentiment')} FROM sent_feat")
def h04(spark, d):
    f = text.sentiment_features(views.sentiment_raw(spark, d), "body")
    return keep(f, "event_id", "news_sentiment_trend", "news_macro_sentiment", "news_industry_peer_sentiment")


SENT = list(features.SENTIMENT_DEFAULTS)


@query("h05_sentiment_features", f"SELECT event_id, ticker, date, {r(*SENT)} FROM sent_feat")
def h05(spark, d):
    return keep(text.sentiment_features(views.sentiment_raw(spark, d), "body"), "event_id", "ticker", "date", *SENT)


_RETAIL = """SELECT *, CASE WHEN p > 0 THEN substr(t, p, 200) ELSE t END AS s FROM (SELECT conv_id, turn, lower(content) AS t,
  CASE WHEN instr(lower(content), 'overall retail sentiment') > 0 THEN instr(lower(content), 'overall retail sentiment')
    WHEN instr(lower(content), 'overall sentiment') > 0 THEN instr(lower(content), 'overall sentiment')
    ELSE instr(lower(content), 'retail sentiment') END AS p FROM ret_reports)"""
oracle.define("ret_reports", """SELECT conv_id, turn, content || CASE WHEN turn % 3 = 0 THEN ' Overall Retail Sentiment: ' WHEN turn % 3 = 1 THEN ' retail sentiment ' ELSE ' ' END
    || CASE conv_id % 4 WHEN 0 THEN 'Bullish, positive' WHEN 1 THEN 'bearish and NEGATIVE' WHEN 2 THEN 'bullish but negative' ELSE 'flat' END AS content FROM messages""")
_CNT = "len(regexp_extract_all(s, '{}'))"
oracle.define("retail", f"SELECT conv_id, turn, CASE WHEN {_CNT.format('bullish|positive')} > {_CNT.format('bearish|negative')} THEN 'Bullish' WHEN {_CNT.format('bearish|negative')} > {_CNT.format('bullish|positive')} THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM ({_RETAIL})")


def retail_reports(spark, d):
    """Conversation texts with a closing sentiment phrase that depends on the ids."""
    m = views.messages(spark, d)
    turn, conv = F.pmod("turn", F.lit(3)), F.pmod("conv_id", F.lit(4))
    mark = F.when(turn == 0, " Overall Retail Sentiment: ").when(turn == 1, " retail sentiment ").otherwise(" ")
    word = F.when(conv == 0, "Bullish, positive").when(conv == 1, "bearish and NEGATIVE").when(conv == 2, "bullish but negative").otherwise("flat")
    return m.withColumn("content", F.concat("content", mark, word))


@query("h11_retail_sentiment", "SELECT conv_id, turn, sentiment FROM retail")
def h11(spark, d):
    return retail_reports(spark, d).select("conv_id", "turn", text.retail_sentiment(F.col("content")).alias("sentiment"))


@query("h12_sentiment_split", """SELECT conv_id, turn, CASE sentiment WHEN 'Bullish' THEN 65.0 WHEN 'Bearish' THEN 15.0 ELSE 30.0 END::DOUBLE AS bullish_pct,
  CASE sentiment WHEN 'Bullish' THEN 15.0 WHEN 'Bearish' THEN 65.0 ELSE 30.0 END::DOUBLE AS bearish_pct,
  CASE sentiment WHEN 'Bullish' THEN 20.0 WHEN 'Bearish' THEN 20.0 ELSE 40.0 END::DOUBLE AS neutral_pct FROM retail""")
def h12(spark, d):
    s = retail_reports(spark, d).withColumn("s", rules.sentiment_split(text.retail_sentiment(F.col("content"))))
    return s.select("conv_id", "turn", "s.bullish_pct", "s.bearish_pct", "s.neutral_pct")


oracle.define("rec_reports", """SELECT conv_id, turn, content || CASE (conv_id + turn) % 6 WHEN 0 THEN ' Strong Buy' WHEN 1 THEN ' we would not buy it' WHEN 2 THEN ' a BUY for now'
    WHEN 3 THEN ' hold' WHEN 4 THEN ' sell' ELSE ' highly recommended' END AS content FROM messages""")


@query("h25_report_score", """SELECT conv_id, turn, CASE WHEN contains(t, 'strong buy') OR contains(t, 'highly recommended') THEN 85.0
    WHEN contains(t, 'buy') AND NOT contains(right(split_part(t, 'buy', 1), 20), 'not') THEN 70.0
    WHEN contains(t, 'hold') THEN 50.0 WHEN contains(t, 'sell') THEN 30.0 ELSE 50.0 END::DOUBLE AS score FROM (SELECT conv_id, turn, lower(content) AS t FROM rec_reports)""")
def h25(spark, d):
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    tails = [" Strong Buy", " we would not buy it", " a BUY for now", " hold", " sell", " highly recommended"]
    tail = F.get(F.array(*[F.lit(t) for t in tails]), k.cast("int"))
    m = views.messages(spark, d).withColumn("content", F.concat("content", tail))
    return m.select("conv_id", "turn", text.report_score(F.col("content")).alias("score"))


@query("f10_first_per_category", f"""SELECT ticker, category, article_id, k AS rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, category ORDER BY published DESC, article_id) AS INTEGER) AS k
    FROM (SELECT *, {_cat_sql(text.CATEGORIES_V1, text.DEFAULT_V1)} AS category FROM news)) WHERE k <= 6""")
def f10(spark, d):
    top = text.first_per_category(views.news(spark, d), text.news_category(F.col("title")), [F.desc("published"), F.asc("article_id")], 6)
    return top.select("ticker", "category", "article_id", "rn")


V2_LIMITS = {**{c: 5 for c in text.CATEGORIES_V2}, text.DEFAULT_V2: 8}


@query("f10_first_per_category_v2", f"""SELECT ticker, category, article_id, k AS rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, category ORDER BY published DESC, article_id) AS INTEGER) AS k
    FROM (SELECT *, {_cat_sql(text.CATEGORIES_V2, text.DEFAULT_V2)} AS category FROM news)) WHERE k <= CASE category {' '.join(f"WHEN '{c}' THEN {n}" for c, n in V2_LIMITS.items())} END""")
def f10_v2(spark, d):
    category = text.news_category(F.col("title"), text.CATEGORIES_V2, text.DEFAULT_V2)
    top = text.first_per_category(views.news(spark, d), category, [F.desc("published"), F.asc("article_id")], V2_LIMITS)
    return top.select("ticker", "category", "article_id", "rn")


@query("h32_default_sentiment", """SELECT i.ticker, coalesce(n, 0) AS news_count, CASE WHEN n IS NULL THEN 'neutral' ELSE 'known' END AS direction, CASE WHEN n IS NULL THEN 50.0 ELSE 60.0 END::DOUBLE AS score
    FROM instrument i LEFT JOIN (SELECT ticker, count(*) AS n FROM news WHERE contains(lower(title), 'eauaux') GROUP BY 1) x USING (ticker)""")
def h32(spark, d):
    known = views.news(spark, d).where(F.lower("title").contains("eauaux")).groupBy("ticker").agg(F.count("*").alias("news_count"))
    known = known.withColumns({"direction": F.lit("known"), "score": F.lit(60.0)})
    return text.with_default_sentiment(views.instrument(spark, d), known).select("ticker", "news_count", "direction", "score")


@query("h34_news_document")
def h34(spark, d):
    return text.news_document(views.news(spark, d), [F.desc("published"), F.asc("article_id")], "2024-01-31")


@query("h34_posts_document")
def h34_posts(spark, d):
    posts = social.deduplicate(views.posts(spark, d), ["copy"])
    return social.posts_document(posts, "2024-01-31")


@query("h26_date_narrative", """SELECT ticker, date, printf('On %s, %s moved %s %s by %.2f%%. ', CAST(date AS VARCHAR), ticker,
      CASE WHEN abs(dc) > 3 THEN 'significantly' WHEN abs(dc) > 1 THEN 'slightly' ELSE 'marginally' END, CASE WHEN dc > 0 THEN 'up' ELSE 'down' END, abs(dc))
    || CASE WHEN abs(vv) > 50 THEN printf('Trading volume was %.0f%% %s than average. ', abs(round(vv, 6)), CASE WHEN vv > 0 THEN 'higher' ELSE 'lower' END) ELSE '' END
    || CASE WHEN n > 0 THEN printf('There were %d news articles around this time. ', n) ELSE 'No major news events were detected around this date. ' END
    || CASE WHEN abs(dc) > 3 OR abs(vv) > 50 THEN 'This was a significant trading day.' ELSE '' END AS summary
  FROM (SELECT b.ticker, b.date, (close - open) / open * 100 AS dc, (volume - avg(volume) OVER (PARTITION BY b.ticker)) / avg(volume) OVER (PARTITION BY b.ticker) * 100 AS vv,
      coalesce(n, 0) AS n FROM bars b LEFT JOIN (SELECT b.ticker, b.date, count(*) AS n FROM bars b JOIN news n ON n.ticker = b.ticker AND abs(epoch(n.published) - epoch(CAST(b.date AS TIMESTAMP))) <= 3 * 86400 GROUP BY 1, 2) x ON x.ticker = b.ticker AND x.date = b.date)""")
def h26(spark, d):
    from equityspark.plans import snapshot

    from equityspark.operators import annotate

    near = annotate.news_around(views.bars(spark, d), views.news(spark, d), n=1)
    n = near.select("ticker", "date", F.col("n_articles").alias("n"))
    m = snapshot.day_metrics(views.bars(spark, d)).join(n, ["ticker", "date"], "left").fillna({"n": 0})
    return m.select("ticker", "date", text.date_narrative(
        F.col("ticker"), F.col("date"), F.col("day_change_pct"), F.round("volume_vs_avg", 6), F.col("n"), F.col("significant")).alias("summary"))


# Social -------------------------------------------------------------------------
@query("g01_query_variants", """SELECT id, copy, platform, variant FROM (
    SELECT *, 'cashtag' AS variant FROM posts WHERE contains(text, '$' || ticker)
    UNION ALL SELECT *, 'hashtag' FROM posts WHERE contains(text, '#' || ticker)
    UNION ALL SELECT *, 'plain' FROM posts WHERE regexp_matches(upper(text), '(^|[^A-Z0-9$#])' || ticker || '([^A-Z0-9]|$)'))""")
def g01(spark, d):
    return social.collect_variants(views.posts(spark, d)).select("id", "copy", "platform", "variant")


oracle.define("dedup_posts", "SELECT * FROM posts WHERE id IS NOT NULL AND copy = 0")


@query("g02_dedup_posts", "SELECT platform, id, ticker, likes, comments FROM dedup_posts")
def g02(spark, d):
    return social.deduplicate(views.posts(spark, d), ["copy"]).select("platform", "id", "ticker", "likes", "comments")


@query("f07_top_posts", """SELECT platform, id, likes + comments + shares AS engagement, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY platform
    ORDER BY likes + comments + shares DESC, id) AS k FROM dedup_posts) WHERE k <= 20""")
def f07(spark, d):
    return social.top_posts(social.deduplicate(views.posts(spark, d), ["copy"])).select("platform", "id", "engagement", "rank")


@query("d33_platform_counts", "SELECT ticker, " + ", ".join(f"count(*) FILTER (platform = '{p}') AS {p}" for p in social.PLATFORMS) + ", count(*) AS total FROM dedup_posts GROUP BY ticker")
def d33(spark, d):
    return social.platform_counts(social.deduplicate(views.posts(spark, d), ["copy"]))
