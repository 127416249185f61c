"""Social posts: query variants, de-duplication, engagement ranking (ids G1, G2, F7, D33, H34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.functions.core import latest_per, top_n

PLATFORMS = ["twitter", "reddit", "tiktok", "instagram"]


def matches_variants(text: Column, ticker: Column) -> Column:
    """Cashtag, hashtag and plain-word mention of the ticker, as an array of the variants hit."""
    upper = F.upper(text)
    t = F.upper(ticker)
    word = F.concat(F.lit(r"(^|[^A-Z0-9$#])"), t, F.lit(r"([^A-Z0-9]|$)"))
    return F.array_compact(
        F.array(
            F.when(upper.contains(F.concat(F.lit("$"), t)), "cashtag"),
            F.when(upper.contains(F.concat(F.lit("#"), t)), "hashtag"),
            F.when(F.regexp_like(upper, word), "plain"),
        )
    )


def collect_variants(posts: DataFrame) -> DataFrame:
    """One row per post and query variant that finds it (the union of the variant queries)."""
    return posts.withColumn("variant", F.explode(matches_variants(F.col("text"), F.col("ticker"))))


def deduplicate(posts: DataFrame, order: list[str]) -> DataFrame:
    """First post per (platform, id) in the given order; posts without an id are dropped.

    ``min_by`` combines on the map side: a post copied a billion times is one row per task.
    """
    known = posts.where(F.col("id").isNotNull())
    rest = [c for c in known.columns if c not in ("platform", "id")]
    first = known.groupBy("platform", "id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select("platform", "id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def engagement() -> Column:
    """likes + comments + shares; upvotes and retweets do not count."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("likes", "comments", "shares")), F.lit(0).cast("long"))


def top_posts(posts: DataFrame, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """Most engaging posts per platform (or other keys); ties by id."""
    ranked = posts.withColumn("engagement", engagement())
    return top_n(ranked, by or ["platform"], [F.desc("engagement"), F.asc("id")], n, "rank")


def platform_counts(posts: DataFrame) -> DataFrame:
    """Posts per ticker and platform (wide) with the total."""
    wide = posts.groupBy("ticker").agg(
        *[F.sum((F.col("platform") == p).cast("long")).alias(p) for p in PLATFORMS], F.count("*").alias("total")
    )
    return wide


def posts_document(posts: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """One text per ticker: per platform the post count and the top posts by engagement."""
    counts = posts.groupBy("ticker", "platform").agg(F.count("*").alias("_n"))
    top = top_posts(posts, n, ["ticker", "platform"])
    line = F.format_string(
        "%d. %s\n   Engagement: %d likes, %d comments", F.col("rank"), F.coalesce("text", F.lit("N/A")),
        F.coalesce("likes", F.lit(0)), F.coalesce("comments", F.lit(0)),
    )
    body = top.groupBy("ticker", "platform").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("_b")
    )
    parts = counts.join(body, ["ticker", "platform"]).groupBy("ticker").agg(
        F.sum("_n").alias("_total"),
        *[F.max(F.when(F.col("platform") == p, F.format_string("Post Count: %d\n%s", F.col("_n"), F.col("_b")))).alias(p) for p in PLATFORMS],
    )
    sections = [
        F.concat(F.lit(f"## [{p.upper()} POSTS]\n"), F.coalesce(F.col(p), F.lit("No posts found.")), F.lit("\n")) for p in PLATFORMS
    ]
    head = F.format_string(
        "# Social Media Analysis for %s\nAnalysis Date: %s\n\nTOTAL POSTS: %d across all platforms\n",
        F.col("ticker"), F.lit(as_of), F.col("_total"),
    )
    return parts.select("ticker", F.concat_ws("\n", head, *sections).alias("document"))
