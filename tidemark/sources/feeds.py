"""Payloads of feeds and channels as records. Fetching is apart: these take landed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text


def stamp(rows: DataFrame, source: str, now: Column) -> DataFrame:
    """Rows under their source's name, collected now."""
    return rows.withColumns({"source": F.lit(source), "collected_at": now})


def cap(items: DataFrame, most: int = 200, order: str = "position") -> DataFrame:
    """The first items of each feed."""
    w = Window.partitionBy("feed").orderBy(order)
    return items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def rss_articles(items: DataFrame, now: Column, strip: Callable[[Column], Column] = fuzzy.page_text, blanked_host: str | None = None) -> DataFrame:
    """Articles of feed items with a link and a title; a missing time is now; one host's summaries may be blanked."""
    title, summary = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("summary", F.lit("")))
    if blanked_host:
        summary = F.when(F.parse_url("link", F.lit("HOST")) == blanked_host, "").otherwise(summary)
    made = items.withColumns({"title": title, "description": summary, "published": F.coalesce("published", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"))})
    return made.drop("summary").filter("link <> '' AND title <> ''")


def rss_records(articles: DataFrame) -> DataFrame:
    body = F.when(F.coalesce("description", F.lit("")) != "", F.concat("title", F.lit(". "), "description")).otherwise(F.col("title"))
    return articles.withColumns({"text": body, "source_id": F.col("link"), "url": F.col("link"), "published_at": F.col("published"), "source": F.lit("rss")})


def gdelt_records(articles: DataFrame) -> DataFrame:
    image = F.when(F.coalesce("socialimage", F.lit("")) != "", F.array("socialimage")).otherwise(F.array().cast("array<string>"))
    about = F.struct("domain", "language", F.col("sourcecountry").alias("source_country"))
    return articles.withColumns({"media_urls": image, "entities": about, "source_id": F.col("url"), "published_at": F.col("seendate"), "source": F.lit("gdelt")})


def mastodon_plan(instances: DataFrame, tags: list[str]) -> DataFrame:
    """Every (instance, timeline) to fetch: the public one and each tag's."""
    return instances.select("instance", F.explode(F.array(F.lit("public"), *map(F.lit, tags))).alias("tag"))


def mastodon_records(statuses: DataFrame, to_text: Callable[[Column], Column] = fuzzy.spaced_page_text) -> DataFrame:
    body = to_text(F.col("content"))
    return statuses.withColumns({"text": body, "title": F.substring(body, 1, 100), "source_id": F.col("url"), "published_at": F.col("created_at"), "source": F.lit("mastodon")})


def watchlist(names: DataFrame, column: str, order: str) -> DataFrame:
    """Channel names, trimmed, without leading @, each once, in order of first mention."""
    clean = F.regexp_replace(text.strip(F.col(column)), "^@+", "")
    return names.select(clean.alias("channel"), order).filter("channel <> ''").groupBy("channel").agg(F.min(order).alias("position"))


def channel_posts(pages: DataFrame, column: str = "html") -> DataFrame:
    """A row for each post on channel pages."""
    return pages.withColumn("_p", F.explode(fuzzy.posts(F.col(column)))).select(*[c for c in pages.columns if c != column], "_p.*")


def telegram_records(posts: DataFrame, internal: tuple[str, ...] = ("https://t.me/", "tg://")) -> DataFrame:
    outside = F.filter("media", lambda u: ~F.coalesce(_any_prefix(u, internal), F.lit(False)))
    return posts.withColumns({"media_urls": outside, "title": text.ellipsis(F.col("text"), 100), "source_id": F.col("post"), "published_at": F.col("time"), "source": F.lit("telegram")})


def _any_prefix(u: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | u.startswith(p)
    return out
