"""Landed feed files, RSS, RDF and Atom, as items: parsed by Spark's XML reader, a row for each feed.

A feed's items come as one array in the order of its file, so the cap is a
slice of it, taken before they become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

CORRUPT = "_corrupt"
_ITEM = "array<struct<title: string, link: string, description: string, pubDate: string, date: string>>"
_ENTRY = "array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string>>"
#: The row tag of each kind of feed, without its prefix as namespaces are ignored, and the part of it that is read.
KINDS = {
    "channel": f"title string, item {_ITEM}",
    "RDF": f"channel struct<title: string>, item {_ITEM}",
    "feed": f"title string, entry {_ENTRY}",
}


def feed_urls(spark: SparkSession, path: str) -> DataFrame:
    """``(position, url)`` of a JSON array of feed addresses, in its order; blank and null ones are left out."""
    listed = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("urls"))
    return listed.select(F.posexplode("urls").alias("position", "url")).filter("trim(url) <> ''")


def file_name(url: Column) -> Column:
    """The name under which a feed lands."""
    return F.concat(F.sha2(url.cast("binary"), 256), F.lit(".xml"))


def _read(spark: SparkSession, path: str, tag: str) -> DataFrame:
    reader = spark.read.format("xml").options(rowTag=tag, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, ignoreNamespace=True, pathGlobFilter="*.xml", recursiveFileLookup=True)
    found = reader.schema(f"{KINDS[tag]}, {CORRUPT} string").load(path)
    return found.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))


def _items(read: DataFrame, author: Column, items: Column, most: int) -> DataFrame:
    each = read.filter(F.col(CORRUPT).isNull()).select("file", author.alias("author"), F.posexplode(F.slice(items, 1, most)).alias("position", "i"))
    return each.withColumn("author", F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("Unknown")))


def feed_items(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """``(file, author, position, title, link, summary, published)``: the first ``most`` items of every feed under ``path``.

    ``author`` is the feed's title; ``published`` an ISO text or null where it
    is missing or no time. A feed that is no XML gives no item; see
    ``broken_feeds``. A feed without items gives none.
    """
    flat = lambda df: df.select(
        "file", "author", "position", F.col("i.title").alias("title"), F.col("i.link").alias("link"), F.col("i.description").alias("summary"),
        times.iso_text(F.coalesce(times.parse_rfc822(F.col("i.pubDate")), times.parse_iso(F.col("i.date")))).alias("published"),
    )
    rss = flat(_items(_read(spark, path, "channel"), F.col("title"), F.col("item"), most))
    rdf = flat(_items(_read(spark, path, "RDF").filter("item IS NOT NULL"), F.col("channel.title"), F.col("item"), most))
    atom = _items(_read(spark, path, "feed"), F.col("title"), F.col("entry"), most)
    # the link to the page itself, else the first
    links = F.col("i.link")
    page = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select(
        "file", "author", "position", F.col("i.title").alias("title"), F.coalesce(F.get(page, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]).alias("link"),
        F.coalesce("i.summary", "i.content").alias("summary"), times.iso_text(times.parse_iso(F.coalesce("i.published", "i.updated"))).alias("published"),
    )
    # an RDF file has a channel, too, but one without items
    return rss.unionByName(rdf).unionByName(atom)


def broken_feeds(spark: SparkSession, path: str) -> DataFrame:
    """``(file, titled, raw)`` of files that no kind of feed can be read from, for the dead letters; an empty file is no feed and not broken.

    ``titled``: whether a title was read before the fault.
    """
    found = None
    for tag in KINDS:
        read = _read(spark, path, tag)
        # the reader wants a column of the feed beside the raw text
        one = read.select("file", F.col(read.columns[0]).isNotNull().alias("titled"), F.col(CORRUPT).alias("raw"))
        found = one if found is None else found.unionByName(one)
    judged = found.groupBy("file").agg(F.max("raw").alias("raw"), F.max(F.col("raw").isNull()).alias("good"), F.max("titled").alias("titled"))
    return judged.filter("NOT good AND trim(raw) <> ''").select("file", "titled", "raw")
