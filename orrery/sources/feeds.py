"""RSS and Atom files as one table.

Items (``item`` in RSS, ``entry`` in Atom) are cut out of the files at their end
tags, so large files are read in splits, and each is parsed as XML by itself.  Links are the text of RSS's ``link`` and the
``href`` of Atom's: that of ``rel="alternate"`` or none first.  Dates fall back from
``pubDate`` to ``dc:date`` and from ``published`` to ``updated``.  A damaged item keeps
its text in ``damaged`` and has no other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import strip_html

RSS = "title string, link string, description string, pubDate string, `dc:date` string, damaged string"
ATOM = "title string, link array<struct<_href: string, _rel: string>>, summary string, published string, updated string, damaged string"
#: Written dates, tried in order.
FORMATS = ("EEE, dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd")


def any_date(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The moment that the first fitting format gives; null if none fits."""
    bare = F.regexp_replace(F.trim(text), "^[A-Z][a-z]{2}, ", "")  # week days are not parsed, dates alone decide
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f.removeprefix("EEE, "))) for f in dict.fromkeys(f.removeprefix("EEE, ") for f in formats)])


def _items(spark: SparkSession, where: str, tag: str, schema: str) -> DataFrame:
    """The elements of that name: files are split at the end tags, so that a damaged one takes no other with it."""
    parts = spark.read.option("lineSep", f"</{tag}>").text(where)
    item = F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1)
    parsed = F.from_xml(F.concat("item", F.lit(f"</{tag}>")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"})
    return parts.select(item.alias("item")).filter("item <> ''").select(parsed.alias("x")).select("x.*")


def _articles(rows: DataFrame, kind: str, link: Column, text: Column, date: Column) -> DataFrame:
    bare = F.nullif(strip_html(text), F.lit(""))
    return rows.select(F.lit(kind).alias("kind"), F.trim("title").alias("title"), F.trim(link).alias("link"), bare.alias("summary"), any_date(date).alias("published"), "damaged")


def read_feeds(spark: SparkSession, rss: str | None = None, atom: str | None = None) -> DataFrame:
    """``kind, title, link, summary, published, damaged`` of the items in folders of RSS and of Atom files."""
    found = []
    if rss is not None:
        rows = _items(spark, rss, "item", RSS)
        found.append(_articles(rows, "rss", F.col("link"), F.col("description"), F.coalesce("pubDate", "`dc:date`")))
    if atom is not None:
        rows = _items(spark, atom, "entry", ATOM)
        first = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        found.append(_articles(rows, "atom", F.coalesce(F.get(first, F.lit(0)), F.get("link", F.lit(0)))["_href"], F.col("summary"), F.coalesce("published", "updated")))
    if not found:
        raise ValueError("a folder of feeds is needed")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
