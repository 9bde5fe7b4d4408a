"""Feeds: Atom entries to papers and RSS items to news, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksift.functions.text import arxiv_id, clean_html, feed_date, paper_urls, strip, text_or_null, truncate, url_id

ATOM = "id string, title string, summary string, author array<struct<name string>>, category array<struct<_term string>>, primary_category struct<_term string>, published string, updated string, comment string"
ITEM = "title string, link string, guid string, id string, pubDate string, published string, updated string, date string, created string, description string, summary string, encoded string, content string"


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", True).option("mode", "DROPMALFORMED").schema(schema).load(path)


def read_atom_papers(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: papers of Atom pages. The primary category falls back to the first one; dates are UTC."""
    rows = read_xml(spark, path, "entry", ATOM).where(text_or_null(F.col("id")).isNotNull())
    one_line = lambda c: strip(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    categories = F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast("array<string>"))
    pid = arxiv_id(F.col("id"))
    when = lambda c: feed_date(F.col(c), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("timestamp"))
    return rows.select(
        pid.alias("id"), F.lit("arxiv").alias("source"), one_line("title").alias("title"), F.coalesce(F.transform("author", lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"), one_line("summary").alias("abstract"),
        categories.alias("categories"), F.coalesce("primary_category._term", F.get(categories, F.lit(0)), F.lit("")).alias("primary_category"), paper_urls(pid)["pdf_url"].alias("pdf_url"), paper_urls(pid)["abs_url"].alias("abs_url"),
        when("published").alias("published"), when("updated").alias("updated"), text_or_null(F.col("comment")).alias("comment"),
    )


def read_rss_items(spark: SparkSession, path: str, source: dict, now: Column) -> DataFrame:
    """SRC-03: news rows of one source's RSS pages; items without a URL or a title are dropped.

    source: name, category, language, weight. Dates that can't be read become now.
    """
    rows = read_xml(spark, path, "item", ITEM)
    url = F.coalesce(text_or_null(F.trim("link")), text_or_null(F.trim("id")), text_or_null(F.trim("guid")))
    short = F.coalesce(text_or_null(F.col("summary")), text_or_null(F.col("description")))
    full = F.coalesce(clean_html(F.coalesce(text_or_null(F.col("encoded")), text_or_null(F.col("content")))), clean_html(short))
    named = rows.select("*", url.alias("url"), strip(F.col("title")).alias("t")).where("url is not null and t <> ''")
    published = feed_date(F.coalesce("pubDate", "published", "date"), F.col("updated"), F.col("created"), now)
    return named.select(
        url_id(F.col("url")).alias("id"), F.col("t").alias("title"), "url", F.lit(source["name"]).alias("source_name"), F.lit(source["category"]).alias("source_category"), F.lit(source["language"]).alias("language"),
        published.alias("published"), truncate(clean_html(short), 500).alias("summary"), full.alias("content"), F.lit(float(source["weight"])).alias("weight"),
    )
