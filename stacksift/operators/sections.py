"""Saved pages to rows, and look-up in the sections of full texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stacksift.functions.text import absolute_url, clean_html, heading_parts, parse_date_multi, parse_star_count, text_or_null, url_id
from stacksift.operators import htmltree
from stacksift.operators.batches import slices, tidy
from stacksift.operators.filters import source_url_rules
from stacksift.operators.ranking import first_wins, trending_limit

TRENDING = "page_id long, pos int, owner string, name string, description string, language string, stars_text string, weekly_text string"


def per_page(pages: DataFrame, schema: str, rows: Any, *more: str) -> DataFrame:
    """rows(page_id, *more, html) -> tuples of schema, for every page, in runs of about half a megabyte of HTML."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                found = [dict(zip(kind.names, r, strict=True)) for page in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in rows(*page)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kind)

    return pages.select("page_id", *more, "html").mapInArrow(tidy(run), schema)


def trending_rows(pages: DataFrame, n: int = 25, min_stars: int = 1000) -> DataFrame:
    """TX-01: repository cards of trending pages in page order, first card of an id, above the star limit, n per page."""

    def cards(page_id: int, html: str) -> Iterator[tuple]:
        for pos, card in enumerate(htmltree.select(htmltree.parse(html), "article.Box-row")):
            link = htmltree.select(card, "h2 a")
            path = [p for p in link[0].attrs.get("href", "").strip().strip("/").split("/") if p] if link else []
            if len(path) < 2:
                continue
            first = lambda s: next((x.text() for x in htmltree.select(card, s)), "")  # noqa: B023, E731
            weekly = next((t for t in (x.text() for x in htmltree.select(card, "span")) if "stars this" in t), "")
            yield page_id, pos, path[0], path[1], first("p"), first("[itemprop='programmingLanguage']") or None, first('a[href$="/stargazers"]'), weekly

    found = per_page(pages, TRENDING, cards)
    full = F.concat_ws("/", "owner", "name")
    named = found.select(
        "page_id", "pos", F.lower(full).alias("repo_id"), "owner", "name", full.alias("full_name"), F.concat(F.lit("https://github.com/"), full).alias("url"), "description", "language",
        parse_star_count(F.col("stars_text")).alias("stars"), parse_star_count(F.col("weekly_text")).alias("weekly_stars"),
    )
    return trending_limit(named, n, min_stars)


#: A row of the selector table: one source's listing pages.
LISTING = "source_name string, base string, title string, url string, date string, summary string, site string, formats array<string>"


def listing_records(pages: DataFrame, selectors: Sequence[dict], rules: DataFrame | None, now: Any) -> DataFrame:
    """TX-02: records of listing pages (page_id, source_name, html) by their source's selectors, a small table.

    selectors: dicts with source_name, base, title, url (empty: the base node itself), date, summary, site
    and formats. Rows lack neither title nor URL, pass the URL rules, and are the first of their URL in a page.
    """
    table = {s["source_name"]: s for s in selectors}
    schema = "page_id long, source_name string, pos int, title string, link string, date string, summary string"

    def items(page_id: int, source: str, html: str) -> Iterator[tuple]:
        spec = table.get(source)
        for pos, node in enumerate(htmltree.select(htmltree.parse(html), spec["base"]) if spec else []):
            first = lambda s: next(iter(htmltree.select(node, s)), None) if s else node  # noqa: B023, E731
            text = lambda k: x.text() if spec.get(k) and (x := first(spec[k])) is not None else None  # noqa: B023, E731
            link = first(spec.get("url"))
            yield page_id, source, pos, text("title"), link.attrs.get("href") if link is not None else None, text("date"), text("summary")

    found = per_page(pages, schema, items, "source_name")
    site = F.create_map(*[F.lit(v) for s in selectors for v in (s["source_name"], s.get("site", ""))]) if selectors else F.create_map()
    url = absolute_url(F.coalesce(site[F.col("source_name")], F.lit("")), F.trim("link"))
    published = F.lit(now)
    for s in selectors:
        published = F.when(F.col("source_name") == s["source_name"], parse_date_multi(F.trim("date"), s["formats"], F.lit(now))).otherwise(published)
    rows = found.withColumns({"url": url, "published": published, "title": text_or_null(F.trim("title"))}).where("title is not null and coalesce(url, '') <> ''")
    rows = source_url_rules(rows, rules) if rules is not None else rows
    once = first_wins(rows.withColumn("_key", F.struct("page_id", "url")), "_key", "pos").drop("_key")
    return once.select("page_id", "source_name", "pos", url_id(F.col("url")).alias("id"), "title", "url", "published", text_or_null(F.col("summary")).alias("summary"))


def detail_fields(pages: DataFrame, base: str = "main, article", title: str = "h1", date: str = "time, .date") -> DataFrame:
    """TX-03: (page_id, title, date, content) of each page's first base node; pages without any of them give no row."""

    def record(page_id: int, html: str) -> Iterator[tuple]:
        for node in htmltree.select(htmltree.parse(html), base)[:1]:
            text = lambda s: next((x.text() for x in htmltree.select(node, s)), None)
            yield page_id, text(title), text(date), node.text()

    found = per_page(pages, "page_id long, title string, date string, content string", record)
    texts = F.struct(*[clean_html(F.col(c)).alias(c) for c in ("title", "date", "content")])
    cleaned = found.select("page_id", F.inline(F.array(texts)))  # no filter passes it, so that texts are cleaned once
    return cleaned.where("title is not null or date is not null or content is not null")


def outline(html: str | None) -> tuple[list[str], list[list]]:
    """(paragraphs, sections [parent, level, heading, first, last]): one pass with a stack of open sections.

    A section's paragraphs are those from first to last (not with it), its sub-sections' among them.
    """
    paragraphs: list[str] = []
    sections: list[list] = []
    open_: list[int] = []
    root = htmltree.content_root(htmltree.parse(html))
    for node in root.walk():
        if len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "23456":
            level = int(node.tag[1])
            while open_ and sections[open_[-1]][1] >= level:
                sections[open_.pop()][4] = len(paragraphs)
            sections.append([open_[-1] if open_ else None, level, node.text(), len(paragraphs), None])
            open_.append(len(sections) - 1)
        elif node.tag == "p" and (text := node.text()):
            paragraphs.append(text)
    for i in open_:
        sections[i][4] = len(paragraphs)
    return paragraphs, sections


MIN_HTML = 1000
SPAN = "struct<sec_idx: int, parent_idx: int, level: int, heading: string, first: int, last: int>"


def page_outlines(pages: DataFrame) -> DataFrame:
    """TX-04 and TX-05 in one row per page: (page_id, html_chars, failed, paragraphs, spans).

    Each paragraph is there once; sections are spans of paragraph numbers, nested like the headings, so a row is as
    large as its page however deep the sections lie. failed: the page has under MIN_HTML characters or no section.
    """

    span = ("sec_idx", "parent_idx", "level", "heading", "first", "last")

    def row(page_id: int, html: str | None) -> Iterator[tuple]:
        paragraphs, sections = outline(html)
        yield page_id, len(html or ""), len(html or "") < MIN_HTML or not sections, paragraphs, [dict(zip(span, (i, *s), strict=True)) for i, s in enumerate(sections)]

    return per_page(pages, f"page_id long, html_chars int, failed boolean, paragraphs array<string>, spans array<{SPAN}>", row)


def sections_of(outlines: DataFrame) -> DataFrame:
    """TX-04's rows from page_outlines(): each section with all its paragraphs, a row for each failed page."""
    each = outlines.withColumn("s", F.explode(F.when(F.col("failed"), F.array(F.lit(None).cast(SPAN))).otherwise(F.col("spans"))))
    parts = heading_parts(F.col("s.heading"))
    own = F.when(~F.col("failed"), F.slice("paragraphs", F.col("s.first") + 1, F.col("s.last") - F.col("s.first")))
    return each.select("page_id", "s.sec_idx", "s.parent_idx", "s.level", "s.heading", parts["number"].alias("number"), parts["title"].alias("title"), own.alias("paragraphs"), "html_chars", "failed")


def section_rows(pages: DataFrame) -> DataFrame:
    """TX-04: (page_id, sec_idx, parent_idx, level, heading, number, title, paragraphs, html_chars, failed) in document order.

    A section's paragraphs run to the next heading of its rank or a higher one. A page under MIN_HTML
    characters or without a section gives one row that is marked as failed.
    """
    return sections_of(page_outlines(pages))


def front_matter(pages: DataFrame, n: int = 30) -> DataFrame:
    """TX-05: (page_id, paragraphs): up to n non-empty paragraphs before the first heading."""
    lead = F.coalesce(F.get("spans", F.lit(0))["first"], F.size("paragraphs"))
    return page_outlines(pages).select("page_id", F.slice("paragraphs", 1, F.least(lead, F.lit(n))).alias("paragraphs"))


#: What section keys stand for.
SYNONYMS = {
    "abstract": ["abstract"], "introduction": ["introduction", "intro"], "intro": ["introduction", "intro"], "related": ["related", "background", "prior work"],
    "related_work": ["related", "background", "prior work"], "method": ["method", "methods", "methodology", "approach"], "experiment": ["experiment", "experiments", "evaluation", "setup"],
    "results": ["results", "result", "findings"], "discussion": ["discussion", "analysis"], "conclusion": ["conclusion", "conclusions", "summary"],
}


def find_sections(sections: DataFrame, key: str, n: int = 3, cut: int = 4000, extra: Sequence[str] = ()) -> DataFrame:
    """TX-06: per paper, the first n sections whose title or heading has a synonym of the key, with their text, cut."""
    folded = " ".join(key.lower().split())
    words = [*SYNONYMS.get(folded, [folded]), *extra]
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(plain("title"), F.lit(w)) | F.contains(plain("heading"), F.lit(w))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("sec_idx"))
    text = F.array_join("paragraphs", "\n\n")
    return sections.where(hit).withColumn("_rn", rank).where(F.col("_rn") <= n).select("paper_id", "sec_idx", "heading", F.substring(text, 1, cut).alias("content"), (F.char_length(text) > cut).alias("was_cut"))


def keyword_contexts(sections: DataFrame, keyword: str, n: int = 5, hits: int = 3, around: int = 250) -> DataFrame:
    """TX-07: per paper, the first n sections with the keyword in any case, each with up to `hits` windows of `around` characters either side."""

    @F.pandas_udf(T.StringType())
    def windows(s: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            low, word, out, start = text.lower(), keyword.lower(), [], 0
            while len(out) < hits and (pos := low.find(word, start)) >= 0:
                a, b = max(0, pos - around), min(len(text), pos + len(word) + around)
                out.append(("..." if a > 0 else "") + text[a:b] + ("..." if b < len(text) else ""))
                start = pos + len(word)
            return "\n\n---\n\n".join(out)

        return s.map(one)

    joined = sections.withColumn("_text", F.array_join("paragraphs", "\n\n")).where(F.contains(F.lower("_text"), F.lower(F.lit(keyword))))
    first = joined.withColumn("_rn", F.row_number().over(Window.partitionBy("paper_id").orderBy("sec_idx"))).where(F.col("_rn") <= n)
    return first.select("paper_id", "sec_idx", "heading", windows("_text").alias("context"))


def section_overview(sections: DataFrame, n: int = 60) -> DataFrame:
    """TX-08: per paper, the number of sections, the first n headings in tree order, and its paper_title where sections have it."""
    title = ["paper_title"] if "paper_title" in sections.columns else []
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("sec_idx"))
    first = F.when(F.col("_rn") <= n, F.struct("sec_idx", "heading"))
    found = sections.select("paper_id", "sec_idx", "heading", rank.alias("_rn"), *title).groupBy("paper_id").agg(*[F.min(c).alias(c) for c in title], F.count("*").alias("n_sections"), F.array_sort(F.collect_list(first)).alias("h"))
    return found.select("paper_id", *title, "n_sections", F.transform("h", lambda x: x["heading"]).alias("headings"))
