"""Text, id, number and date functions on columns. None of them shuffles; "now" is always a parameter."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All white space as Python's strip() sees it, at both ends.
EDGES = r"(?U)^\s+|\s+$"


def text_or_null(c: Column) -> Column:
    """c, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """HTML entities to characters; Spark has no built-in for them."""
    return s.map(html.unescape, na_action="ignore")


#: An entity with its closing semicolon.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


@F.pandas_udf(T.StringType())
def unescape_closed_entities(s: pd.Series) -> pd.Series:
    """Like unescape_entities, but a name without its semicolon ("&amp ") stays, and so does one that HTML does not know."""
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return s.map(lambda t: CLOSED.sub(one, t), na_action="ignore")


def clean_html(c: Column, closed: bool = False) -> Column:
    """FN-01: plain text of an HTML fragment; null where nothing is left. Entities are resolved after the tags went.

    HTML also reads some names without their semicolon; closed: those stay as they are.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<[^>]+>", " ")
    unescape = unescape_closed_entities if closed else unescape_entities
    lines = F.regexp_replace(unescape(bare), r"\r\n?", "\n")
    for pattern, to in ((r"[ \t\f\x0B]+", " "), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        lines = F.regexp_replace(lines, pattern, to)
    return text_or_null(strip(lines))


def truncate(c: Column, n: int) -> Column:
    """FN-02: the first n characters and "..." where c is longer; null for null, empty, or n <= 0."""
    if n <= 0:
        return F.lit(None).cast("string")
    return text_or_null(F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c))


#: What marks a badge line of a README.
BADGES = ("shields.io", "badge", "github.com/actions", "github/workflows", "codecov")


#: Stands for a line that was blank from the start; no character of any text.
BLANK = "\ufdd0"


def clean_readme(c: Column, n: int = 8000) -> Column:
    """FN-03: prose of a Markdown README: no code blocks, badges, images, link targets, tags or line prefixes.

    Each pattern runs once over the whole text, line by line through its flags. Lines that become empty
    go, lines that were blank stay.
    """
    badges = "|".join(re.escape(b) for b in BADGES)
    steps = [
        (r"\r\n?", "\n"),
        ("(?s)```.*?```", "\n"),
        ("(?s)~~~.*?~~~", "\n"),
        ("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"),
        (r"(?dUm)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""),
        ("(?dm)^$", BLANK),
        (rf"(?dim)^(?:!\[.*|.*(?:{badges}).*)$", ""),
        (r"!\[[^\]\n]*\]\([^)\n]+\)", ""),
        (r"\[([^\]\n]+)\]\([^)\n]+\)", "$1"),
        (r"<[^>\n]+>", " "),
        ("`", ""),
        (r"(?dUm)^[#>*\-\s&&[^\n]]+", ""),
        (r"(?U)[\s&&[^\n]]+", " "),
        ("(?dm)^ +| +$", ""),
        (r"\n{2,}", "\n"),
        (BLANK, ""),
    ]
    text = c
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    joined = strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return F.when(F.char_length(joined) > n, F.regexp_replace(F.substring(joined, 1, n), r"(?U)\s+$", "")).otherwise(joined) if n > 0 else joined


def parse_star_count(c: Column) -> Column:
    """FN-04: "1,234" -> 1234, "2.5k stars" -> 2500, "1.2m" -> 1200000, nothing -> 0."""
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([\d.]+)\s*([kKmM]?)", 0)
    number = F.regexp_extract(found, r"[\d.]+", 0).try_cast("double")
    unit = F.lower(F.regexp_extract(found, "[kKmM]$", 0))
    return F.coalesce((number * F.when(unit == "k", 1000.0).when(unit == "m", 1000000.0).otherwise(1.0)).cast("bigint"), F.lit(0).cast("bigint"))


def url_id(c: Column) -> Column:
    """FN-05: the first 16 hex digits of the URL's MD5."""
    return F.substring(F.md5(c.cast("binary")), 1, 16)


def alert_id(url: Column, kind: Column) -> Column:
    return url_id(F.concat(url, F.lit("#stars-alert:"), kind))


def arxiv_id(c: Column) -> Column:
    """FN-06: the last part of the path, cut at its first "v"."""
    return F.substring_index(F.element_at(F.split(c, "/"), -1), "v", 1)


def arxiv_version(c: Column) -> Column:
    """The number behind a trailing "v", else null."""
    return F.regexp_extract(c, r"v(\d+)$", 1).try_cast("int")


def normalize_title(c: Column) -> Column:
    """FN-07: lower-case ASCII letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def titles_agree(a: Column, b: Column) -> Column:
    """JN-04's rule for one pair: normalised titles are equal or one contains the other; empty ones never agree."""
    x, y = F.coalesce(normalize_title(a), F.lit("")), F.coalesce(normalize_title(b), F.lit(""))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def parse_date_multi(c: Column, formats: Sequence[str], fallback: Column) -> Column:
    """FN-08: the first of the formats that fits, else the fallback."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], fallback)


#: Date forms of feeds.
FEED_FORMATS = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def feed_date(published: Column, updated: Column, created: Column, fallback: Column) -> Column:
    """FN-09: the first of three fields that is a date; without a zone it is UTC (the session's zone)."""
    tries = []
    for c in (published, updated, created):
        plain = F.regexp_replace(F.trim(c), "(?i)^[a-z]{3}, *", "")  # the weekday adds nothing and may be wrong
        tries += [F.try_to_timestamp(plain, F.lit(f.replace("EEE, ", ""))) for f in FEED_FORMATS]
    return F.coalesce(*tries, fallback)


def paper_text(title: Column, abstract: Column) -> Column:
    """FN-10 for papers: what an analyser reads."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")))


def news_text(title: Column, content: Column, summary: Column) -> Column:
    """FN-10 for news: the first non-empty of content and summary."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nContent: "), F.coalesce(text_or_null(content), text_or_null(summary), F.lit("No content")))


def report_date(ts: Column) -> Column:
    """FN-11: the Asia/Shanghai date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Shanghai"))


def first_number(c: Column) -> Column:
    """FN-12: the first signed decimal of a text, else null."""
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def epoch_ms(first: Column, second: Column, fallback: Column) -> Column:
    """FN-13: the first of two millisecond epochs that is there and not 0, else the fallback."""
    pick = F.coalesce(F.nullif(first.try_cast("bigint"), F.lit(0).cast("bigint")), F.nullif(second.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.coalesce(F.timestamp_millis(pick), fallback)


REQUEST = r"(?i)^\[Analysis\]\s*(\d+\.\d+)(?:v\d+)?:\s*(.+)"


def parse_request_title(c: Column) -> Column:
    """FN-14: struct(id, title) of "[Analysis] 2501.12345v2: Title", the id without its version; both null where the form does not fit."""
    return F.struct(text_or_null(F.regexp_extract(c, REQUEST, 1)).alias("id"), text_or_null(F.trim(F.regexp_extract(c, REQUEST, 2))).alias("title"))


def report_digest(c: Column, n: int = 500) -> Column:
    """FN-15: struct(title, summary) of Markdown: the first "# " line; other lines that are neither headings nor blank, cut."""
    lines = F.transform(F.split(c, "\n"), strip)
    title = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    body = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), " ")
    return F.struct(strip(F.substring(title, F.lit(3), F.char_length(title))).alias("title"), truncate(body, n).alias("summary"))


NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(.*)$"


def heading_parts(c: Column) -> Column:
    """FN-16: struct(number, title) of a heading; white space is collapsed."""
    text = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    number = text_or_null(F.regexp_extract(text, NUMBERED, 1))
    return F.struct(number.alias("number"), F.when(number.isNull(), text).otherwise(F.coalesce(text_or_null(F.regexp_extract(text, NUMBERED, 2)), text)).alias("title"))


def absolute_url(base: Column, url: Column) -> Column:
    """FN-17: the site's root in front of a URL that starts with a slash."""
    return F.when(url.startswith("/"), F.concat(F.regexp_replace(base, "/+$", ""), url)).otherwise(url)


def paper_urls(paper_id: Column) -> Column:
    """struct(abs_url, pdf_url) of a paper id."""
    site = F.lit("https://arxiv.org/")
    return F.struct(F.concat(site, F.lit("abs/"), paper_id).alias("abs_url"), F.concat(site, F.lit("pdf/"), paper_id, F.lit(".pdf")).alias("pdf_url"))


def repo_text(name: Column, url: Column, description: Column, language: Column, stars: Column, weekly: Column) -> Column:
    """FN-18: the metadata block of a repository."""
    either = lambda c, other: F.coalesce(text_or_null(c), F.lit(other))
    parts = (("Repository: ", name), ("URL: ", url), ("Description: ", either(description, "No description")), ("Language: ", either(language, "Unknown")), ("Stars: ", stars.cast("string")), ("Weekly stars: ", weekly.cast("string")))
    return F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in parts])


#: Titles and first lines of star alerts.
ALERTS = {
    "double_in_7_days": ("stars doubled within 7 days", "Star growth alert: stars doubled within 7 days."),
    "ten_x_stars": ("stars reached 10x baseline", "Star growth alert: stars reached 10x the first tracked count."),
}


def alert_text(kind: Column, name: Column, block: Column, readme: Column) -> Column:
    """struct(title, summary, content) of a star alert."""
    title, text = F.lit("star growth alert"), F.lit("Star growth alert.")
    for k, (a, b) in ALERTS.items():
        title, text = F.when(kind == k, F.lit(a)).otherwise(title), F.when(kind == k, F.lit(b)).otherwise(text)
    summary = F.concat_ws("\n", text, block)
    content = F.when(text_or_null(readme).isNull(), summary).otherwise(F.concat(summary, F.lit("\n\nREADME:\n"), readme))
    return F.struct(F.concat(F.lit("GitHub Trending Alert: "), name, F.lit(" "), title).alias("title"), summary.alias("summary"), content.alias("content"))
