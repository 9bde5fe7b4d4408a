"""Files, feeds and pages: written by Spark from the tables, then read by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.operators import aggregates, sections
from stacksift.operators.batches import small_batches
from stacksift.plans.registry import Registry
from stacksift.plans.views import Inputs
from stacksift.sources import feeds, records
from stacksift.sources.staging import staging_folder

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
FALLBACK = "2000-01-01 00:00:00"


def text_files(x: Inputs, df: DataFrame, column: str = "value") -> str:
    """The folder of text files with one line per row."""
    path = staging_folder(x.spark, "files")
    df.select(F.col(column).alias("value")).write.text(path)
    return path


def xml_files(x: Inputs, df: DataFrame, root: str, row: str) -> str:
    path = staging_folder(x.spark, "xml")
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)
    return path


@R.add("src01_read_records", """SELECT id, CAST(tracking_score AS DOUBLE) AS tracking_score, title FROM f_paper
    WHERE CASE WHEN CAST(id AS BIGINT) // 500 % 2 = 0 THEN CAST(id AS BIGINT) % 5 <> 0 ELSE CAST(id AS BIGINT) // 100 % 7 <> 0 AND CAST(id AS BIGINT) % 9 <> 0 END""")
def src01(x):
    """Lines and arrays of up to a hundred thousand ids each, some of them broken, in one folder; the larger arrays are cut."""
    n = F.col("id").cast("bigint")
    record = F.to_json(F.struct(F.when(n % 9 != 0, F.col("id")).alias("id"), F.col("tracking_score").cast("double").alias("tracking_score"), "title"))
    spread = F.regexp_replace(F.regexp_replace(record, r"^\{", "{\n    "), r"\}$", "\n  }")  # as written with an indent; every third array is
    record = F.when(F.floor(n / 100) % 3 == 0, spread).otherwise(record)
    whole = F.to_json(F.struct("id", F.col("tracking_score").cast("double").alias("tracking_score"), "title"))
    papers, lines = x.view("f_paper"), F.floor(n / 500) % 2 == 0
    line = F.when(n % 10 == 0, F.to_json(F.struct(F.col("tracking_score").cast("double").alias("tracking_score")))).when(n % 5 == 0, "{broken").otherwise(whole)
    path = staging_folder(x.spark, "files")
    papers.where(lines).select(line.alias("value")).write.option("compression", "gzip").text(path)
    broken, laid = (F.floor(n / 100) % 7 == 0).alias("broken"), (F.floor(n / 100) % 3 == 0).alias("laid")
    arrays = papers.where(~lines).groupBy(F.floor(n / 100_000).alias("g"), broken, laid).agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list(record), ",\n  "), F.when(F.col("broken"), ", {broken").otherwise("\n]")).alias("value"))
    objects = papers.where(~lines).groupBy(F.floor(n / 100_000).alias("g")).agg(F.lit('{"title": "an object instead of an array"}').alias("value"))
    arrays.select("value").unionByName(objects.select("value")).write.option("maxRecordsPerFile", 1).mode("append").text(path)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("tracking_score", T.DoubleType()), T.StructField("title", T.StringType())])
    return records.read_records(x.spark, path, schema, arrays="*.txt", lines="*.txt.gz", large=True, cut_from=1 << 18)


@R.add("src02_read_atom_papers", """SELECT concat('2501.', id) AS id, title, concat('about ', source) AS abstract, concat('A ', id, ',B') AS authors, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN primary_category ELSE 'x.Y' END AS primary_category,
    published, updated, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN concat('pages ', id) END AS comment, concat('https://arxiv.org/abs/2501.', id) AS abs_url, concat('https://arxiv.org/pdf/2501.', id, '.pdf') AS pdf_url,
    concat('x.Y,', primary_category) AS categories FROM f_paper""")
def src02(x):
    term = lambda c: F.struct(c.alias("_term"))
    entry = x.view("f_paper").select(
        F.concat(F.lit("http://arxiv.org/abs/2501."), "id", F.lit("v2")).alias("id"), "title", F.concat(F.lit("about "), "source").alias("summary"), F.array(F.struct(F.concat(F.lit("A "), "id").alias("name")), F.struct(F.lit("B").alias("name"))).alias("author"),
        F.array(term(F.lit("x.Y")), term(F.col("primary_category"))).alias("category"), F.when(F.expr("cast(id as bigint) % 2 = 0"), term(F.col("primary_category"))).alias("primary_category"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"), F.expr("CASE cast(id as bigint) % 8 WHEN 0 THEN concat('pages ', id) WHEN 4 THEN concat('pages ', id) WHEN 1 THEN '' END").alias("comment"),
    )
    path = xml_files(x, entry, "feed", "entry")
    found = feeds.read_atom_papers(x.spark, path)
    return found.select("id", "title", "abstract", F.array_join("authors", ",").alias("authors"), "primary_category", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("published", "updated")], "comment", "abs_url", "pdf_url", F.array_join("categories", ",").alias("categories"))


@R.add("src03_read_rss_items", """SELECT id, id AS title, url, concat(source_name, ' & ', language) AS summary, CASE WHEN doc_id % 2 = 0 THEN concat('Full ', source_name, ' text') ELSE concat(source_name, ' & ', language) END AS content, coalesce(date_trunc('second', published), TIMESTAMP '2000-01-01') AS published FROM f_news WHERE doc_id % 9 <> 0""")
def src03(x):
    item = x.view("f_news").select(
        F.expr("CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE id END").alias("title"), F.col("url").alias("link"), F.format_string("<p>%s &amp; %s</p>", "source_name", "language").alias("description"), F.when(F.expr("doc_id % 2 = 0"), F.format_string("<b>Full</b> %s<script>x</script> text", "source_name")).alias("encoded"),
        F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss '+0000'").alias("pubDate"),
    )
    path = xml_files(x, item, "channel", "item")
    found = feeds.read_rss_items(x.spark, path, {"name": "s", "category": "ai", "language": "en", "weight": 1.0}, F.lit(FALLBACK).cast("timestamp"))
    return found.select("id", "title", "url", "summary", "content", F.col("published").cast("timestamp_ntz").alias("published"))


@R.add("src04_read_sources", "SELECT DISTINCT source AS name, CASE WHEN CAST(substring(source, 4) AS INT) % 2 = 0 THEN 'rss' ELSE 'crawler' END AS kind FROM documents WHERE CAST(substring(source, 4) AS INT) % 5 <> 0")
def src04(x):
    number = F.expr("cast(substring(source, 4) as int)")
    rows = x.table("documents").select("source", number.alias("n")).distinct()
    line = F.to_json(F.struct(F.col("source").alias("name"), F.expr("CASE WHEN n % 2 = 0 THEN 'rss' ELSE 'crawler' END").alias("fetch_type"), F.lit("u").alias("rss_url"), F.lit("e").alias("extractor"), F.expr("CASE WHEN n % 10 = 5 THEN 2.0 ELSE 0.5 END").alias("weight"), F.expr("n % 10 <> 0").alias("enabled")))
    # one array of all sources: a dimension, not data
    rss, crawled = records.read_sources(x.spark, text_files(x, rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(line), ","), F.lit("]")).alias("value"))))
    return rss.select("name", F.lit("rss").alias("kind")).unionByName(crawled.select("name", F.lit("crawler").alias("kind")))


@R.add("src05_read_review_notes", """SELECT concat('openreview:', forum_id) AS id, d.decision, rating_avg, coalesce(review_count, 0) AS review_count FROM (
    SELECT forum_id, arg_min(decision, (reply_pos, p1, p2, decision)) AS decision FROM f_reply WHERE kind = 'Decision' GROUP BY forum_id) d
    LEFT JOIN (SELECT forum_id, avg(CAST(split_part(rating, ':', 1) AS DOUBLE)) AS rating_avg, count(*) AS review_count FROM f_reply WHERE kind = 'Official_Review' GROUP BY forum_id) r USING (forum_id)
    WHERE starts_with(d.decision, 'Accept') AND CAST(forum_id AS BIGINT) % 7 <> 0""")
def src05(x):
    kind = "CASE e.kind WHEN 'Decision' THEN named_struct('decision', named_struct('value', e.decision), 'rating', null) ELSE named_struct('decision', null, 'rating', e.rating) END"
    reply = F.expr(f"transform(r, e -> named_struct('invitations', array(concat('v/-/', e.kind)), 'content', {kind}))")
    forums = x.view("f_reply").groupBy("forum_id").agg(F.sort_array(F.collect_list(F.struct("reply_pos", "p1", "p2", "decision", "kind", "rating"))).alias("r"))  # made into replies after the shuffle
    note = F.struct(F.col("forum_id").alias("forum"), F.struct(F.when(F.expr("cast(forum_id as bigint) % 7 <> 0"), F.lit("T")).alias("title"), F.lit("A").alias("abstract")).alias("content"), F.struct(reply.alias("replies")).alias("details"))
    found = records.read_review_notes(forums.select(F.to_json(note).alias("note")), "V", "cs.LG", F.lit(FALLBACK).cast("timestamp"))
    return found.select("id", "review.decision", "review.rating_avg", "review.review_count")


@R.add("src06_normalize_signals", """SELECT paper_id, coalesce(citation_count, -1) AS citation_count, coalesce(stars, -1) AS stars, coalesce(work_id, '-') AS work_id, coalesce(title, '-') AS title, coalesce(cited_by_count, -1) AS cited_by_count,
    coalesce(fwci, -1) AS fwci, coalesce(institutions, '-') AS institutions, coalesce(topics, '-') AS topics, coalesce(source, '-') AS source
    FROM (SELECT paper_id, citation_count FROM f_signal WHERE CAST(paper_id AS BIGINT) % 3 <> 0) FULL OUTER JOIN (SELECT paper_id, CAST(sum(stars) AS BIGINT) AS stars FROM f_repo WHERE stars % 4 <> 0 GROUP BY paper_id) USING (paper_id)
    FULL OUTER JOIN (SELECT paper_id, concat('W', paper_id) AS work_id, concat('Work ', paper_id) AS title, CASE WHEN CAST(paper_id AS BIGINT) % 5 = 0 THEN 0 ELSE count(*) END AS cited_by_count,
        CASE WHEN CAST(paper_id AS BIGINT) % 2 = 0 THEN CAST(paper_id AS BIGINT) / 2.0::DOUBLE END AS fwci, string_agg(DISTINCT institution, '|' ORDER BY institution) AS institutions,
        concat('Topic ', CAST(CAST(paper_id AS BIGINT) % 3 AS STRING), '|Z') AS topics, CASE WHEN CAST(paper_id AS BIGINT) % 11 = 0 THEN 'Proc. ICLR' END AS source FROM f_institution WHERE CAST(paper_id AS BIGINT) % 13 <> 0 GROUP BY paper_id) USING (paper_id)""")
def src06(x):
    cited = x.view("f_signal").select("paper_id", F.lit("citation").alias("kind"), F.to_json(F.struct(F.expr("CASE WHEN cast(paper_id as bigint) % 3 <> 0 THEN paper_id END").alias("paperId"), F.col("citation_count").alias("citationCount"))).alias("payload"))
    repo = F.struct(F.expr("CASE WHEN stars % 4 <> 0 THEN 'u' END").alias("url"), F.col("stars"))
    code = x.view("f_repo").groupBy("paper_id").agg(F.to_json(F.struct(F.collect_list(repo).alias("results"))).alias("payload")).select("paper_id", F.lit("code").alias("kind"), "payload")
    n, named = F.col("paper_id").cast("bigint"), lambda c: F.struct(c.alias("display_name"))
    places = x.view("f_institution").groupBy("paper_id").agg(F.count("*").alias("n"), F.collect_list(named(F.col("institution"))).alias("i"))
    first = F.struct(
        F.concat(F.lit("W"), "paper_id").alias("id"), F.concat(F.lit("Work "), "paper_id").alias("display_name"), F.when(n % 5 != 0, F.col("n")).alias("cited_by_count"), F.when(n % 2 == 0, n / 2).alias("fwci"),
        F.array(F.struct(F.slice("i", 1, 1).alias("institutions")), F.struct(F.col("i").alias("institutions"))).alias("authorships"), named(F.concat(F.lit("Topic "), (n % 3).cast("string"))).alias("primary_topic"),
        F.array(named(F.lit("Z")), named(F.concat(F.lit("Topic "), (n % 3).cast("string"))), named(F.lit(""))).alias("topics"), F.when(n % 11 == 0, F.struct(named(F.lit("Proc. ICLR")).alias("source"))).alias("primary_location"),
    )
    other = F.struct(F.lit("not the first").alias("id"), *[F.lit(None).cast(places.select(first.alias("f")).schema["f"].dataType[c].dataType).alias(c) for c in places.select(first.alias("f")).schema["f"].dataType.names[1:]])
    works = places.select("paper_id", F.lit("graph").alias("kind"), F.to_json(F.struct(F.when(n % 13 != 0, F.array(first, other)).otherwise(F.array_except(F.array(first), F.array(first))).alias("results"))).alias("payload"))
    citation, repos, graph = records.normalize_signals(cited.unionByName(code).unionByName(works))
    listed = graph.select("paper_id", "work_id", "title", F.col("cited_by_count").cast("bigint").alias("cited_by_count"), "fwci", F.array_join("institutions", "|").alias("institutions"), F.array_join("topics", "|").alias("topics"), "source")
    both = citation.select("paper_id", F.col("citation_count").cast("bigint").alias("citation_count")).join(repos.groupBy("paper_id").agg(F.sum("stars").alias("stars")), "paper_id", "full_outer")
    return both.join(listed, "paper_id", "full_outer").fillna(-1).fillna("-")


@R.add("src07_write_daily", """SELECT id, CAST(tracking_score AS DOUBLE) AS tracking_score, strftime(published, '%Y-%m') AS report_date FROM f_paper
    WHERE strftime(published, '%m') <> '06' OR CAST(id AS BIGINT) % 2 = 0""")
def src07(x):
    papers = x.view("f_paper").select("id", "tracking_score", F.date_format("published", "yyyy-MM").alias("report_date"))
    path = staging_folder(x.spark, "days")
    records.write_daily(papers.repartition("report_date"), path)
    records.write_daily(papers.where("substring(report_date, 6) = '06' and cast(id as bigint) % 2 = 0").repartition("report_date"), path)
    return x.spark.read.schema(papers.schema).parquet(path)


CARD = """concat('<article class="Box-row"><h2><a href="/', repo_id, '">x</a></h2><p>About ', event_id, '</p><a href="/', repo_id, '/stargazers">', stars, '</a><span>', stars % 50, ' stars this week</span></article>')"""


@R.add("tx01_trending_rows", """SELECT page_id, repo_id, stars, stars % 50 AS weekly_stars, concat('About ', CAST(event_id AS STRING)) AS description FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY event_id) AS rp FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, repo_id ORDER BY event_id) AS rn FROM (SELECT *, event_id // 60 AS page_id FROM f_observation)) WHERE rn = 1 AND stars > 1000) WHERE rp <= 3""")
def tx01(x):
    small_batches(x.spark)
    cards = x.view("f_observation").select(F.expr("event_id div 60").alias("page_id"), "event_id", F.expr(CARD).alias("card"))
    pages = cards.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "card"))).alias("c"))
    html = pages.select("page_id", F.array_join(F.transform("c", lambda c: c["card"]), "\n").alias("html"))
    return sections.trending_rows(html, 3).select("page_id", "repo_id", "stars", "weekly_stars", "description")


LINK = """concat('<a href="/p/', doc_id div 2, '"><h3> ', id, ' </h3><time>', date_format(published, 'MMM d, yyyy'), '</time><p>', source_name, '</p></a>')"""
SELECTORS = [
    {"source_name": "even", "base": "a[href*='/p/']", "title": "h3, h2", "url": "", "date": "time, .date", "summary": "p", "site": "https://x.example", "formats": ["MMM d, yyyy"]},
    {"source_name": "odd", "base": "div.item", "title": "h3", "url": "a", "date": "time", "summary": "p", "site": "https://y.example", "formats": ["yyyy", "MMM d, yyyy"]},
]


@R.add("tx02_listing_records", """SELECT page_id, source_name, substring(md5(url), 1, 16) AS id, title, url, published, summary FROM (SELECT doc_id // 20 AS page_id, CASE WHEN (doc_id // 20) % 2 = 0 THEN 'even' ELSE 'odd' END AS source_name, id AS title,
    concat(CASE WHEN (doc_id // 20) % 2 = 0 THEN 'https://x' ELSE 'https://y' END, '.example/p/', CAST(doc_id // 2 AS STRING)) AS url,
    coalesce(CAST(CAST(published AS DATE) AS TIMESTAMP), TIMESTAMP '2000-01-01') AS published, source_name AS summary FROM f_news WHERE doc_id % 2 = 0)
    WHERE source_name = 'even' OR contains(url, '/p/1') OR contains(url, '/p/3')""")
def tx02(x):
    """Pages of two sources: one whose items are links, one whose items hold a link and whose URLs must pass rules."""
    small_batches(x.spark)
    links = x.view("f_news").select(F.expr("doc_id div 20").alias("page_id"), "doc_id", F.expr(LINK).alias("link"))
    item = F.when(F.col("page_id") % 2 == 0, F.col("link")).otherwise(F.concat(F.lit("<div class='item x'>"), F.col("link"), F.lit("</div>")))
    pages = links.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("link")))).alias("c"))
    html = pages.select("page_id", F.expr("CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END").alias("source_name"), F.array_join(F.transform("c", lambda c: c["link"]), "\n").alias("html"))
    rules = x.spark.createDataFrame([("odd", ["/P/1", "/p/3"], True)], "source_name string, patterns array<string>, ignore_case boolean")
    found = sections.listing_records(html, SELECTORS, rules, datetime(2000, 1, 1))
    return found.select("page_id", "source_name", "id", "title", "url", F.col("published").cast("timestamp_ntz").alias("published"), "summary")


@R.add("ag15_fulltext_context", """SELECT paper_id, CASE WHEN length(t) > 20000 THEN concat(substring(t, 1, 20000), chr(10), chr(10), '...(内容已截断)') ELSE t END AS context FROM (
    SELECT paper_id, regexp_replace(string_agg(CASE WHEN doc_id % 4 = 0 THEN concat('## Front Matter', chr(10), chr(10), array_to_string(list_transform(string_split(text, chr(10))[1:10], lambda p: p || chr(10)), chr(10)))
        ELSE concat('## H', CAST(doc_id AS STRING), chr(10), array_to_string(string_split(text, chr(10))[1:5], chr(10)), chr(10)) END, chr(10) ORDER BY doc_id), '^\\s+|\\s+$', '', 'g') AS t
    FROM (SELECT *, doc_id // 4 AS paper_id FROM documents) GROUP BY paper_id)""")
def ag15(x):
    """Of four documents in a row, the first is a paper's front matter and the others are its sections."""
    rows = x.table("documents").select(F.expr("doc_id div 4").alias("paper_id"), F.col("doc_id").alias("sec_idx"), F.concat(F.lit("H"), "doc_id").alias("heading"), F.split("text", "\n").alias("paragraphs"))
    return aggregates.fulltext_context(rows.where("sec_idx % 4 <> 0"), rows.where("sec_idx % 4 = 0").select("paper_id", "paragraphs"))


# Pages that are made of the documents, so that SQL knows what is in them.
PARAGRAPHS = "list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '[\\s ]+', ' ', 'g'))), lambda p: p <> '')"


def made_pages(x: Inputs) -> DataFrame:
    """(page_id, html): of four documents in a row, the first stands before the first heading, the others are sections of levels 2 to 4."""
    small_batches(x.spark)
    body = F.concat(F.lit("<p>"), F.array_join(F.transform(F.split("text", "\n"), lambda p: F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))), "</p>\n<p>"), F.lit("</p>"))
    heading = F.expr("CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('<h', doc_id % 4 + 1, '>', doc_id % 4, '.1  Part <i>', doc_id, '</i></h', doc_id % 4 + 1, '>') END")
    parts = x.table("documents").select(F.expr("doc_id div 4").alias("page_id"), "doc_id", F.concat(heading, body).alias("part"))
    pages = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "part"))).alias("c"))
    filler = F.lit("<!-- " + "x" * 1000 + " -->")  # short pages count as failed
    return pages.select("page_id", F.concat(F.lit("<html><body><nav>menu</nav><article><h1>Page "), F.col("page_id").cast("string"), F.lit("</h1><time> Jan 2, 2024 </time>"), filler, F.array_join(F.transform("c", lambda c: c["part"]), "\n"), F.lit("</article></body></html>")).alias("html"))


SECTIONED = f"""SELECT *, doc_id // 4 AS page_id, doc_id % 4 AS level, {PARAGRAPHS} AS ps FROM documents"""


@R.add("tx03_fields_of_made_pages", f"""SELECT page_id, concat('Page ', CAST(page_id AS STRING)) AS title, 'Jan 2, 2024' AS date,
    trim(regexp_replace(concat('Page ', CAST(page_id AS STRING), ' Jan 2, 2024 ', string_agg(concat(CASE WHEN level > 0 THEN concat(CAST(level AS STRING), '.1 Part ', CAST(doc_id AS STRING), ' ') ELSE '' END, array_to_string(ps, ' ')), ' ' ORDER BY doc_id)), '\\s+', ' ', 'g')) AS content
    FROM ({SECTIONED}) GROUP BY page_id""")
def tx03_made(x):
    return sections.detail_fields(made_pages(x)).select("page_id", "title", "date", "content")


@R.add("tx04_sections_of_made_pages", f"""SELECT a.page_id, a.level - 1 AS sec_idx, CASE WHEN a.level > 1 THEN a.level - 2 ELSE -1 END AS parent_idx, a.level + 1 AS level, concat(CAST(a.level AS STRING), '.1') AS number, concat('Part ', CAST(a.doc_id AS STRING)) AS title,
    array_to_string(flatten(list(b.ps ORDER BY b.doc_id)), '|') AS paragraphs FROM ({SECTIONED}) a JOIN ({SECTIONED}) b ON a.page_id = b.page_id AND b.level >= a.level WHERE a.level > 0 GROUP BY a.page_id, a.level, a.doc_id""")
def tx04_made(x):
    found = sections.section_rows(made_pages(x)).where("not failed")
    return found.select("page_id", "sec_idx", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx"), "level", "number", "title", F.array_join("paragraphs", "|").alias("paragraphs"))


@R.add("ag10_outline_stats", f"""SELECT page_id, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS n_paragraphs, count(*) + CAST(sum(n) AS BIGINT) AS blocks FROM (SELECT a.page_id, a.doc_id, sum(len(b.ps)) AS n
    FROM ({SECTIONED}) a JOIN ({SECTIONED}) b ON a.page_id = b.page_id AND b.level >= a.level WHERE a.level > 0 GROUP BY a.page_id, a.doc_id) GROUP BY page_id""")
def ag10_outlines(x):
    return aggregates.outline_stats(sections.page_outlines(made_pages(x))).drop("html_chars")


@R.add("tx05_front_of_made_pages", f"SELECT page_id, array_to_string(ps[1:30], '|') AS front FROM ({SECTIONED}) WHERE level = 0")
def tx05_made(x):
    return sections.front_matter(made_pages(x)).select("page_id", F.array_join("paragraphs", "|").alias("front"))
