"""Files, pages, analysers and streams."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.operators import aggregates, analyze, ranking, sections
from stacksift.sources import feeds, records
from stacksift.streaming import jobs

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())])


def test_read_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "title": "x"}, {"title": "no id"}, {"id": "2"}]))
    (tmp_path / "b.json").write_text("[{broken")
    (tmp_path / "c.json").write_text(json.dumps({"title": "an object"}))
    (tmp_path / "d.jsonl").write_text('{"id": "3"}\n{broken\n\n{"id": ""}\n')
    assert sorted(r.id for r in records.read_records(spark, str(tmp_path), SCHEMA).collect()) == ["1", "2", "3"]
    assert records.read_records(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_large_arrays_are_read_by_several_tasks(spark, tmp_path):
    odd = ['}', '\n  },\n  {\n', '],', '"', "é\\", "", None]
    rows = [{"id": str(k), "title": odd[k % 7], "extra": {"a": [{"b": k}]}} for k in range(9000)]
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "big.json").write_text(json.dumps(rows, indent=2))
    (folder / "small.json").write_text(json.dumps([{"id": "s", "title": "x"}], indent=2, ensure_ascii=False) + "\n")
    (folder / "compact.json").write_text(json.dumps([{"id": "c1"}, {"id": "c2"}]))
    (folder / "empty.json").write_text("[]")
    (folder / "object.json").write_text(json.dumps({"title": "an object"}, indent=2))
    (folder / "cut.json").write_text(json.dumps([{"id": "x1"}, {"id": "x2"}, {"id": "x3"}], indent=2)[:-20])
    (folder / "broken.json").write_text(json.dumps([{"id": "y1"}, {"id": "y2"}], indent=2).replace('"y2"', '"y2'))
    (folder / "tail.json").write_text(json.dumps([{"id": "z1"}, {"id": "z2"}], indent=2) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = records.read_records(spark, str(folder), SCHEMA, large=True)
        big = records.array_pieces(spark, str(folder), SCHEMA, "big.json")
        assert big.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        found = {(r.id, r.title) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = {(r.id, r.title) for r in records.read_records(spark, str(folder), SCHEMA).collect()}
    assert {x for x in plain if x[0][0] not in "z"} == {x for x in found if x[0][0] not in "z"}
    assert len(found) >= 9003 and {x for x in found if x[0].isdigit()} == {(r["id"], r["title"]) for r in rows} and not {x for x in found if x[0][0] in "xy"}


@pytest.mark.parametrize("cut_from", [0, 1000, 1 << 24])
def test_small_arrays_are_not_cut(spark, tmp_path, monkeypatch, cut_from):
    for k in range(30):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"id": f"{k}-{i}", "title": "t" * 20} for i in range(2 if k % 2 else 40)], indent=2 if k % 3 else None))
    (tmp_path / "broken.json").write_text("[{broken")
    named = []
    read = records.whole_arrays
    monkeypatch.setattr(records, "whole_arrays", lambda spark, schema, paths, **options: named.extend(paths if isinstance(paths, list) else []) or read(spark, schema, paths, **options))
    got = sorted(r.id for r in records.read_records(spark, str(tmp_path), SCHEMA, large=True, cut_from=cut_from).collect())
    assert got == sorted(f"{k}-{i}" for k in range(30) for i in range(2 if k % 2 else 40))
    assert len(named) == {0: 11, 1000: 5, 1 << 24: 0}[cut_from]  # those in another layout, and the broken one


def test_src01_writes_few_files(spark):
    from stacksift.plans import catalog

    files = catalog.queries()["src01_read_records"](spark, "/root/testdata/sf0.01").inputFiles()
    assert len([f for f in files if f.endswith(".txt")]) < 10


def test_selectors_are_worked_out_once(monkeypatch):
    from stacksift.operators import htmltree

    tree = htmltree.parse("<main>" + "<p class='a b' id=x>t</p>" * 500 + "</main>")
    looked = []
    monkeypatch.setattr(htmltree, "PART", type("Counted", (), {"match": staticmethod(lambda part, match=htmltree.PART.match: looked.append(part) or match(part))}))
    assert len(htmltree.select(tree, "main p.b[id=x]")) == 500 and len(looked) <= 2


ATOM = """<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title>
<entry><id>http://arxiv.org/abs/2501.00001v1</id><title>A
 title</title><summary>Some
text</summary><author><name>A B</name></author><author><name>C D</name></author><published>2025-01-15T00:00:00Z</published>
<category term="cs.AI"/><category term="cs.CL"/><arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.CL"/></entry>
<entry><id>http://arxiv.org/abs/2501.00002v3</id><title>B</title><summary>t</summary><author><name>E</name></author><published>2025-01-16T00:00:00Z</published><updated>2025-01-17T00:00:00Z</updated><category term="cs.LG"/></entry></feed>"""


def test_read_atom_papers(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    a, b = feeds.read_atom_papers(spark, str(tmp_path)).orderBy("id").collect()
    assert (a.id, a.title, a.abstract, a.authors, a.primary_category) == ("2501.00001", "A  title", "Some text", ["A B", "C D"], "cs.CL")
    assert a.published == datetime(2025, 1, 15) and a.updated is None and a.pdf_url == "https://arxiv.org/pdf/2501.00001.pdf"
    assert b.primary_category == "cs.LG" and b.updated == datetime(2025, 1, 17)


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>F</title>
<item><title>One</title><link>https://e/1</link><description>&lt;p&gt;Hi &amp;amp; ho&lt;/p&gt;</description><pubDate>Wed, 15 Jan 2025 10:30:00 +0000</pubDate></item>
<item><title> </title><link>https://e/2</link></item><item><title>No link</title></item><item><title>Old</title><link>https://e/3</link><pubDate>soon</pubDate></item></channel></rss>"""


def test_read_rss_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    got = {r.title: r for r in feeds.read_rss_items(spark, str(tmp_path), {"name": "s", "category": "ai", "language": "en", "weight": 0.9}, now).collect()}
    assert set(got) == {"One", "Old"} and got["One"].summary == "Hi & ho" and got["One"].published == datetime(2025, 1, 15, 10, 30)
    assert got["Old"].published == datetime(2030, 1, 1) and len(got["One"].id) == 16


def test_read_sources(spark, tmp_path):
    rows = [dict(name="a", fetch_type="rss", rss_url="u", weight=0.5, enabled=True), dict(name="b", fetch_type="crawler", extractor="x"), dict(name="c", fetch_type="rss", weight=0.5), dict(name="d", fetch_type="rss", rss_url="u", weight=2.0), dict(name="e", fetch_type="rss", rss_url="u", enabled=False)]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    rss, crawled = records.read_sources(spark, str(tmp_path / "s.json"))
    assert [r.name for r in rss.collect()] == ["a"] and [r.name for r in crawled.collect()] == ["b"]


def note(forum, decision, **more):
    reply = lambda kind, **c: {"invitations": [f"v/-/{kind}"], "content": {k: {"value": v} for k, v in c.items()}}
    return json.dumps({"forum": forum, "content": {"title": {"value": "T"}, "abstract": "plain", "authors": {"value": ["A", "B"]}, **more}, "pdate": 0, "cdate": 1704067200000,
                       "details": {"replies": [reply("Official_Review", rating="8: good", confidence="4"), reply("Official_Review", rating="none"), reply("Decision", decision=decision)]}})


def test_read_review_notes(spark):
    rows = [(note("f1", "Accept (oral)"),), (note("f2", "Reject"),), (note("f3", "Accept", title={"value": ""}),)]
    got = records.read_review_notes(spark.createDataFrame(rows, "note string"), "ICLR", "cs.LG", F.lit(None).cast("timestamp")).collect()
    assert [r.id for r in got] == ["openreview:f1"] and got[0].authors == ["A", "B"] and got[0].published == datetime(2024, 1, 1)
    assert (got[0].review.rating_avg, got[0].review.confidence_avg, got[0].review.review_count) == (8.0, 4.0, 1)
    assert got[0].comment == "OpenReview venue: ICLR; decision: Accept (oral)"


def test_notes_are_taken_apart_once(spark):
    """Each note is made and parsed once, whatever is read of it; a bad reply leaves the others, and text is not taken for a wrapped value."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(text):
        made.add(1)
        return text

    replies = [None, "x", 5, {"invitations": "v/-/Decision", "content": {"decision": "no list"}}, {"invitations": ["v/-/Official_Review"], "content": {"rating": 7.5, "confidence": {"value": 3}}}, {"invitations": ["v/-/Decision"], "content": {"decision": '{"value": "Accept"}'}}]
    rows = [(json.dumps({"id": f"n{k}", "content": {"title": '{"value": "t"}', "abstract": {"value": True}, "authors": {"value": "one"}}, "details": {"replies": replies}}),) for k in range(20)] + [("{broken",), (None,)]
    accepting = spark.createDataFrame(rows, "note string").select(once(F.replace("note", F.lit('"{\\"value\\": \\"Accept\\"}"'), F.lit('"Accept"'))).alias("note"))
    got = records.read_review_notes(accepting, "V", "cs.LG", F.lit(None).cast("timestamp")).collect()
    assert len(got) == 20 and made.value == len(rows)
    assert {(r.title, r.abstract, r.authors[0], r.review.decision, r.review.rating_avg, r.review.confidence_avg, r.review.review_count) for r in got} == {('{"value": "t"}', "true", "one", "Accept", 7.5, 3.0, 1)}


def test_normalize_signals(spark):
    rows = [("1", "citation", json.dumps({"paperId": "x", "citationCount": None, "s2FieldsOfStudy": [{"category": "B"}], "fieldsOfStudy": ["A", "B"]})), ("2", "citation", json.dumps({"paperId": None})),
            ("1", "code", json.dumps({"results": [{"url": "u", "stars": None}, {"stars": 3}]})), ("1", "graph", json.dumps({"results": [{"id": "w", "cited_by_count": 2, "authorships": [{"institutions": [{"display_name": "Z"}, {"display_name": "A"}]}], "primary_topic": {"display_name": "t"}}, {"id": "other"}]})), ("3", "graph", json.dumps({"results": []}))]
    citation, code, graph = records.normalize_signals(spark.createDataFrame(rows, "paper_id string, kind string, payload string"))
    c = citation.collect()
    assert len(c) == 1 and c[0].citation_count == 0 and c[0].fields_of_study == ["A", "B"]
    assert [(r.url, r.stars) for r in code.collect()] == [("u", 0)]
    g = graph.collect()
    assert len(g) == 1 and g[0].work_id == "w" and g[0].institutions == ["A", "Z"] and g[0].topics == ["t"]


def test_write_daily_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    records.write_daily(spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, report_date string"), path)
    records.write_daily(spark.createDataFrame([("c", "2024-01-02")], "id string, report_date string"), path)
    assert {(r.id, str(r.report_date)) for r in spark.read.parquet(path).collect()} == {("a", "2024-01-01"), ("c", "2024-01-02")}


def card(path, stars, weekly, language=""):
    return f'<article class="Box-row x"><h2><a href="/{path}">{path}</a></h2><p>About {path}</p>{language}<a href="/{path}/stargazers">{stars}</a><span>{weekly} stars this week</span></article>'


def test_trending_rows(spark):
    html = "<html><body>" + card("own/Big", "1,234", "234", '<span itemprop="programmingLanguage">Python</span>') + card("own/edge", "1,000", "5") + card("own/big", "2,000", "9") + card("own/low", "5", "1") + card("own/low", "9k", "1") + "</body></html>"
    got = sections.trending_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.repo_id, r.stars, r.weekly_stars, r.language, r.url) for r in got] == [("own/big", 1234, 234, "Python", "https://github.com/own/Big")]


def test_listing_records(spark):
    html = '<div><a href="/research/a"><h3> Title A </h3><time>Jan 5, 2024</time><p>sum</p></a><a href="/research/a"><h3>Again</h3></a><a href="/other/b"><h3>B</h3></a><a href="/research/c"></a></div>'
    spec = [dict(source_name="s", base="a[href*='/']", title="h3, h2", url="", date="time, .date", summary="p", site="https://x.org", formats=["MMM d, yyyy"])]
    rules = spark.createDataFrame([("s", ["/research/"], False)], "source_name string, patterns array<string>, ignore_case boolean")
    got = sections.listing_records(spark.createDataFrame([(1, "s", html)], "page_id long, source_name string, html string"), spec, rules, datetime(2030, 1, 1)).collect()
    assert [(r.title, r.url, r.published, r.summary) for r in got] == [("Title A", "https://x.org/research/a", datetime(2024, 1, 5), "sum")]


PAGE = "<html><body><header><p>skip</p></header><main><p>Front</p><p> </p><h1>Top</h1><p>Second</p><h2>1 Intro</h2><p>a</p><h3>1.1 Deep</h3><p>b</p><h2>References</h2><p>c</p><h4>X</h4><p>d</p></main>" + " " * 1000 + "</body></html>"


def test_sections(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>short</p>"), (3, None)], "page_id long, html string")
    rows = sections.section_rows(pages).orderBy("page_id", "sec_idx").collect()
    got = [(r.sec_idx, r.parent_idx, r.level, r.number, r.title, r.paragraphs) for r in rows if not r.failed]
    assert got == [(0, None, 2, "1", "Intro", ["a", "b"]), (1, 0, 3, "1.1", "Deep", ["b"]), (2, None, 2, None, "References", ["c", "d"]), (3, 2, 4, None, "X", ["d"])]
    assert [r.page_id for r in rows if r.failed] == [2, 3]
    front = {r.page_id: r.paragraphs for r in sections.front_matter(pages).collect()}
    assert front == {1: ["Front", "Second"], 2: ["short"], 3: []}
    deep = sections.page_outlines(pages).where("page_id = 1").first()
    assert deep.paragraphs == ["Front", "Second", "a", "b", "c", "d"] and [(s["first"], s["last"]) for s in deep.spans] == [(2, 4), (3, 4), (4, 6), (5, 6)]
    assert [tuple(r) for r in aggregates.outline_stats(sections.page_outlines(pages)).select("page_id", "n_sections", "n_paragraphs", "blocks").collect()] == [(1, 4, 6, 10)]
    table = sections.section_rows(pages).where("not failed").withColumnRenamed("page_id", "paper_id")
    assert aggregates.fulltext_stats(table).collect()[0][1:4] == (4, 6, 10)
    assert aggregates.fulltext_stats(table).first().html_chars == len(next(p.html for p in pages.collect() if p.page_id == 1))
    lead = sections.front_matter(pages).withColumnRenamed("page_id", "paper_id")
    text = {r.paper_id: r.context for r in aggregates.fulltext_context(table, lead).collect()}[1]
    assert text == "## Front Matter\n\nFront\n\nSecond\n\n## 1 Intro\na\nb\n\n## 1.1 Deep\nb\n\n## References\nc\nd\n\n## X\nd"


def test_outline_of_deep_pages_is_linear(spark):
    """A thousand headings, each under the one before as far as ranks go: every paragraph is stored once."""
    html = "<main>" + "".join(f"<h{2 + k % 5}>{k}</h{2 + k % 5}><p>p{k}</p>" for k in range(1000)) + "</main>" + " " * 1000
    row = sections.page_outlines(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row.paragraphs == [f"p{k}" for k in range(1000)] and len(row.spans) == 1000
    for s in row.spans[:40]:
        k, level = s["sec_idx"], s["level"]
        end = next((j for j in range(k + 1, 1000) if 2 + j % 5 <= level), 1000)
        assert (s["first"], s["last"], level) == (k, end, 2 + k % 5)


def test_keyword_contexts(spark):
    rows = [(1, i, f"h{i}", ["Key " + "x" * 10 + " kEY"]) for i in range(7)] + [(2, 0, "h", ["none"])]
    got = sections.keyword_contexts(spark.createDataFrame(rows, "paper_id long, sec_idx int, heading string, paragraphs array<string>"), "key", around=4).orderBy("sec_idx").collect()
    assert len(got) == 5 and got[0].context == "Key xxx...\n\n---\n\n...xxx kEY"


def test_analyze_keeps_failures(spark):
    def fn(row):
        if row["id"] == "b":
            raise ValueError("bad")
        return {"n": len(row["text"])}

    df = spark.createDataFrame([("a", "xy"), ("b", ""), ("c", "z")], "id string, text string")
    got = {r.id: r for r in analyze.analyze(df, fn, T.StructType([T.StructField("n", T.LongType())]), datetime(2024, 1, 1), 2).collect()}
    assert got["a"].light_analysis.n == 2 and got["a"].analysis_status == "success" and got["a"].analyzed_at == datetime(2024, 1, 1)
    assert got["b"].light_analysis is None and got["b"].analysis_error == "ValueError: bad" and got["b"].analyzed_at is None


def finish(query):
    query.awaitTermination(180)
    assert not query.isActive and query.exception() is None


def test_stream_new_items_equal_batch(spark, tmp_path):
    rows = [(f"i{k % 5}", k, datetime(2024, 1, 1, k)) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, n long, first_seen timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.stream_new_items(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.id for r in ranking.first_wins(df, "id", "n").collect())


def test_stream_daily_counts_equal_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + k // 6, 4 * (k % 6)), f"c{k % 2}") for k in range(30)]
    df = spark.createDataFrame(rows, "published timestamp, category string")
    df.write.parquet(str(tmp_path / "in"))
    counted = jobs.stream_daily_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    finish(counted.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    from stacksift.functions.text import report_date

    want = df.groupBy(report_date(F.col("published")).alias("report_date"), "category").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in want.collect()}
