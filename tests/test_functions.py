"""Golden and hand-made cases of column functions, scores and row rules."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stacksift.functions import score, text
from stacksift.operators import aggregates, filters, joins, ranking, sets


def one(spark, column, schema="x string", **values):
    df = spark.createDataFrame([tuple(values.values()) or (None,)], schema)
    return df.select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "want"), [("1,234", 1234), ("2.5k stars this week", 2500), ("1.2m", 1200000), ("no stars", 0), (None, 0), ("5 million", 5000000), ("12 minutes", 12000000)])
def test_parse_star_count(spark, given, want):
    assert one(spark, text.parse_star_count(F.col("x")), x=given) == want


@pytest.mark.parametrize(("given", "want"), [
    ("<p>a &amp; b</p><script>x<b></script>\r\n\n\n\nc", "a & b \n\nc"), ("&lt;b&gt;", "<b>"), ("", None), (None, None), ("<style>p{}</style>", None), ("a\t\t b\n   c", "a b\nc"),
])
def test_clean_html(spark, given, want):
    got = one(spark, text.clean_html(F.col("x")), x=given)
    assert got == (want.replace(" \n", "\n") if want else want)


def test_clean_html_with_closed_entities(spark):
    given = "<p>a &amp b &amp; c &ampx; &nosuch; &#65; &#x42; &#67 &quot</p>"
    assert one(spark, text.clean_html(F.col("x"), closed=True), x=given) == "a &amp b & c &ampx; &nosuch; A B &#67 &quot"
    assert one(spark, text.clean_html(F.col("x")), x=given) == 'a & b & c &x; &nosuch; A B C "'


def test_query_of_clean_html_equals_its_sql_on_open_entities(spark, tmp_path):
    import duckdb

    from stacksift.plans import catalog

    rows = [(0, "u", "<p>ver&amp Un &amp; x&amp"), (1, "u", "&quot a &quot;b&quot;"), (2, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.queries()["fn01_clean_html"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()["fn01_clean_html"]).fetchall())


def test_clean_readme(spark):
    given = "# Title\n\n```py\nx = 1\n```\n![badge](https://shields.io/x)\n[![badge](a)](b)\n- see [docs](https://d/e) and `code`\n> quote <b>bold</b>\n\n\n\nend"
    assert one(spark, text.clean_readme(F.col("x")), x=given) == "Title\n\nsee docs and code\nquote bold\n\nend"
    assert one(spark, text.clean_readme(F.col("x"), 20), x="y" * 100) == "y" * 20


def test_small_functions(spark):
    c = F.col("x")
    assert one(spark, text.truncate(c, 3), x="abcd") == "abc..." and one(spark, text.truncate(c, 4), x="abcd") == "abcd"
    assert one(spark, text.truncate(c, 4), x="") is None and one(spark, text.truncate(c, 0), x="a") is None
    assert one(spark, text.arxiv_id(c), x="http://arxiv.org/abs/cs/0501001v1") == "0501001"
    assert one(spark, text.arxiv_version(c), x="http://arxiv.org/abs/2501.1v12") == 12 and one(spark, text.arxiv_version(c), x="2501.1") is None
    assert one(spark, text.first_number(c), x="8: strong -2") == 8.0 and one(spark, text.first_number(c), x="none") is None
    assert one(spark, text.parse_request_title(c), x="[analysis] 2501.12345v2: A title ") == Row(id="2501.12345", title="A title")
    assert one(spark, text.parse_request_title(c), x="x [Analysis] 2501.12345: T") == Row(id=None, title=None)
    assert one(spark, text.heading_parts(c), x=" 3.2   Network ") == Row(number="3.2", title="Network")
    assert one(spark, text.heading_parts(c), x="References") == Row(number=None, title="References")
    assert one(spark, text.report_digest(c, 5), x="# T\n\n## x\nab\ncd ef") == Row(title="T", summary="ab cd...")
    for fmt, day in (("January 5, 2024", 5), ("Jan 7, 2024", 7), ("2024年1月9日", 9)):
        assert one(spark, text.parse_date_multi(c, ["MMMM d, yyyy", "MMM d, yyyy", "yyyy年M月d日"], F.lit(None).cast("timestamp")), x=fmt) == datetime(2024, 1, day)
    none = F.lit(None).cast("string")
    assert one(spark, text.feed_date(c, none, none, F.lit(None).cast("timestamp")), x="Wed, 15 Jan 2025 10:30:00 +0100") == datetime(2025, 1, 15, 9, 30)


@pytest.mark.parametrize(("given", "want"), [("2026-06-30 15:59:00", date(2026, 6, 30)), ("2026-06-30 16:00:00", date(2026, 7, 1))])
def test_report_date(spark, given, want):
    assert one(spark, text.report_date(F.col("x").cast("timestamp")), x=given) == want


def papers(spark, rows):
    return spark.createDataFrame([(i, c, s, datetime(2024, 1, 1, i_)) for i_, (i, c, s) in enumerate(rows)], "id string, primary_category string, tracking_score double, published timestamp")


def test_gate_and_caps(spark):
    p = papers(spark, [("a", "x", 75.0), ("b", "x", 69.9), ("c", "x", None), ("d", "x", 70.0)])
    assert {r.id for r in filters.score_gate(p).collect()} == {"a", "d"} and filters.score_gate(p, enabled=False).count() == 0
    assert {r.id for r in ranking.capped_top_k(p).collect()} == {"a", "d"}
    q = papers(spark, [("a", "x", 95.0), ("b", "x", 85.0), ("c", "y", 75.0)])
    assert {r.id for r in ranking.capped_top_k(q, total=2).collect()} == {"a", "b"}
    kept = ranking.capped_top_k(q, per_category=1)
    assert {r.id for r in kept.collect()} == {"a", "c"} and {r.id for r in sets.rejected(q, kept).collect()} == {"b"}
    assert ranking.capped_top_k(q, per_category=0, total=0).count() == 3


def test_star_alerts(spark):
    def run(*points):
        rows = [(k, "r", datetime(2024, 1, d), s) for k, (d, s) in enumerate(points)]
        found = ranking.star_alerts(spark.createDataFrame(rows, "event_id long, repo_id string, observed_at timestamp, stars long")).orderBy("event_id").collect()
        return [(r.is_new, r.double_alert, r.ten_x_alert) for r in found]

    assert run((1, 1200), (7, 2400), (8, 2500)) == [(True, False, False), (False, True, False), (False, False, False)]
    assert run((1, 1200), (9, 2400)) == [(True, False, False), (False, False, False)]
    assert run((1, 1200), (31, 12000)) == [(True, False, False), (False, False, True)]
    assert run((1, 1200), (2, 1300)) == [(True, False, False), (False, False, False)]
    assert run((1, 100), (8, 1000)) == [(True, False, False), (False, True, True)]


def test_upsert_in_all_states(spark):
    old = spark.createDataFrame([("a", "old", "success", "A"), ("b", "old", "failed", "B"), ("c", "old", "pending", None)], "id string, title string, analysis_status string, light_analysis string")
    new = spark.createDataFrame([("a", "new", 1), ("b", "mid", 2), ("b", "new", 3), ("d", "new", 4)], "id string, title string, n int")
    got = {r.id: (r.title, r.analysis_status, r.light_analysis) for r in joins.upsert_keep_success(old, new, "n").collect()}
    assert got == {"a": ("old", "success", "A"), "b": ("new", "failed", "B"), "c": ("old", "pending", None), "d": ("new", "pending", None)}


def test_title_match_equals_brute_force(spark):
    import random
    import re

    rng = random.Random(5)
    title = lambda: " ".join(rng.choice(["a", "net", "deep", "of", "Nets", "x-ray", "learning", ""]) for _ in range(rng.randint(0, 5)))
    a, b = [(i, title()) for i in range(120)], [(i, title()) for i in range(120)]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    want = {(i, j, norm(s) == norm(t)) for i, s in a for j, t in b if norm(s) and norm(t) and (norm(s) in norm(t) or norm(t) in norm(s))}
    found = joins.title_match(spark.createDataFrame(a, "id int, title string"), spark.createDataFrame(b, "work_id int, title string")).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_validate_rows(spark):
    df = spark.createDataFrame([(3, 50.0, "success"), (5, None, "failed"), (2, 101.0, "odd"), (6, 0.0, None)], "n int, quality_score double, analysis_status string")
    tagged = df.withColumn("tags", F.expr("transform(sequence(1, n), i -> 't')")).withColumn("keywords", F.array())
    assert [r.violations for r in filters.validate_rows(tagged).orderBy("n").collect()] == [["tags", "quality_score", "analysis_status"], [], [], ["tags"]]


SIGNALS = "id string, sources array<string>, review struct<decision: string, rating_avg: double>, s2 struct<citation_count: int, influential_citation_count: int, venue: string, publication_types: array<string>>, code struct<max_stars: int, any_official: boolean, repos: int>, graph struct<cited_by_count: int, institutions: array<string>, source: string>, published timestamp"


def test_score_ladder(spark):
    at = datetime(2024, 1, 1)
    rows = [
        ("none", [], None, None, None, None, at),
        ("oral", ["s"], ("Accept (oral)", 3.0), None, None, None, at),
        ("rating", ["s"], ("Reject", 6.5), None, None, None, at),
        ("venue", ["s", "o"], None, (0, 0, "Proc. of NeurIPS", []), None, None, at),
        ("conference", ["s"], None, (3, 1, None, ["Conference"]), None, None, at),
        ("code", ["p"], None, None, (1000, True, 2), None, at),
        ("norepo", ["p"], None, None, (None, None, 0), None, at),
        ("mit", ["o", "p", "s"], None, None, None, (9, ["Smith College"], None), at),
    ]
    got = {r.id: r for r in score.scored(spark.createDataFrame(rows, SIGNALS), F.lit(datetime(2024, 1, 31)).cast("timestamp")).collect()}
    assert got["none"].tracking_score is None and got["none"].quality_reasons == ["external quality signals unavailable"] and got["none"].quality_confidence == "low"
    assert got["oral"].venue_score == 100 and got["oral"].tracking_score == 90.0
    assert got["rating"].venue_score == 65 and got["venue"].venue_score == 85 and got["venue"].tracking_score == 75.0
    assert got["conference"].venue_score == 55 and got["conference"].quality_reasons[:3] == ["conference publication signal", "citations: 3", "influential citations: 1"]
    assert got["code"].code_score == 100 and got["code"].tracking_score == 72.0 and got["norepo"].code_score == 0
    assert got["mit"].institution_score == 75 and got["mit"].metadata_score == 100 and got["mit"].quality_confidence == "high"


def test_final_score_rounds_halves_of_sums(spark):
    import duckdb

    rows = [(float(v), float(c), float(s), float(i), float(m)) for v in (0, 52, 55, 63) for c in (0, 70, 80, 85) for s in (0.0, 12.5, 17.25, 50) for i in (0, 75) for m in (40, 70, 100)]
    df = spark.createDataFrame(rows, "v double, c double, s double, i double, m double")
    got = df.select(*df.columns, score.final_score(*[F.col(k) for k in df.columns], F.array(F.lit("x"))).alias("y")).collect()
    con = duckdb.connect()
    want = {r: con.execute("SELECT round(0.30::DOUBLE * ? + 0.20::DOUBLE * ? + 0.20::DOUBLE * ? + 0.15::DOUBLE * ? + 0.15::DOUBLE * ?, 1)", r).fetchone()[0] for r in rows}
    assert {tuple(r)[:5]: r.y for r in got} == want


def test_keywords_are_counted_without_a_sort(spark):
    """Words are counted in a hash table; ties go by kind, rank and place, each compared as a number."""
    big = 2**31 - 1
    rows = [("d", 1, 1, ["n", "w"]), ("d", 0, big, ["p", "q"]), ("d", 0, 10, ["b", "a"]), ("d", 0, 9, ["c"]), (None, 1, big, ["z"]), ("d", 1, 2, None), ("d", 1, 3, ["w", "n"])]
    found = aggregates.top_keywords(spark.createDataFrame(rows, "report_date string, kind_order int, rank int, keywords array<string>"), 6)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.keyword, r.n) for r in sorted(found.where("report_date = 'd'").collect(), key=lambda r: r.place)] == [("n", 2), ("w", 2), ("c", 1), ("b", 1), ("a", 1), ("p", 1)]
    assert [(r.keyword, r.place) for r in found.where("report_date is null").collect()] == [("z", 1)]


def test_contexts_are_not_joined_to_days(spark):
    """A day's context is never in one task: no shuffle by day alone. News of other days are left out; a null day counts."""
    news = spark.createDataFrame([("d", r, f"t{r}", "s", "x", "c") for r in range(1, 402)] + [(None, 1, "n", "s", "x", "c"), ("other", 1, "o", "s", "x", "c")], "report_date string, rank int, title string, source_name string, summary string, category string")
    days = spark.createDataFrame([("d",), ("d",), (None,), ("e",)], "report_date string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = aggregates.news_context(news, days)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.report_date, r.chunk): r.context for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(got) == {("d", 0), ("d", 1), ("d", 2), (None, 0), ("e", 0)} and got["e", 0] == "今日暂无重大热点新闻。"
    assert got["d", 2].startswith("Title: t401\n") and got["d", 0].count("\n---\n") == 199 and got[None, 0] == "Title: n\nSource: s\nSummary: x\nCategory: c\n"
