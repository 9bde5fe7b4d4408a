"""The daily jobs run again, fail on the way, and meet what is already there."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift import workflows
from stacksift.operators import analyze
from stacksift.sources import daylog

NOW = datetime(2024, 3, 2, 15, 0)


def papers(spark, rows):
    """rows: (id, category, hours ago, arrival, title)"""
    full = [(i, "arxiv", t, c, NOW - timedelta(hours=h), None, a, None) for i, c, h, a, t in rows]
    return spark.createDataFrame(full, "id string, source string, title string, primary_category string, published timestamp, updated timestamp, arrival int, review struct<decision: string, rating_avg: double>")


def signals(spark, cited, titles=None):
    s2 = spark.createDataFrame([(i, n, n, None, ["Conference"]) for i, n in cited.items()], "paper_id string, citation_count long, influential_citation_count long, venue string, publication_types array<string>")
    code = spark.createDataFrame([(i, 1, 50, True) for i in cited], "paper_id string, repos long, max_stars long, any_official boolean")
    graph = spark.createDataFrame([(i, t, 5, ["Google Research"], "NeurIPS") for i, t in (titles or {}).items()], "paper_id string, title string, cited_by_count long, institutions array<string>, source string")
    return workflows.Signals(s2, code, graph)


TRACKER = "kind string, id string, first_seen timestamp"


def day_rows(spark, path, schema=workflows.PAPER):
    return {r.id: r for r in daylog.read_days(spark, path, T.StructType.fromDDL(schema)).collect()}


def test_papers_are_tracked_once(spark, tmp_path):
    path = str(tmp_path / "papers")
    rows = [("a", "cs.AI", 1, 1, "first"), ("a", "cs.AI", 1, 2, "copy"), ("b", "cs.AI", 2, 3, "B"), ("old", "cs.AI", 60, 4, "O"), ("other", "math", 1, 5, "M"), ("seen", "cs.AI", 1, 6, "S"), ("unscored", "cs.AI", 1, 7, "U"), ("graph", "cs.AI", 3, 8, "A Graph Title"), ("wrong", "cs.AI", 3, 9, "Another Title")]
    tracker = spark.createDataFrame([("papers", "seen", NOW - timedelta(days=5)), ("papers", "b", NOW - timedelta(days=40))], TRACKER)
    found = signals(spark, {"a": 400, "b": 300, "old": 900, "other": 900, "seen": 900}, {"graph": "a graph title", "wrong": "something else", "a": "FIRST!"})
    reviews = papers(spark, [("openreview:r", "cs.CL", 9000, 1, "R")]).drop("arrival").withColumn("source", F.lit("openreview")).withColumn("review", F.struct(F.lit("Accept (oral)").alias("decision"), F.lit(8.0).alias("rating_avg")))
    done = workflows.track_papers(papers(spark, rows), reviews, tracker, found, path, ["cs.AI", "cs.CL"], F.lit(NOW), min_score=30.0)
    got = day_rows(spark, path)
    assert set(got) == {"a", "b", "graph"} and got["a"].title == "first" and got["a"].analysis_status == "pending" and got["b"].report_date == "2024-03-02"
    # b had expired from the tracker; papers without a signal, with the wrong title or a review only have no score and are tried again
    assert {r.id for r in done.tracker.collect()} == {"seen", "a", "b", "graph"} and {r.id for r in done.rejected.collect()} == {"unscored", "wrong", "openreview:r"}
    assert {r.id: r.first_seen for r in done.tracker.collect()}["seen"] == NOW - timedelta(days=5)
    again = workflows.track_papers(papers(spark, rows), reviews, done.tracker, found, path, ["cs.AI", "cs.CL"], F.lit(NOW), min_score=30.0)
    assert again.commit == done.commit and day_rows(spark, path) == got


def test_a_crash_in_the_merge_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "papers")
    tracker, found = spark.createDataFrame([], TRACKER), signals(spark, {"a": 400, "b": 300})
    first = papers(spark, [("a", "cs.AI", 1, 1, "A")])
    reviews = first.drop("arrival").limit(0)
    workflows.track_papers(first, reviews, tracker, found, path, ["cs.AI"], F.lit(NOW), min_score=1.0)
    done = spark.createDataFrame([("a", "arxiv", "done", "cs.AI", NOW, 99.0, "success", "2024-03-02")], workflows.PAPER)
    daylog.publish(done, path)
    run = lambda: workflows.track_papers(papers(spark, [("a", "cs.AI", 1, 1, "A2"), ("b", "cs.AI", 1, 2, "B")]), reviews, tracker, found, path, ["cs.AI"], F.lit(NOW), min_score=1.0)
    real = daylog.put
    monkeypatch.setattr(daylog, "put", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        run()
    assert set(day_rows(spark, path)) == {"a"}
    monkeypatch.setattr(daylog, "put", real)
    run()
    got = day_rows(spark, path)
    assert (got["a"].title, got["a"].analysis_status, got["b"].analysis_status) == ("done", "success", "pending")


def test_news_of_feeds_and_stars(spark, tmp_path):
    path = str(tmp_path / "news")
    batch = lambda rows: spark.createDataFrame(rows, "id string, url string, title string, source_name string, published timestamp, content string, pos long")
    ago = lambda h: NOW - timedelta(hours=h)
    feed = batch([("n1", "u1", "one", "s", ago(1), "c", 1), ("n2", "u2", "two", "s", None, "c", 2), ("n3", "u3", "late", "s", ago(900), "c", 3), ("n4", "u4", "seen", "s", ago(1), "c", 4)])
    pages = batch([("n1", "u1", "one again", "s", ago(1), "c", 1), ("n5", "u5", "five", "t", ago(2), "c", 2)])
    details = spark.createDataFrame([("u1", "", "full one"), ("u2", "Two!", ""), ("u5", "Five!", "full five")], "url string, title string, content string")
    star = lambda k, repo, h, n, readme: (k, repo, ago(h), n, repo, f"https://g/{repo}", None, "", 3, readme)
    seen = spark.createDataFrame([star(1, "o/a", 50, 100, "read"), star(2, "o/a", 20, 250, None), star(3, "o/b", 40, 10, None), star(4, "o/b", 30, 120, "r")], "event_id long, repo_id string, observed_at timestamp, stars long, name string, url string, description string, language string, weekly_stars long, readme string")
    sources = spark.createDataFrame([("s", 0.9)], "source_name string, weight double")
    tracker = spark.createDataFrame([("news", "n4", ago(30))], TRACKER)
    done = workflows.track_news([feed, pages], details, seen, sources, tracker, path, F.lit(NOW), details_per_source=1)
    got = {r.url + ("" if "Alert" not in r.title else r.title[-12:]): r for r in day_rows(spark, path, workflows.NEWS).values()}
    assert {k: (r.title, r.content) for k, r in got.items() if k in ("u1", "u2", "u5")} == {"u1": ("one", "full one"), "u2": ("two", "c"), "u5": ("Five!", "full five")}
    assert (got["u1"].weight, got["u5"].weight, got["u2"].report_date, got["u1"].report_date) == (0.9, 1.0, None, "2024-03-02")
    # o/a is new with a README, and doubles; o/b is new without one, so only its two alerts are told
    assert sorted(r.title for k, r in got.items() if k.startswith("https")) == ["GitHub Trending Alert: o/a stars doubled within 7 days", "GitHub Trending Alert: o/b stars doubled within 7 days", "GitHub Trending Alert: o/b stars reached 10x baseline", "o/a - GitHub Trending"]
    assert got["https://g/o/a"].content.endswith("README:\nread") and len(got) == 7 and done.tracker.count() == 8
    again = workflows.track_news([feed, pages], details, seen, sources, done.tracker, path, F.lit(NOW), details_per_source=1)
    assert again.commit == done.commit


def test_report_analyses_only_what_is_open(spark):
    day = datetime(2024, 3, 1).date()
    p = spark.createDataFrame([("a", "cs.AI", 90.0, NOW, "pending", None, day, "A"), ("b", "cs.AI", 10.0, NOW, "pending", None, day, "B"), ("c", "cs.CL", 80.0, NOW, "success", ["kept", "x"], day, "C"), ("d", "cs.CL", 80.0, NOW, "pending", None, day, "bad")],
                              "id string, primary_category string, tracking_score double, published timestamp, analysis_status string, tags array<string>, report_date date, title string")
    n = spark.createDataFrame([("n", "cat", 1.0, NOW, "pending", None, None, "text", day)], "id string, source_category string, weight double, published timestamp, analysis_status string, analysis_category string, keywords array<string>, content string, report_date date")

    def of_paper(row):
        if row["title"] == "bad":
            raise ValueError("bad")
        return {"tags": ["x", row["id"]]}

    report = workflows.daily_report(p, n, spark.createDataFrame([("c",)], "id string"), of_paper, lambda row: {"category": "k", "keywords": ["x"]}, NOW)
    assert {r.id: (r.analysis_status, r.tags) for r in report.papers.collect()} == {"a": ("success", ["x", "a"]), "b": ("pending", None), "c": ("success", ["kept", "x"]), "d": ("failed", None)}
    stats = report.stats.first()
    assert (stats.total_papers, stats.total_news, stats.news_by_category) == (4, 1, {"k": 1}) and stats.top_keywords == ["x", "a", "kept"]
    assert report.summary.first().summary == "今日共收录 4 篇论文，1 条热点资讯。热门领域：cs.AI、cs.CL。热门关键词：x、a、kept。"


def test_only_ids_come_back_from_the_analyser(spark):
    """A long text goes to the analyser and not back with its result."""
    df = spark.createDataFrame([("a", "some text"), ("b", None)], "id string, content string")
    found = analyze.analyze(df, lambda row: {"n": len(row["content"])}, workflows.T.StructType.fromDDL("n long"), NOW, keep=["id"])
    assert found.columns == ["id", "light_analysis", "analysis_status", "analysis_error", "analyzed_at"]
    assert {(r.id, r.light_analysis and r.light_analysis.n, r.analysis_status) for r in found.collect()} == {("a", 9, "success"), ("b", None, "failed")}
