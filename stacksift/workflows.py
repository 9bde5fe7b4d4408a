"""The daily jobs as a whole: papers, news and the report, each from its inputs to its day folders and trackers.

Every job takes DataFrames and a table of `daylog` and can be run again: what is already tracked is left out, what is
already in its day is merged by id, and days change in one commit at the end. A run may cover one day or years.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.functions import score
from stacksift.functions.text import alert_text, repo_text, report_date, strip, text_or_null, url_id
from stacksift.operators import aggregates, analyze, filters, joins, ranking, sets
from stacksift.sources import daylog
from stacksift.sources.staging import staging_folder, written_table

#: Columns of a tracked paper's or news item's row in its day.
PAPER = "id string, source string, title string, primary_category string, published timestamp, tracking_score double, analysis_status string, report_date string"
NEWS = "id string, title string, url string, source_name string, published timestamp, weight double, content string, analysis_status string, report_date string"


@dataclass(frozen=True)
class Signals:
    """Signal tables by paper_id, one row per paper: see enrich_signals."""

    s2: DataFrame
    code: DataFrame
    graph: DataFrame


@dataclass(frozen=True)
class Outcome:
    """What a job leaves: the table's commit, the tracker after it, and what it did not keep."""

    commit: daylog.Commit
    tracker: DataFrame
    rejected: DataFrame


def day_text(pattern: str = "yyyy-MM-dd") -> Column:
    """The folder of a row: its Asia/Shanghai day, or month where a run covers years."""
    return F.date_format(report_date(F.col("published")), pattern)


def merged_into_days(rows: DataFrame, path: str, schema: str) -> daylog.Commit:
    """Merges rows into their days by the keep-success rule; only these days are read and written."""
    spark = rows.sparkSession
    kind = T.StructType.fromDDL(schema)
    days = [daylog.folder_of(spark, r[0]) for r in rows.select(daylog.DAY).distinct().collect()]
    seen = daylog.latest(spark, path)
    if not days:
        return seen
    merged = joins.upsert_keep_success(daylog.read_days(spark, path, kind, days, seen), rows)
    return daylog.publish(merged.select(*[F.col(f.name).cast(f.dataType) for f in kind]), path, seen, days)


def track_papers(
    papers: DataFrame, reviews: DataFrame, tracker: DataFrame, signals: Signals, path: str, categories: Sequence[str], now: Column,
    hours: int = 25, min_score: float = 70.0, per_category: int = 10, total: int = 30, tracker_days: int = 30, order: str = "arrival", folder: str = "yyyy-MM-dd",
) -> Outcome:
    """W1: new papers of the feeds and of review sites, scored, capped per day and merged into their days.

    papers: rows of read_atom_papers with an arrival order; reviews: rows of read_review_notes; both may have a struct
    review. tracker: (kind, id, first_seen) of papers. Feed papers must be of a configured category and recent; review
    papers need not. Papers with a score are tracked from now on whether they are kept or not; those without one are
    tried again by a later run. Signals are joined and scores worked out once, in a table of the shared folder.
    folder: the pattern of a row's folder; caps are per day whatever it is.
    """
    known = sets.expire_seen(tracker, now, tracker_days)
    once = ranking.first_wins(papers, "id", order).drop(order)
    recent = filters.recent_papers(filters.target_categories(once, categories), now, hours)
    fresh = sets.union_sources(joins.drop_seen(recent, known), joins.drop_seen(reviews, known)).drop("batch")
    scored = score.scored(joins.enrich_signals(fresh, signals.s2, signals.code, signals.graph), now)
    rows = scored.select("id", "source", "title", "primary_category", "published", "tracking_score", "quality_reasons").withColumns({"day": report_date(F.col("published")), daylog.DAY: day_text(folder)})
    table = written_table(rows, staging_folder(papers.sparkSession, "scored"))
    kept = ranking.capped_top_k(table, min_score, per_category, total, "day")
    commit = merged_into_days(kept.drop("quality_reasons", "day"), path, PAPER)
    marked, _ = filters.markable_ids(table)
    return Outcome(commit, sets.mark_seen(known, marked, "papers", now), sets.rejected(table, kept))


def track_news(
    items: Sequence[DataFrame], details: DataFrame, observations: DataFrame, sources: DataFrame, tracker: DataFrame, path: str, now: Column,
    hours: int = 168, details_per_source: int = 10, tracker_days: int = 30, folder: str = "yyyy-MM-dd",
) -> Outcome:
    """W2: news of feeds, pages and star alerts, cleaned of repeats and merged into their days.

    items: batches (id, url, title, source_name, published, content, pos) in the order in which they count; the first
    of an id wins. details: (url, title, content) of detail pages, for the first items of each source. observations:
    those of star_alerts() with the columns of star_items(): a first sighting with a README and every alert is an item; a first
    sighting without one is kept in the state only. sources: (source_name, weight). Items without a date are kept.
    """
    known = sets.expire_seen(tracker, now, tracker_days)
    batches = sets.union_sources(*[b.select("id", "url", "title", "source_name", "published", "content", "pos") for b in (*items, star_items(ranking.star_alerts(observations)))])
    recent = filters.recent_news(batches, now, hours)
    once = ranking.first_wins(recent, "id", "batch", "pos", "url")
    fresh = joins.enrich_details(joins.drop_seen(once, known), details, details_per_source)
    weighed = joins.attach_source(fresh, sources).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = weighed.select("id", "title", "url", "source_name", "published", "weight", "content").withColumn(daylog.DAY, day_text(folder))
    table = written_table(rows, staging_folder(details.sparkSession, "news"))
    commit = merged_into_days(table, path, NEWS)
    return Outcome(commit, sets.mark_seen(known, table, "news", now), sets.rejected(batches, table))


def star_items(alerts: DataFrame) -> DataFrame:
    """News items of star_alerts() rows that also have name, url, description, language, weekly_stars and readme.

    A first sighting is an item if it has a README; an alert is one in any case, with an id of its own.
    """
    block = repo_text(*[F.col(c) for c in ("name", "url", "description", "language", "stars", "weekly_stars")])
    kinds = F.array_compact(F.array(F.when(F.col("is_new") & F.col("readme").isNotNull(), "new"), F.when(F.col("double_alert"), "double_in_7_days"), F.when(F.col("ten_x_alert"), "ten_x_stars")))
    each = alerts.withColumn("kind", F.explode(kinds))
    told, new = alert_text(F.col("kind"), F.col("name"), block, F.col("readme")), F.col("kind") == "new"
    return each.select(
        F.when(new, url_id(F.col("url"))).otherwise(url_id(F.concat("url", F.lit("#stars-alert:"), "kind"))).alias("id"),
        "url",
        F.when(new, F.concat("name", F.lit(" - GitHub Trending"))).otherwise(told["title"]).alias("title"),
        F.lit("GitHub Trending").alias("source_name"),
        F.col("observed_at").alias("published"),
        F.when(new, strip(F.concat(block, F.lit("\n\nREADME:\n"), "readme"))).otherwise(told["content"]).alias("content"),
        F.col("event_id").alias("pos"),
    )


@dataclass(frozen=True)
class Report:
    """The report's tables: rows after the analysis, daily statistics and their one-sentence summaries."""

    papers: DataFrame
    news: DataFrame
    stats: DataFrame
    summary: DataFrame


def daily_report(
    papers: DataFrame, news: DataFrame, analyzed: DataFrame, of_paper: Callable[[dict], dict], of_news: Callable[[dict], dict], now: datetime,
    min_score: float = 70.0, top: int = 10, concurrency: int | None = None,
) -> Report:
    """W3: what is not yet analysed goes through the analysers; then statistics, keywords and summaries of all days.

    papers: id, primary_category, tracking_score, published, analysis_status, tags, report_date; news: id, source_category,
    weight, published, analysis_status, analysis_category, keywords, content, report_date. of_paper gets such a row
    and returns {"tags": ..}; of_news returns {"category": .., "keywords": ..}. A row whose analyser raises is failed.
    analyzed: ids done before, which stay as they are; papers under min_score are not analysed. Results are written
    once before they are counted, so no row is analysed twice; of the rows only their ids come back with them.
    """
    spark = papers.sparkSession
    queue = written_table(joins.work_queue(papers, news, analyzed, min_score), staging_folder(spark, "queue"))
    asked = lambda df, kind: df.join(queue.where(F.col("kind") == kind).select("id"), "id", "left_semi")
    tagged = T.StructType.fromDDL("tags array<string>")
    sorted_out = T.StructType.fromDDL("category string, keywords array<string>")
    done = written_table(analyze.analyze(asked(papers, "paper").select(*[c for c in ("id", "primary_category", "title", "abstract") if c in papers.columns]), of_paper, tagged, now, concurrency, ["id"]), staging_folder(spark, "analysed-papers"))
    told = written_table(analyze.analyze(asked(news, "news").select(*[c for c in ("id", "doc_id", "title", "content", "summary") if c in news.columns]), of_news, sorted_out, now, concurrency, ["id"]), staging_folder(spark, "analysed-news"))
    result = lambda df, **more: df.select("id", "analysis_status", *[F.col(f"light_analysis.{v}").alias(k) for k, v in more.items()])
    p = joins.overlay_results(papers, papers.drop("analysis_status", "tags").join(result(done, tags="tags"), "id"))
    n = joins.overlay_results(news, news.drop("analysis_status", "analysis_category", "keywords").join(result(told, analysis_category="category", keywords="keywords"), "id"))
    words = aggregates.top_keywords(report_keywords(p, n), top)
    stats = aggregates.daily_stats(p, n, words)
    return Report(p, n, stats, aggregates.template_summary(stats))


def report_keywords(papers: DataFrame, news: DataFrame) -> DataFrame:
    """Tags of analysed papers, then keywords of analysed news, in report order: input of top_keywords()."""

    def of(df: DataFrame, order: list[Column], kind: int, words: str) -> DataFrame:
        done = df.where("analysis_status = 'success'")  # first in their day: the same ranks among themselves
        keys = ("id", "published", "tracking_score" if kind == 0 else "weight", "analysis_status", daylog.DAY, words)
        rows = ranking.ranked(done.select(*keys), order, daylog.DAY).where(text_or_null(F.array_join(words, "")).isNotNull())
        return rows.select(daylog.DAY, F.lit(kind).alias("kind_order"), F.col("rank_in_day").alias("rank"), F.col(words).alias("keywords"))

    return of(papers, ranking.paper_order(), 0, "tags").unionByName(of(news, ranking.news_order(), 1, "keywords"))
