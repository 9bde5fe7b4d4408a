"""Daily statistics, keyword ranks, roll-ups and text contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksift.functions.text import first_number, text_or_null


def dataset_index(rows: DataFrame) -> DataFrame:
    """SRC-08: (dataset, dates newest first, n_days, last_updated) from (dataset, report_date)."""
    days = rows.groupBy("dataset", "report_date").agg(F.count("*").alias("n"))
    return days.groupBy("dataset").agg(F.sort_array(F.collect_list("report_date"), asc=False).alias("dates"), F.count("*").alias("n_days"), F.max("report_date").alias("last_updated"))


def papers_by_category(df: DataFrame) -> DataFrame:
    """AG-01: papers per day and primary category, whatever their status."""
    return df.groupBy("report_date", "primary_category").agg(F.count("*").alias("n"))


def effective_category() -> Column:
    """The analysis category where there is an analysis, else the source's."""
    return F.when(F.col("analysis_category").isNotNull(), F.col("analysis_category")).otherwise(F.col("source_category"))


def news_by_category(df: DataFrame) -> DataFrame:
    """AG-02: news per day and effective category."""
    return df.groupBy("report_date", effective_category().alias("category")).agg(F.count("*").alias("n"))


def top_keywords(rows: DataFrame, k: int = 10) -> DataFrame:
    """AG-03: the k most frequent keywords per day from (report_date, kind_order, rank, keywords).

    Ties go to the keyword that appears first in report order: papers (kind_order 0) before news (1), by
    rank, then by place in the list. Frequent keywords are counted before the shuffle. The place of appearance is one
    number, so that words are counted in a hash table of different ones and not sorted: rank and pos are below 2^31.
    """
    each = rows.select("report_date", "kind_order", "rank", F.posexplode("keywords").alias("pos", "keyword"))
    of = lambda c: F.col(c).cast("long")
    at = F.shiftleft(of("kind_order"), 62) + F.shiftleft(of("rank"), 31) + of("pos")
    counted = each.groupBy("report_date", "keyword").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    order = Window.partitionBy("report_date").orderBy(F.desc("n"), "first", "keyword")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("report_date", "keyword", "n", "place")


def daily_stats(papers: DataFrame, news: DataFrame, keywords: DataFrame) -> DataFrame:
    """AG-04: one row per day: totals, two maps of counts and the top keywords in order."""
    of = lambda df, key, name: df.groupBy("report_date").agg(F.sum("n").alias(f"total_{name}"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(f"{name}_by_category"))
    tops = keywords.groupBy("report_date").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("top_keywords"))
    joined = of(papers_by_category(papers), "primary_category", "papers").join(of(news_by_category(news), "category", "news"), "report_date", "full_outer").join(tops, "report_date", "left")
    return joined.withColumns({"total_papers": F.coalesce("total_papers", F.lit(0)), "total_news": F.coalesce("total_news", F.lit(0))})


def analysis_stats(df: DataFrame) -> DataFrame:
    """AG-05: (total, success, failed, success_rate); the rate of nothing is 1."""
    counted = df.agg(F.count("*").alias("total"), F.count_if(F.col("analysis_status") == "success").alias("success"), F.count_if(F.col("analysis_status") == "failed").alias("failed"))
    return counted.withColumn("success_rate", F.when(F.col("total") == 0, 1.0).otherwise(F.col("success") / F.col("total")))


def review_averages(replies: DataFrame) -> DataFrame:
    """AG-06: per forum, over official reviews: mean rating, mean confidence and the number of ratings that could be read."""
    reviews = replies.where(F.col("kind") == "Official_Review")
    rating = first_number(F.col("rating"))
    sure = first_number(F.col("confidence")) if "confidence" in replies.columns else F.lit(None).cast("double")
    return reviews.groupBy("forum_id").agg(F.avg(rating).alias("rating_avg"), F.avg(sure).alias("confidence_avg"), F.count(rating).alias("review_count"))


def first_decision(replies: DataFrame, *order: str) -> DataFrame:
    """AG-07: per forum, the first non-empty decision in reply order."""
    given = replies.where((F.col("kind") == "Decision") & text_or_null(F.col("decision")).isNotNull())
    return given.groupBy("forum_id").agg(F.min_by("decision", F.struct(*order)).alias("decision"))


def repo_rollup(repos: DataFrame) -> DataFrame:
    """AG-08: per paper: repos, max_stars, any_official and repo_list, all columns of its repositories by stars, most first."""
    listed = F.struct("stars", *[c for c in repos.columns if c not in ("paper_id", "stars")])
    return repos.groupBy("paper_id").agg(
        F.count("stars").alias("repos"), F.max("stars").alias("max_stars"), F.bool_or(F.coalesce("is_official", F.lit(False))).alias("any_official"), F.sort_array(F.collect_list(listed), asc=False).alias("repo_list")
    )


def sorted_name_sets(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """AG-09: per key, the sorted distinct names."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias(out))


def merged_names(*columns: str) -> Column:
    """AG-09 for lists inside a row: all names of several array columns, sorted and distinct."""
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*lists), lambda x: F.coalesce(x, F.lit("")) != "")))


def fulltext_stats(sections: DataFrame) -> DataFrame:
    """AG-10: per document: sections at all depths, paragraphs summed over sections, blocks, which is both, and html_chars where sections have it."""
    size = [F.max("html_chars").alias("html_chars")] if "html_chars" in sections.columns else []
    counted = sections.groupBy("paper_id").agg(F.count("*").alias("n_sections"), F.sum(F.size("paragraphs")).alias("n_paragraphs"), *size)
    return counted.select("paper_id", "n_sections", "n_paragraphs", (F.col("n_sections") + F.col("n_paragraphs")).alias("blocks"), *(["html_chars"] if size else []))


def outline_stats(outlines: DataFrame) -> DataFrame:
    """AG-10 from page_outlines(): spans are counted, paragraphs not looked at; pages that failed are left out."""
    summed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    counted = outlines.where("not failed").select("page_id", F.size("spans").cast("long").alias("n_sections"), summed.alias("n_paragraphs"), "html_chars")
    return counted.withColumn("blocks", F.col("n_sections") + F.col("n_paragraphs"))


#: Ranks per chunk of a context: a hot day then is several rows, none of which grows with the day.
CHUNK = 200


def category_context(papers: DataFrame) -> DataFrame:
    """AG-11: per day, category and chunk of ranks, the blocks of analysed papers in report order.

    papers: report_date, primary_category, rank, title, id, overview, tags. Categories are the configured ones already.
    Chunks joined in order by the same separator are the whole context.
    """
    block = F.concat(F.lit("Title: "), "title", F.lit("\nID: "), "id", F.lit("\nOverview: "), "overview", F.lit("\nTags: "), F.array_join("tags", ", "), F.lit("\n"))
    return joined_blocks(papers.select("report_date", "primary_category", "rank", block.alias("block")), ["report_date", "primary_category"])


def news_context(news: DataFrame, days: DataFrame) -> DataFrame:
    """AG-12: per day and chunk of ranks, the blocks of analysed news; chunk 0 with a fixed text on days without news.

    Contexts are not joined to days, which would put a day's whole context in one task: news of other days are left out
    before they are put together, and days without news are added. The days, one row each, are broadcast.
    """
    block = F.concat(F.lit("Title: "), "title", F.lit("\nSource: "), "source_name", F.lit("\nSummary: "), "summary", F.lit("\nCategory: "), "category", F.lit("\n"))
    wanted, told = days.select("report_date").distinct(), news.select(F.col("report_date").alias("day")).distinct()
    same = F.col("report_date").eqNullSafe(F.col("day"))
    listed = news.join(F.broadcast(wanted.withColumnRenamed("report_date", "day")), same, "left_semi")
    made = joined_blocks(listed.select("report_date", "rank", block.alias("block")), ["report_date"])
    empty = wanted.join(F.broadcast(told), same, "left_anti").select("report_date", F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("string").alias("context"))
    return made.unionByName(empty).withColumn("context", F.coalesce("context", F.lit("今日暂无重大热点新闻。")))


def joined_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    found = rows.groupBy(*keys, F.expr(f"cast((rank - 1) div {CHUNK} as bigint)").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return found.select(*keys, "chunk", F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n").alias("context"))


def activity_trend(papers: DataFrame, news: DataFrame, last: Column, days: int = 7) -> DataFrame:
    """AG-13: analysed papers and news of the last days, zeros where there are none."""
    spark = papers.sparkSession
    calendar = spark.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("report_date"))
    count = lambda df, name: df.where("analysis_status = 'success'").groupBy("report_date").agg(F.count("*").alias(name))
    return calendar.join(count(papers, "papers"), "report_date", "left").join(count(news, "news"), "report_date", "left").fillna(0, ["papers", "news"])


def coverage(rows: DataFrame) -> DataFrame:
    """AG-14: days per dataset and last update from (dataset, report_date)."""
    return rows.groupBy("dataset").agg(F.countDistinct("report_date").alias("n_days"), F.max("report_date").alias("last_updated"))


def fulltext_context(sections: DataFrame, front: DataFrame, max_chars: int = 20000) -> DataFrame:
    """AG-15: (paper_id, context): up to 10 front paragraphs, then each heading with its first 5 paragraphs in tree order; cut with a marker.

    sections: paper_id, sec_idx, heading, paragraphs; front: paper_id, paragraphs.
    """
    empty = F.lit("")
    body = F.concat(F.array(F.concat(F.lit("## "), "heading")), F.slice("paragraphs", 1, 5), F.array(empty))
    parts = sections.select("paper_id", F.col("sec_idx").alias("at"), F.array_join(body, "\n").alias("part"))
    spaced = F.flatten(F.transform(F.slice("paragraphs", 1, 10), lambda p: F.array(p, empty)))
    lead = front.where(F.size("paragraphs") > 0).select("paper_id", F.lit(-1).alias("at"), F.array_join(F.concat(F.array(F.lit("## Front Matter\n")), spaced), "\n").alias("part"))
    whole = parts.unionByName(lead).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    text = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["part"]), "\n"), r"(?U)^\s+|\s+$", "")
    made = whole.select("paper_id", text.alias("t"))
    cut = F.concat(F.substring("t", 1, max_chars), F.lit("\n\n...(内容已截断)"))
    return made.select("paper_id", F.when(F.char_length("t") > max_chars, cut).otherwise(F.col("t")).alias("context"))


def fetch_accounting(batch: DataFrame, tracker: DataFrame) -> DataFrame:
    """AG-16: per source: fetched rows, different ids, ids seen before and new ids."""
    once = batch.groupBy("source_name", "id").agg(F.count("*").alias("copies"))
    marked = once.join(tracker.select("id", F.lit(1).alias("hit")).dropDuplicates(["id"]), "id", "left")
    return marked.groupBy("source_name").agg(F.sum("copies").alias("fetched"), F.count("*").alias("unique_ids"), F.count("hit").alias("seen_before"), F.count_if(F.col("hit").isNull()).alias("new_ids"))


def latest_version(entries: DataFrame, key: Column, version: Column) -> DataFrame:
    """AG-17: per paper, the highest version and its row; entries without a version come before version 1."""
    rows = entries.withColumn("paper_id", key).withColumn("version", F.coalesce(version, F.lit(0)))
    return rows.groupBy("paper_id").agg(F.max("version").alias("version"), F.max_by(F.struct(*entries.columns), F.struct("version", *entries.columns)).alias("entry"))


def template_summary(stats: DataFrame) -> DataFrame:
    """SO-07: one sentence per day from daily_stats(): totals, five categories by count (ties: by name), five keywords."""
    entries = F.array_sort(F.transform(F.map_entries("papers_by_category"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    listed = lambda a: F.coalesce(text_or_null(F.array_join(F.slice(a, 1, 5), "、")), F.lit("无"))
    text = F.concat(
        F.lit("今日共收录 "), F.col("total_papers").cast("string"), F.lit(" 篇论文，"), F.col("total_news").cast("string"), F.lit(" 条热点资讯。热门领域："),
        listed(F.transform(entries, lambda e: e["k"])), F.lit("。热门关键词："), listed(F.col("top_keywords")), F.lit("。"),
    )
    return stats.select("report_date", text.alias("summary"))
