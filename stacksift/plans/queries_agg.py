"""Aggregations and quality scores over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksift.functions import score
from stacksift.functions.text import first_number, normalize_title, report_date
from stacksift.operators import aggregates as agg
from stacksift.operators import joins, ranking
from stacksift.plans.queries_core import at, signals
from stacksift.plans.registry import Registry
from stacksift.plans.views import Inputs

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
NOW = "2002-01-01 00:00:00"
DAY = "CAST(published + INTERVAL 8 HOUR AS DATE)"


def papers(x: Inputs) -> DataFrame:
    return x.view("f_paper").withColumn("report_date", report_date(F.col("published")))


def news(x: Inputs) -> DataFrame:
    return x.view("f_news").withColumn("report_date", report_date(F.col("published")))


@R.add("src08_dataset_index", "SELECT dataset, array_to_string(list(DISTINCT CAST(report_date AS STRING) ORDER BY CAST(report_date AS STRING) DESC), ',') AS dates, count(DISTINCT report_date) AS n_days, max(report_date) AS last_updated FROM f_day GROUP BY dataset")
def src08(x):
    return agg.dataset_index(x.view("f_day")).withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))


@R.add("ag01_papers_by_category", f"SELECT {DAY} AS report_date, primary_category, count(*) AS n FROM f_paper GROUP BY ALL")
def ag01(x):
    return agg.papers_by_category(papers(x))


@R.add("ag02_news_by_category", f"SELECT {DAY} AS report_date, coalesce(analysis_category, source_category) AS category, count(*) AS n FROM f_news GROUP BY ALL")
def ag02(x):
    return agg.news_by_category(news(x))


def keyword_rows(x: Inputs) -> DataFrame:
    """Tags of papers and keywords of news by day, in report order."""
    done = "analysis_status = 'success'"  # these come first in their day, so they have the same ranks among themselves
    p = ranking.ranked(papers(x).where(done).drop("title", "updated"), ranking.paper_order(), "report_date")
    n = ranking.ranked(news(x).where(done).select("id", "published", "weight", "analysis_status", "content", "report_date"), ranking.news_order(), "report_date")
    tags = F.expr("array(primary_category, concat('t', cast(cast(id as bigint) % 7 as string)), source)")
    return p.select("report_date", F.lit(0).alias("kind_order"), F.col("rank_in_day").alias("rank"), tags.alias("keywords")).unionByName(
        n.select("report_date", F.lit(1).alias("kind_order"), F.col("rank_in_day").alias("rank"), F.split("content", " ").alias("keywords"))
    )


PAPER_RANK = f"SELECT *, {DAY} AS report_date, row_number() OVER (PARTITION BY {DAY} ORDER BY CASE WHEN analysis_status = 'success' THEN 0 ELSE 1 END, tracking_score DESC NULLS LAST, published DESC, id) AS rank FROM f_paper"
NEWS_RANK = f"SELECT *, {DAY} AS report_date, row_number() OVER (PARTITION BY {DAY} ORDER BY CASE WHEN analysis_status = 'success' THEN 0 ELSE 1 END, weight DESC, published DESC, id) AS rank FROM f_news"
KEYWORDS = f"""SELECT report_date, keyword, n, place FROM (SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY n DESC, first, keyword) AS place FROM (
    SELECT report_date, keyword, count(*) AS n, min((k, rank, pos)) AS first FROM (
        SELECT report_date, 0 AS k, rank, unnest([primary_category, concat('t', CAST(CAST(id AS BIGINT) % 7 AS STRING)), source]) AS keyword, unnest([0, 1, 2]) AS pos FROM ({PAPER_RANK}) WHERE analysis_status = 'success'
        UNION ALL SELECT report_date, 1 AS k, rank, unnest(string_split(content, ' ')) AS keyword, generate_subscripts(string_split(content, ' '), 1) - 1 AS pos FROM ({NEWS_RANK}) WHERE analysis_status = 'success')
    GROUP BY report_date, keyword)) WHERE place <= 10"""


@R.add("ag03_top_keywords", KEYWORDS)
def ag03(x):
    return agg.top_keywords(keyword_rows(x))


STATS = f"""WITH p AS (SELECT report_date, CAST(sum(n) AS BIGINT) AS total_papers, string_agg(concat(c, '=', CAST(n AS STRING)), ',' ORDER BY c) AS by_paper, list(c ORDER BY n DESC, c)[1:5] AS top FROM (
        SELECT {DAY} AS report_date, primary_category AS c, count(*) AS n FROM f_paper GROUP BY ALL) GROUP BY report_date),
    q AS (SELECT report_date, CAST(sum(n) AS BIGINT) AS total_news, string_agg(concat(c, '=', CAST(n AS STRING)), ',' ORDER BY c) AS by_news FROM (
        SELECT {DAY} AS report_date, coalesce(analysis_category, source_category) AS c, count(*) AS n FROM f_news GROUP BY ALL) GROUP BY report_date),
    k AS (SELECT report_date, list(keyword ORDER BY place) AS words FROM ({KEYWORDS}) GROUP BY report_date)
    SELECT coalesce(p.report_date, q.report_date) AS report_date, coalesce(total_papers, 0) AS total_papers, coalesce(total_news, 0) AS total_news, by_paper, by_news, words, top
    FROM p FULL OUTER JOIN q ON p.report_date = q.report_date LEFT JOIN k ON k.report_date = coalesce(p.report_date, q.report_date)"""


def stats(x: Inputs) -> DataFrame:
    return agg.daily_stats(papers(x), news(x), agg.top_keywords(keyword_rows(x)))


@R.add("ag04_daily_stats", f"SELECT report_date, total_papers, total_news, by_paper, by_news, array_to_string(words, ',') AS words FROM ({STATS})")
def ag04(x):
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stats(x).select("report_date", "total_papers", "total_news", text("papers_by_category").alias("by_paper"), text("news_by_category").alias("by_news"), F.array_join("top_keywords", ",").alias("words"))


@R.add("ag05_analysis_stats", "SELECT count(*) AS total, count(*) FILTER (analysis_status = 'success') AS success, count(*) FILTER (analysis_status = 'failed') AS failed, count(*) FILTER (analysis_status = 'success') / count(*) AS success_rate FROM f_paper")
def ag05(x):
    return agg.analysis_stats(x.view("f_paper"))


NUMBER = "TRY_CAST(nullif(regexp_extract(rating, '-?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE)"


@R.add("ag06_review_averages", f"""SELECT forum_id, avg({NUMBER}) AS rating_avg, round(avg(CASE WHEN p1 % 6 <> 0 THEN p2 % 5 + 1.5 END::DOUBLE), 6) AS confidence_avg, count({NUMBER}) AS review_count
    FROM f_reply WHERE kind = 'Official_Review' GROUP BY forum_id""")
def ag06(x):
    sure = F.expr("CASE WHEN p1 % 6 <> 0 THEN concat(p2 % 5 + 1, '.5: fairly sure') WHEN p1 % 12 = 0 THEN 'not sure' END")
    return agg.review_averages(x.view("f_reply").withColumn("confidence", sure)).withColumn("confidence_avg", F.round("confidence_avg", 6))


@R.add("ag07_first_decision", "SELECT forum_id, arg_min(decision, (reply_pos, p1, p2, decision)) AS decision FROM f_reply WHERE kind = 'Decision' GROUP BY forum_id")
def ag07(x):
    return agg.first_decision(x.view("f_reply"), "reply_pos", "p1", "p2", "decision")


@R.add("ag08_repo_rollup", "SELECT paper_id, count(*) AS repos, max(stars) AS max_stars, bool_or(is_official) AS any_official, string_agg(concat(CAST(stars AS STRING), '/', CAST(is_official AS STRING)), ',' ORDER BY stars DESC, is_official DESC) AS repo_list FROM f_repo GROUP BY paper_id")
def ag08(x):
    listed = F.transform("repo_list", lambda r: F.concat(r["stars"].cast("string"), F.lit("/"), r["is_official"].cast("string")))
    return agg.repo_rollup(x.view("f_repo")).withColumn("repo_list", F.array_join(listed, ","))


@R.add("ag09_sorted_name_sets", "SELECT paper_id, string_agg(DISTINCT institution, '|' ORDER BY institution) AS names FROM f_institution GROUP BY paper_id")
def ag09(x):
    return agg.sorted_name_sets(x.view("f_institution"), "paper_id", "institution", "names").withColumn("names", F.array_join("names", "|"))


@R.add("ag09_merged_names", "SELECT id, array_to_string(list_sort(list_distinct([primary_category, source, CASE WHEN analysis_status = 'success' THEN 'cs.LG' END, analysis_status])), '|') AS names FROM f_paper")
def ag09m(x):
    lists = x.view("f_paper").withColumns({"a": F.array("primary_category", "source", F.lit("")), "b": F.array(F.when(F.col("analysis_status") == "success", F.lit("cs.LG")), F.col("analysis_status"))})
    return lists.select("id", F.array_join(agg.merged_names("a", "b"), "|").alias("names"))


@R.add("ag10_fulltext_stats", "SELECT paper_id, count(*) AS n_sections, CAST(sum(len(string_split(body, chr(10)))) AS BIGINT) AS n_paragraphs, CAST(count(*) + sum(len(string_split(body, chr(10)))) AS BIGINT) AS blocks, max(length(body)) AS html_chars FROM f_section GROUP BY paper_id")
def ag10(x):
    return agg.fulltext_stats(x.view("f_section").withColumns({"paragraphs": F.split("body", "\n"), "html_chars": F.char_length("body").cast("long")}))


@R.add("ag11_category_context", f"""SELECT report_date, primary_category, (rank - 1) // 200 AS chunk, string_agg(concat('Title: ', title, chr(10), 'ID: ', id, chr(10), 'Overview: ', source, chr(10), 'Tags: ', primary_category, ', ', source, chr(10)), chr(10) || '---' || chr(10) ORDER BY rank) AS context
    FROM ({PAPER_RANK}) WHERE analysis_status = 'success' AND primary_category IN ('cs.AI', 'cs.CL', 'cs.CV') GROUP BY ALL""")
def ag11(x):
    ranked = ranking.ranked(papers(x).where("analysis_status = 'success'"), ranking.paper_order(), "report_date").withColumnRenamed("rank_in_day", "rank")
    rows = ranked.select("report_date", "primary_category", "rank", "title", "id", F.col("source").alias("overview"), F.array("primary_category", "source").alias("tags"))
    return agg.category_context(joins.papers_in_config(rows, ["cs.AI", "cs.CL", "cs.CV"]))


@R.add("ag12_news_context", f"""SELECT d.report_date, coalesce(chunk, 0) AS chunk, coalesce(context, '今日暂无重大热点新闻。') AS context FROM (SELECT DISTINCT report_date FROM ({NEWS_RANK})) d LEFT JOIN (
    SELECT report_date, (rank - 1) // 200 AS chunk, string_agg(concat('Title: ', id, chr(10), 'Source: ', source_name, chr(10), 'Summary: ', content, chr(10), 'Category: ', analysis_category, chr(10)), chr(10) || '---' || chr(10) ORDER BY rank) AS context
    FROM ({NEWS_RANK}) WHERE analysis_category IS NOT NULL GROUP BY ALL) c ON c.report_date IS NOT DISTINCT FROM d.report_date""")
def ag12(x):
    rows = ranking.ranked(news(x), ranking.news_order(), "report_date").withColumnRenamed("rank_in_day", "rank")
    done = rows.where("analysis_category is not null").select("report_date", "rank", F.col("id").alias("title"), "source_name", F.col("content").alias("summary"), F.col("analysis_category").alias("category"))
    return agg.news_context(done, rows)


@R.add("ag13_activity_trend", f"""SELECT report_date, (SELECT count(*) FROM f_paper WHERE analysis_status = 'success' AND {DAY} = report_date) AS papers, (SELECT count(*) FROM f_news WHERE analysis_status = 'success' AND {DAY} = report_date) AS news
    FROM (SELECT CAST(unnest(range(DATE '2023-12-29', DATE '2024-01-05', INTERVAL 1 DAY)) AS DATE) AS report_date)""")
def ag13(x):
    return agg.activity_trend(papers(x), news(x), F.lit("2024-01-04").cast("date"))


@R.add("ag14_coverage", "SELECT dataset, count(DISTINCT report_date) AS n_days, max(report_date) AS last_updated FROM f_day GROUP BY dataset")
def ag14(x):
    return agg.coverage(x.view("f_day"))


@R.add("ag16_fetch_accounting", """SELECT source_name, CAST(sum(c) AS BIGINT) AS fetched, count(*) AS unique_ids, count(*) FILTER (id IN (SELECT id FROM f_fetched)) AS seen_before, count(*) FILTER (id NOT IN (SELECT id FROM f_fetched)) AS new_ids
    FROM (SELECT source_name, CAST(doc_id // 2 AS STRING) AS id, count(*) AS c FROM f_news GROUP BY ALL) GROUP BY source_name""")
def ag16(x):
    return agg.fetch_accounting(x.view("f_news").select("source_name", F.expr("cast(doc_id div 2 as string)").alias("id")), x.view("f_fetched"))


ENTRY = "concat('https://arxiv.org/abs/24', CAST(issue_no % 10 AS STRING), CASE WHEN issue_no % 4 <> 0 THEN concat('v', CAST(1 + issue_no % 7 AS STRING)) ELSE '' END)"


VERSIONED = f"""SELECT issue_no, {ENTRY} AS url, split_part(split_part({ENTRY}, '/', 5), 'v', 1) AS paper_id, coalesce(TRY_CAST(nullif(regexp_extract({ENTRY}, 'v(\\d+)$', 1), '') AS INT), 0) AS version FROM f_request"""


@R.add("ag17_latest_version", f"SELECT paper_id, max(version) AS version, arg_max(url, (version, issue_no)) AS url, arg_max(issue_no, (version, issue_no)) AS issue_no FROM ({VERSIONED}) GROUP BY paper_id")
def ag17(x):
    from stacksift.functions.text import arxiv_id, arxiv_version

    rows = x.view("f_request").select("issue_no", F.expr(ENTRY).alias("url"))
    return agg.latest_version(rows, arxiv_id(F.col("url")), arxiv_version(F.col("url"))).select("paper_id", "version", "entry.url", "entry.issue_no")


@R.add("so07_template_summary", f"""SELECT report_date, concat('今日共收录 ', CAST(total_papers AS STRING), ' 篇论文，', CAST(total_news AS STRING), ' 条热点资讯。热门领域：', coalesce(nullif(array_to_string(top, '、'), ''), '无'),
    '。热门关键词：', coalesce(nullif(array_to_string(words[1:5], '、'), ''), '无'), '。') AS summary FROM ({STATS})""")
def so07(x):
    return agg.template_summary(stats(x))


# Quality scores. The oracle rebuilds the enriched paper from the views.
TRUSTED = ", ".join(f"'{k}'" for k in score.TRUSTED)
ENRICHED = f"""SELECT p.id, p.published, CASE WHEN p.source = 'openreview' THEN d.decision END AS decision, CASE WHEN p.source = 'openreview' THEN v.rating_avg END AS rating_avg,
    s.citation_count AS cites, s.influential_citation_count AS infl, CASE WHEN s.paper_id IS NOT NULL AND CAST(p.id AS BIGINT) % 13 = 0 THEN 'NeurIPS 2024' END AS venue,
    s.paper_id IS NOT NULL AND CAST(p.id AS BIGINT) % 5 = 0 AS conference, r.repos, r.max_stars, r.any_official,
    CASE WHEN g.paper_id IS NOT NULL THEN CAST(p.id AS BIGINT) % 9 END AS graph_cites, g.names, CASE WHEN g.paper_id IS NOT NULL AND CAST(p.id AS BIGINT) % 11 = 0 THEN 'Proc. ICLR' END AS gsource,
    concat_ws(', ', CASE WHEN s.paper_id IS NOT NULL THEN 'semantic_scholar' END, CASE WHEN r.paper_id IS NOT NULL THEN 'papers_with_code' END, CASE WHEN g.paper_id IS NOT NULL THEN 'openalex' END) AS sources,
    CAST(s.paper_id IS NOT NULL AS INT) + CAST(r.paper_id IS NOT NULL AS INT) + CAST(g.paper_id IS NOT NULL AS INT) AS n_sources
    FROM f_paper p LEFT JOIN f_signal s ON s.paper_id = p.id AND p.source = 'arxiv'
    LEFT JOIN (SELECT paper_id, count(*) AS repos, max(stars) AS max_stars, bool_or(is_official) AS any_official FROM f_repo GROUP BY paper_id) r ON r.paper_id = p.id AND p.source = 'arxiv'
    LEFT JOIN (SELECT paper_id, lower(string_agg(DISTINCT institution, ' ' ORDER BY institution)) AS names FROM f_institution GROUP BY paper_id) g ON g.paper_id = p.id
    LEFT JOIN (SELECT forum_id, arg_min(decision, (reply_pos, p1, p2, decision)) AS decision FROM f_reply WHERE kind = 'Decision' GROUP BY forum_id) d ON d.forum_id = p.id
    LEFT JOIN (SELECT forum_id, avg({NUMBER}) AS rating_avg FROM f_reply WHERE kind = 'Official_Review' GROUP BY forum_id) v ON v.forum_id = p.id"""
PARTS = f"""SELECT *, CASE WHEN regexp_matches(lower(coalesce(decision, '')), 'accept|spotlight|oral') THEN 100.0 WHEN rating_avg IS NOT NULL THEN least(greatest(rating_avg / 10.0 * 100.0, 0.0), 100.0)
        WHEN venue IS NOT NULL OR gsource IS NOT NULL THEN 85.0 WHEN conference THEN 55.0 ELSE 0.0 END::DOUBLE AS venue_score,
    CASE WHEN repos > 0 THEN least(greatest(70.0 + least(20.0, ln(1 + max_stars::DOUBLE) * 4.0) + CASE WHEN any_official THEN 10.0 ELSE 0.0 END, 0.0), 100.0) ELSE 0.0 END::DOUBLE AS code_score,
    greatest(0, coalesce(cites, 0), coalesce(graph_cites, 0)) AS n_cites, greatest(0, coalesce(infl, 0)) AS n_infl,
    greatest(1.0::DOUBLE, greatest(1, floor((epoch(TIMESTAMP '{NOW}') - epoch(published)) / 86400)) / 30.0::DOUBLE) AS months,
    list_filter([{TRUSTED}], lambda k: contains(coalesce(names, ''), k)) AS hits,
    CASE WHEN n_sources >= 3 THEN 100.0 WHEN n_sources = 2 THEN 70.0 WHEN n_sources = 1 THEN 40.0 ELSE 0.0 END::DOUBLE AS metadata_score FROM ({ENRICHED})"""
SCORES = f"""SELECT *, CASE WHEN n_cites <= 0 AND n_infl <= 0 THEN 0.0 ELSE least(greatest(ln(1 + n_cites / months) * 25.0 + ln(1 + n_infl / months) * 35.0, 0.0), 100.0) END::DOUBLE AS citation_score,
    CASE WHEN len(hits) > 0 THEN 75.0 ELSE 0.0 END::DOUBLE AS institution_score FROM ({PARTS})"""
TOTAL = f"""SELECT *, 0.30::DOUBLE * venue_score + 0.20::DOUBLE * code_score + 0.20::DOUBLE * citation_score + 0.15::DOUBLE * institution_score + 0.15::DOUBLE * metadata_score AS t0 FROM ({SCORES})"""
FINAL = f"""SELECT *, CASE WHEN n_sources > 0 THEN round(least(greatest(CASE WHEN code_score >= 90 THEN greatest(t1, 72.0) ELSE t1 END, 0.0), 100.0), 1) END AS tracking_score FROM (
    SELECT *, CASE WHEN venue_score >= 100 THEN greatest(t0, 90.0) WHEN venue_score >= 85 THEN greatest(t0, 75.0) ELSE t0 END AS t1 FROM ({TOTAL}))"""


def scored(x: Inputs) -> DataFrame:
    return score.scored(joins.enrich_signals(*signals(x)), at(NOW))


def rounded(name: str):
    return F.round(name, 6).alias(name)


for key, column in {"qs01_venue_score": "venue_score", "qs02_code_score": "code_score", "qs03_citation_score": "citation_score", "qs05_institution_score": "institution_score"}.items():
    R.add(key, f"SELECT id, round({column}, 6) AS {column} FROM ({SCORES})")(lambda x, c=column: scored(x).select("id", rounded(c)))


@R.add("qs04_age_months", f"SELECT id, round(months, 6) AS months FROM ({PARTS})")
def qs04(x):
    return x.view("f_paper").select("id", F.round(score.age_months(F.col("published"), at(NOW)), 6).alias("months"))


@R.add("qs06_metadata", f"SELECT id, metadata_score, CASE WHEN n_sources >= 3 THEN 'high' WHEN n_sources = 2 THEN 'medium' ELSE 'low' END AS quality_confidence FROM ({PARTS})")
def qs06(x):
    return scored(x).select("id", "metadata_score", "quality_confidence")


@R.add("qs07_final_score", f"SELECT id, tracking_score FROM ({FINAL})")
def qs07(x):
    return scored(x).select("id", "tracking_score")


@R.add("qs08_reasons", f"""SELECT id, CASE WHEN n_sources = 0 THEN 'external quality signals unavailable' ELSE array_to_string(list_filter([
    CASE WHEN regexp_matches(lower(coalesce(decision, '')), 'accept|spotlight|oral') THEN concat('OpenReview decision: ', decision) WHEN rating_avg IS NOT NULL THEN concat('OpenReview avg rating ', printf('%.1f', rating_avg))
        WHEN venue_score = 85 THEN 'top-tier venue signal' WHEN venue_score = 55 THEN 'conference publication signal' END,
    CASE WHEN repos > 0 THEN 'Papers with Code repository found' END, CASE WHEN repos > 0 AND any_official THEN 'official implementation available' END,
    CASE WHEN repos > 0 AND max_stars > 0 THEN concat('top repo stars: ', CAST(max_stars AS STRING)) END,
    CASE WHEN n_cites > 0 OR n_infl > 0 THEN concat('citations: ', CAST(n_cites AS STRING)) END, CASE WHEN n_infl > 0 THEN concat('influential citations: ', CAST(n_infl AS STRING)) END,
    CASE WHEN len(hits) > 0 THEN concat('trusted institution signal: ', hits[1]) END, concat('quality sources: ', sources)], lambda r: r IS NOT NULL)[1:4], '; ') END AS reasons FROM ({SCORES})""")
def qs08(x):
    return scored(x).select("id", F.array_join("quality_reasons", "; ").alias("reasons"))
