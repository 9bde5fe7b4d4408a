"""The daily jobs as a whole, over years of days at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stacksift import workflows
from stacksift.operators.batches import small_batches
from stacksift.plans.queries_agg import FINAL, NOW, STATS
from stacksift.plans.queries_core import ALERTS, CATEGORIES, IN_CATEGORIES, NEWS_NOW, SOURCE_DIM, at, signals
from stacksift.plans.queries_text import BLOCK
from stacksift.plans.registry import Registry
from stacksift.sources import daylog
from stacksift.sources.staging import staging_folder

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

HOURS = 5 * 365 * 24
DAY = "strftime(CAST(published + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d')"
MONTH = DAY.replace("-%d", "")
BEST = "tracking_score DESC, published DESC, id"


@R.add("w1_track_papers", f"""WITH scored AS (SELECT p.* EXCLUDE (tracking_score), f.tracking_score, {DAY.replace('published', 'p.published')} AS day, {MONTH.replace('published', 'p.published')} AS month FROM ({FINAL}) f JOIN f_paper p ON p.id = f.id WHERE p.id NOT IN (SELECT id FROM f_fetched)
        AND (p.source = 'openreview' OR (p.primary_category IN {IN_CATEGORIES} AND greatest(p.published, p.updated) >= TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR))),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY {BEST}) AS rt FROM (SELECT *, row_number() OVER (PARTITION BY day, primary_category ORDER BY {BEST}) AS rc FROM scored WHERE tracking_score >= 40) WHERE rc <= 1) WHERE rt <= 2),
    old AS (SELECT id, {MONTH} AS month FROM f_paper WHERE CAST(id AS BIGINT) % 50 = 0)
    SELECT coalesce(o.id, k.id) AS id, CASE WHEN o.id IS NOT NULL THEN 'old' ELSE k.title END AS title, CASE WHEN o.id IS NOT NULL THEN 1.0::DOUBLE ELSE k.tracking_score END AS tracking_score,
        CASE WHEN o.id IS NOT NULL THEN 'success' ELSE 'pending' END AS analysis_status, coalesce(o.month, k.month) AS report_date FROM old o FULL OUTER JOIN kept k ON k.id = o.id""")
def w1(x):
    """Years of days, in folders of months: every feed paper comes twice, every fiftieth is there already with its analysis; the caps are small, so that they bind."""
    papers, s2, code, graph = signals(x)
    papers = papers.drop("tracking_score", "analysis_status")
    feed = papers.where("source = 'arxiv'")
    twice = feed.withColumn("arrival", F.lit(1)).unionByName(feed.withColumns({"title": F.lit("a copy"), "arrival": F.lit(2)}))
    path, month = staging_folder(x.spark, "papers"), workflows.day_text("yyyy-MM").alias("report_date")
    old = x.view("f_paper").where("cast(id as bigint) % 50 = 0")
    daylog.publish(old.select("id", "source", F.lit("old").alias("title"), "primary_category", F.col("published").cast("timestamp").alias("published"), F.lit(1.0).alias("tracking_score"), F.lit("success").alias("analysis_status"), month), path)
    tracker = x.view("f_fetched").withColumn("kind", F.lit("papers"))
    workflows.track_papers(twice, papers.where("source = 'openreview'"), tracker, workflows.Signals(s2, code, graph), path, CATEGORIES, at(NOW), HOURS, 40.0, 1, 2, folder="yyyy-MM")
    return daylog.read_days(x.spark, path, workflows.T.StructType.fromDDL(workflows.PAPER)).select("id", "title", "tracking_score", "analysis_status", "report_date")


README = "CASE WHEN event_id % 3 <> 0 THEN concat('About ', event_id) END"
STAR_BLOCK = BLOCK
STARS = f"""SELECT substring(md5(concat(url, mark)), 1, 16) AS id, url, CASE WHEN mark = '' THEN concat(repo_id, ' - GitHub Trending') WHEN mark = '#stars-alert:double_in_7_days' THEN concat('GitHub Trending Alert: ', repo_id, ' stars doubled within 7 days')
        ELSE concat('GitHub Trending Alert: ', repo_id, ' stars reached 10x baseline') END AS title, 'GitHub Trending' AS source_name, observed_at AS published,
    concat(CASE WHEN mark = '' THEN '' WHEN mark = '#stars-alert:double_in_7_days' THEN concat('Star growth alert: stars doubled within 7 days.', chr(10)) ELSE concat('Star growth alert: stars reached 10x the first tracked count.', chr(10)) END, {STAR_BLOCK},
        CASE WHEN event_id % 3 <> 0 THEN concat(chr(10), chr(10), 'README:', chr(10), 'About ', CAST(event_id AS STRING)) ELSE '' END) AS content, event_id AS pos
    FROM (SELECT *, concat('https://github.com/', repo_id) AS url, unnest(list_filter([CASE WHEN rn = 1 AND event_id % 3 <> 0 THEN '' END, CASE WHEN double_alert THEN '#stars-alert:double_in_7_days' END, CASE WHEN ten_x_alert THEN '#stars-alert:ten_x_stars' END], lambda m: m IS NOT NULL)) AS mark FROM ({ALERTS}))"""


@R.add("w2_track_news", f"""WITH b AS (SELECT 0 AS batch, id, url, source_category AS title, source_name, published, content, doc_id AS pos FROM f_news UNION ALL SELECT 2, id, url, title, source_name, published, content, pos FROM ({STARS})),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch, pos, url) AS rn FROM b WHERE published IS NULL OR published >= TIMESTAMP '{NEWS_NOW}' - INTERVAL 168 HOUR) WHERE rn = 1),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY pos, id) AS place FROM once WHERE id NOT IN (SELECT id FROM f_news WHERE doc_id % 11 = 0))
    SELECT f.id, CASE WHEN place <= 10 AND n.language NOT IN ('de', 'fr') THEN concat('T', CAST(n.doc_id AS STRING)) ELSE f.title END AS title, f.url, f.source_name, coalesce(source_weight, 1.0) AS weight,
        CASE WHEN place <= 10 AND n.language <> 'de' THEN concat('full ', n.id) ELSE f.content END AS content, 'pending' AS analysis_status, {DAY.replace('published', 'f.published')} AS report_date
    FROM fresh f LEFT JOIN f_news n ON n.url = f.url LEFT JOIN ({SOURCE_DIM}) d ON d.source_name = f.source_name""")
def w2(x):
    """Feeds and listing pages hold the same items; every eleventh is tracked already; a third of the repositories has no README."""
    news = x.view("f_news")
    feed = news.select("id", "url", F.col("source_category").alias("title"), "source_name", "published", "content", F.col("doc_id").alias("pos"))
    listed = feed.where("pos % 2 = 0").withColumn("title", F.lit("listed"))
    details = news.where("language <> 'de'").select("url", F.expr("CASE WHEN language = 'fr' THEN '' ELSE concat('T', doc_id) END").alias("title"), F.concat(F.lit("full "), "id").alias("content"))
    seen = x.view("f_observation").select("*", F.col("repo_id").alias("name"), F.concat(F.lit("https://github.com/"), "repo_id").alias("url"), F.lit(None).cast("string").alias("description"), F.lit("").alias("language"), (F.col("stars") % 7).alias("weekly_stars"), F.expr(README).alias("readme"))
    dim = x.spark.sql(SOURCE_DIM.replace("FROM documents", "FROM {documents}"), documents=x.table("documents")).select("source_name", F.col("source_weight").alias("weight"))
    tracker = news.where("doc_id % 11 = 0").select(F.lit("news").alias("kind"), "id", at(NEWS_NOW).alias("first_seen"))
    path = staging_folder(x.spark, "news-days")
    workflows.track_news([feed, listed], details, seen, dim, tracker, path, at(NEWS_NOW))
    return daylog.read_days(x.spark, path, workflows.T.StructType.fromDDL(workflows.NEWS)).select("id", "title", "url", "source_name", "weight", "content", "analysis_status", "report_date")


#: Rows after the analysis: what had to be analysed has succeeded, but for every tenth.
PAPERS_DONE = "w_paper AS (SELECT * EXCLUDE (analysis_status), CASE WHEN tracking_score >= 70 AND id NOT IN (SELECT id FROM f_fetched) THEN CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'failed' ELSE 'success' END ELSE analysis_status END AS analysis_status FROM f_paper)"
NEWS_DONE = """w_news AS (SELECT * EXCLUDE (analysis_status, analysis_category), CASE WHEN doc_id % 10 = 0 OR content IS NULL THEN 'failed' ELSE 'success' END AS analysis_status,
    CASE WHEN doc_id % 10 <> 0 AND content IS NOT NULL THEN concat('kind ', CAST(length(content) % 3 AS STRING)) END AS analysis_category FROM f_news)"""
REPORTED = STATS.replace("f_paper", "w_paper").replace("f_news", "w_news")


@R.add("w3_daily_report", f"""WITH {PAPERS_DONE}, {NEWS_DONE} SELECT report_date, total_papers, total_news, by_paper, by_news, array_to_string(words, ',') AS words, concat('今日共收录 ', CAST(total_papers AS STRING), ' 篇论文，', CAST(total_news AS STRING), ' 条热点资讯。热门领域：',
    coalesce(nullif(array_to_string(top, '、'), ''), '无'), '。热门关键词：', coalesce(nullif(array_to_string(words[1:5], '、'), ''), '无'), '。') AS summary FROM ({REPORTED})""")
def w3(x):
    small_batches(x.spark)
    day = F.to_date(F.from_utc_timestamp(F.col("published").cast("timestamp"), "Asia/Shanghai")).alias("report_date")
    papers = x.view("f_paper").select("*", F.expr("array(primary_category, concat('t', cast(cast(id as bigint) % 7 as string)), source)").alias("tags"), day)
    news = x.view("f_news").select("*", F.split("content", " ").alias("keywords"), day)

    def of_paper(row: dict) -> dict:
        n = int(row["id"])
        if n % 10 == 0:
            raise ValueError("tenth")
        return {"tags": [row["primary_category"], f"t{n % 7}", "openreview" if n % 20 == 0 else "arxiv"]}

    def of_news(row: dict) -> dict:
        if row["doc_id"] % 10 == 0:
            raise ValueError("tenth")
        return {"category": f"kind {len(row['content']) % 3}", "keywords": row["content"].split(" ")}

    report = workflows.daily_report(papers, news, x.view("f_fetched"), of_paper, of_news, datetime(2024, 1, 1))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    stats = report.stats.select("report_date", "total_papers", "total_news", text("papers_by_category").alias("by_paper"), text("news_by_category").alias("by_news"), F.array_join("top_keywords", ",").alias("words"))
    return stats.join(report.summary.withColumnRenamed("report_date", "d"), F.col("report_date").eqNullSafe(F.col("d"))).drop("d")
