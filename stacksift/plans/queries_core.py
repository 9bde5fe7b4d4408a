"""Filters, joins, set operations, windows and order over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksift.functions.text import parse_request_title, report_date
from stacksift.operators import aggregates, filters, joins, ranking, seen, sets
from stacksift.plans.registry import Registry
from stacksift.plans.views import Inputs
from stacksift.sources.staging import staging_folder, written_table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

NOW = "1998-06-01 00:00:00"
NEWS_NOW = "2024-01-09 00:00:00"
CATEGORIES = ["cs.AI", "cs.CL", "cs.CV"]
IN_CATEGORIES = "('cs.AI', 'cs.CL', 'cs.CV')"
SHANGHAI = "CAST(published + INTERVAL 8 HOUR AS DATE)"


def at(s: str):
    return F.lit(s).cast("timestamp_ntz")


@R.add("flagship_tracked_papers", f"""SELECT report_date, primary_category, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY tracking_score DESC, published DESC, id) AS rt FROM (
        SELECT *, {SHANGHAI} AS report_date, row_number() OVER (PARTITION BY {SHANGHAI}, primary_category ORDER BY tracking_score DESC, published DESC, id) AS rc
        FROM f_paper WHERE tracking_score >= 70 AND primary_category IN {IN_CATEGORIES} AND id NOT IN (SELECT id FROM f_fetched)) WHERE rc <= 10)
    WHERE rt <= 30 GROUP BY ALL""")
def flagship(x: Inputs) -> DataFrame:
    fresh = joins.drop_seen(filters.target_categories(x.view("f_paper"), CATEGORIES), x.view("f_fetched"))
    kept = ranking.capped_top_k(fresh)
    return aggregates.papers_by_category(kept.withColumn("report_date", report_date(F.col("published"))))


P = "id, primary_category, published, tracking_score"


@R.add("flt01_recent_papers", f"SELECT {P} FROM f_paper WHERE greatest(published, updated) >= TIMESTAMP '{NOW}' - INTERVAL 25 HOUR")
def flt01(x):
    return filters.recent_papers(x.view("f_paper"), at(NOW)).selectExpr(*P.split(", "))


@R.add("flt02_recent_news", f"SELECT id, published FROM f_news WHERE published IS NULL OR published >= TIMESTAMP '{NEWS_NOW}' - INTERVAL 168 HOUR")
def flt02(x):
    return filters.recent_news(x.view("f_news"), at(NEWS_NOW)).select("id", "published")


@R.add("flt03_target_categories", f"SELECT {P} FROM f_paper WHERE primary_category IN {IN_CATEGORIES}")
def flt03(x):
    return filters.target_categories(x.view("f_paper"), CATEGORIES).selectExpr(*P.split(", "))


@R.add("flt04_score_gate", f"SELECT {P} FROM f_paper WHERE tracking_score >= 70")
def flt04(x):
    return filters.score_gate(x.view("f_paper")).selectExpr(*P.split(", "))


@R.add("flt05_analyzed_only", "SELECT id, analysis_category FROM f_news WHERE analysis_status = 'success' AND analysis_category IS NOT NULL")
def flt05(x):
    return filters.analyzed_only(x.view("f_news"), True, "analysis_category").select("id", "analysis_category")


LISTED = "CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'cs.CV' ELSE 'cs.LG' END"


@R.add("flt06_browse_category", f"SELECT {P} FROM f_paper WHERE primary_category = 'cs.CV' OR {LISTED} = 'cs.CV'")
def flt06(x):
    return filters.browse_category(x.view("f_paper").withColumn("categories", F.expr(f"array(primary_category, {LISTED})")), "cs.CV").selectExpr(*P.split(", "))


@R.add("flt07_source_url_rules", """SELECT id, url FROM f_news WHERE (source_name = 'src0' AND (contains(url, '/1') OR contains(url, '/2')))
    OR (source_name = 'src1' AND contains(lower(url), 'src1.example/3')) OR source_name NOT IN ('src0', 'src1')""")
def flt07(x):
    rules = x.spark.createDataFrame([("src0", ["/1", "/2"], False), ("src1", ["SRC1.example/3"], True)], "source_name string, patterns array<string>, ignore_case boolean")
    return filters.source_url_rules(x.view("f_news"), rules).select("id", "url")


@R.add("flt08_accepted_decisions", """SELECT forum_id, reply_pos, p1, p2, decision FROM f_reply
    WHERE regexp_matches(lower(decision), 'accept|spotlight|oral|poster') AND NOT regexp_matches(lower(decision), 'reject|withdraw')""")
def flt08(x):
    return filters.accepted_decisions(x.view("f_reply")).select("forum_id", "reply_pos", "p1", "p2", "decision")


@R.add("flt09_min_stars", "SELECT event_id, repo_id, stars FROM f_observation WHERE stars > 1000")
def flt09(x):
    return filters.min_stars(x.view("f_observation")).select("event_id", "repo_id", "stars")


@R.add("flt10_markable_ids", "SELECT id, tracking_score IS NOT NULL AS marked FROM f_paper")
def flt10(x):
    marked, later = filters.markable_ids(x.view("f_paper"))
    return marked.withColumn("marked", F.lit(True)).unionByName(later.withColumn("marked", F.lit(False)))


@R.add("flt11_validate_rows", """SELECT id, CASE WHEN tracking_score NOT BETWEEN 0 AND 100 THEN 'tracking_score' ELSE '' END
    || CASE WHEN (CAST(id AS BIGINT) % 7) NOT BETWEEN 3 AND 5 THEN ',tags' ELSE '' END AS violations FROM f_paper""")
def flt11(x):
    tagged = x.view("f_paper").withColumn("tags", F.expr("slice(array('a','b','c','d','e','f'), 1, cast(cast(id as bigint) % 7 as int))"))
    v = F.col("violations")
    text = F.concat(F.when(F.array_contains(v, "tracking_score"), "tracking_score").otherwise(""), F.when(F.array_contains(v, "tags"), ",tags").otherwise(""))
    return filters.validate_rows(tagged).select("id", text.alias("violations"))


@R.add("flt12_deep_eligible", "SELECT id, source FROM f_paper WHERE coalesce(source, 'arxiv') = 'arxiv' AND NOT starts_with(id, 'openreview:')")
def flt12(x):
    return filters.deep_eligible(x.view("f_paper")).select("id", "source")


@R.add("jn01_drop_seen", "SELECT id, tracking_score FROM f_paper WHERE id NOT IN (SELECT id FROM f_fetched)")
def jn01(x):
    return joins.drop_seen(x.view("f_paper"), x.view("f_fetched")).select("id", "tracking_score")


@R.add("jn01_drop_seen_filtered", "SELECT id, tracking_score FROM f_paper WHERE id NOT IN (SELECT id FROM f_fetched)")
def jn01_filtered(x):
    """The filter of half of the tracker, to which the other half is added."""
    tracker = x.view("f_fetched")
    blocks = seen.blocks_for(tracker.count())
    first = F.xxhash64("id") % 2 == 0
    known = written_table(seen.build_filter(tracker.where(first), blocks), staging_folder(x.spark, "filter"))
    known = written_table(seen.add_to_filter(known, tracker.where(~first), blocks), staging_folder(x.spark, "filter"))
    return seen.drop_seen_filtered(x.view("f_paper"), tracker, known, blocks).select("id", "tracking_score")


@R.add("jn01_seen_summary", """SELECT count(*) FILTER (id NOT IN (SELECT id FROM f_fetched)) AS n_new, count(*) FILTER (id IN (SELECT id FROM f_fetched)) AS n_duplicate,
    count(*) FILTER (id NOT IN (SELECT id FROM f_fetched)) > 0 AS has_new FROM f_paper""")
def jn01s(x):
    return joins.seen_summary(x.view("f_paper"), x.view("f_fetched"))


@R.add("jn02_work_queue", """SELECT 'paper' AS kind, id FROM f_paper WHERE tracking_score >= 70 AND id NOT IN (SELECT id FROM f_fetched)
    UNION ALL SELECT 'news' AS kind, id FROM f_news WHERE id NOT IN (SELECT id FROM f_fetched)""")
def jn02(x):
    return joins.work_queue(x.view("f_paper"), x.view("f_news"), x.view("f_fetched"))


def signals(x: Inputs):
    """Papers with the three signals and the review signal, one struct each."""
    code = aggregates.repo_rollup(x.view("f_repo"))
    graph = aggregates.sorted_name_sets(x.view("f_institution"), "paper_id", "institution", "institutions").select(
        "paper_id", F.expr("cast(paper_id as bigint) % 9").alias("cited_by_count"), "institutions", F.expr("CASE WHEN cast(paper_id as bigint) % 11 = 0 THEN 'Proc. ICLR' END").alias("source"))
    s2 = x.view("f_signal").select("*", F.expr("CASE WHEN cast(paper_id as bigint) % 13 = 0 THEN 'NeurIPS 2024' END").alias("venue"), F.expr("CASE WHEN cast(paper_id as bigint) % 5 = 0 THEN array('Conference') ELSE array('Journal') END").alias("publication_types"))
    replies = x.view("f_reply")
    review = aggregates.first_decision(replies, "reply_pos", "p1", "p2", "decision").join(aggregates.review_averages(replies), "forum_id", "full_outer")
    reviewed = x.view("f_paper").join(review.select(F.col("forum_id").alias("id"), F.struct("decision", "rating_avg").alias("review")), "id", "left")
    papers = reviewed.withColumn("review", F.when(F.col("source") == "openreview", F.col("review")))
    return papers, s2, code, graph


#: Identifiers that papers come with, and what the signals say; a third of the graph titles belong to other papers.
WITH_IDS = "CASE WHEN cast(id as bigint) % 4 <> 0 THEN concat('2501.', id) WHEN cast(id as bigint) % 8 = 0 THEN '' END"
GRAPH_TITLE = "CASE cast({id} as bigint) % 6 WHEN 0 THEN concat('PAPER: ', {id}, '!') WHEN 1 THEN concat('On paper ', {id}, ' and others') WHEN 2 THEN 'another title' WHEN 3 THEN '' ELSE concat('Paper ', {id}) END"
AGREES = "(CAST(g.paper_id AS BIGINT) % 6 NOT IN (2, 3))"


@R.add("jn03_enrich_signals", f"""SELECT p.id, concat_ws(',', CASE WHEN p.source = 'arxiv' AND s.paper_id IS NOT NULL THEN 'semantic_scholar' END,
    CASE WHEN p.source = 'arxiv' AND r.paper_id IS NOT NULL THEN 'papers_with_code' END, CASE WHEN {AGREES} THEN 'openalex' END, CASE WHEN p.source = 'openreview' AND v.forum_id IS NOT NULL THEN 'openreview' END) AS sources,
    CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN concat('2501.', id) ELSE id END AS arxiv_id, concat('doi', id) AS doi, CASE WHEN p.source = 'arxiv' AND s.paper_id IS NOT NULL THEN concat('S', p.id) ELSE concat('old', p.id) END AS scholar_id,
    CASE WHEN {AGREES} THEN concat('W', g.paper_id) END AS graph_id, CASE WHEN {AGREES} THEN CAST(g.paper_id AS BIGINT) % 9 END AS cited_by_count, CASE WHEN p.source = 'arxiv' THEN s.citation_count END AS citation_count, CASE WHEN p.source = 'arxiv' THEN r.n END AS repos
    FROM f_paper p LEFT JOIN f_signal s ON s.paper_id = p.id
    LEFT JOIN (SELECT paper_id, count(*) AS n FROM f_repo GROUP BY paper_id) r ON r.paper_id = p.id
    LEFT JOIN (SELECT DISTINCT paper_id FROM f_institution) g ON g.paper_id = p.id
    LEFT JOIN (SELECT DISTINCT forum_id FROM f_reply) v ON v.forum_id = p.id""")
def jn03(x):
    papers, s2, code, graph = signals(x)
    old = F.struct(F.expr(WITH_IDS).alias("arxiv"), F.concat(F.lit("doi"), "id").alias("doi"), F.concat(F.lit("old"), "id").alias("semantic_scholar"), F.lit(None).cast("string").alias("openalex"))
    graph = graph.withColumns({"title": F.expr(GRAPH_TITLE.format(id="paper_id")), "work_id": F.concat(F.lit("W"), "paper_id")})
    found = joins.enrich_signals(papers.withColumn("external_ids", old), s2.withColumn("external_id", F.concat(F.lit("S"), "paper_id")), code, graph, count_review_source=True)
    ids = F.col("external_ids")
    return found.select(
        "id", F.array_join("sources", ",").alias("sources"), ids["arxiv"].alias("arxiv_id"), ids["doi"].alias("doi"), ids["semantic_scholar"].alias("scholar_id"), ids["openalex"].alias("graph_id"),
        "graph.cited_by_count", "s2.citation_count", "code.repos",
    )


NORM = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@R.add("jn04_title_match", f"""WITH a AS (SELECT doc_id AS paper_id, {NORM} AS t FROM f_title), b AS (SELECT work_id, {NORM} AS t FROM f_work)
    SELECT paper_id, work_id, a.t = b.t AS exact FROM a, b WHERE a.t <> '' AND b.t <> '' AND (contains(a.t, b.t) OR contains(b.t, a.t))""")
def jn04(x):
    return joins.title_match(x.view("f_title"), x.view("f_work"), "doc_id", "work_id")


@R.add("jn05_upsert_keep_success", """SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR o.analysis_status = 'success' THEN o.tracking_score ELSE n.tracking_score END AS tracking_score,
    CASE WHEN o.id IS NULL THEN 'pending' ELSE o.analysis_status END AS analysis_status
    FROM (SELECT * FROM f_paper WHERE primary_category <> 'cs.CV') o FULL OUTER JOIN (SELECT id, tracking_score + 1 AS tracking_score FROM f_paper WHERE primary_category <> 'cs.AI') n ON n.id = o.id""")
def jn05(x):
    old = x.view("f_paper").where("primary_category <> 'cs.CV'").select("id", "tracking_score", "analysis_status")
    return joins.upsert_keep_success(old, x.view("f_paper").where("primary_category <> 'cs.AI'").select("id", (F.col("tracking_score") + 1).alias("tracking_score")))


@R.add("jn06_overlay_results", """SELECT id, tracking_score, analysis_status FROM f_paper WHERE primary_category <> 'cs.CV' AND source <> 'openreview'
    UNION ALL SELECT id, tracking_score, 'success' FROM f_paper WHERE source = 'openreview'""")
def jn06(x):
    c = ["id", "tracking_score", "analysis_status"]
    done = x.view("f_paper").where("source = 'openreview'").withColumn("analysis_status", F.lit("success"))
    return joins.overlay_results(x.view("f_paper").where("primary_category <> 'cs.CV'").select(*c), done)


#: A source dimension of all but every fifth source, with attributes that follow the source's number.
NUMBER = "CAST(substring(source, 4) AS INT)"
SOURCE_DIM = f"""SELECT DISTINCT source AS source_name, concat('Company ', CAST({NUMBER} % 3 AS STRING)) AS company, CASE WHEN {NUMBER} % 2 = 0 THEN 'rss' ELSE 'crawler' END AS fetch_type,
    CASE WHEN {NUMBER} % 4 = 0 THEN 'zh' ELSE 'en' END AS source_language, CAST({NUMBER} % 10 AS DOUBLE) / 10 AS source_weight, concat('kind ', CAST({NUMBER} % 4 AS STRING)) AS category FROM documents WHERE {NUMBER} % 5 <> 4"""
ATTRIBUTES = "company, fetch_type, source_language, source_weight, category"


@R.add("jn07_attach_source", f"SELECT id, n.source_name, {ATTRIBUTES} FROM f_news n LEFT JOIN ({SOURCE_DIM}) d ON d.source_name = n.source_name")
def jn07(x):
    dim = x.spark.sql(SOURCE_DIM.replace("FROM documents", "FROM {documents}"), documents=x.table("documents"))
    return joins.attach_source(x.view("f_news").select("id", "source_name"), dim).select("id", "source_name", *ATTRIBUTES.split(", "))


@R.add("jn08_enrich_details", """SELECT id, source_name, CASE WHEN rn <= 10 AND language NOT IN ('de', 'fr') THEN concat('T', CAST(doc_id AS STRING)) ELSE id END AS title,
    CASE WHEN rn <= 10 AND language <> 'de' AND content <> '' THEN content ELSE source_category END AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY doc_id, id) AS rn FROM f_news)""")
def jn08(x):
    items = x.view("f_news").select("id", "doc_id", "url", "source_name", F.col("id").alias("title"), F.col("source_category").alias("content"))
    details = x.view("f_news").where("language <> 'de'").select("url", F.expr("CASE WHEN language = 'fr' THEN '' ELSE concat('T', doc_id) END").alias("title"), "content")
    return joins.enrich_details(items, details, 10, "doc_id").select("id", "source_name", "title", "content")


@R.add("jn09_deep_status", """SELECT paper_id AS id, CASE WHEN issue_no % 3 = 0 THEN 'completed' WHEN issue_no % 2 = 0 THEN 'processing' ELSE 'pending' END AS status
    FROM (SELECT issue_no, regexp_extract(title, '^\\[Analysis\\]\\s*(\\d+\\.\\d+)', 1) AS paper_id FROM f_request)""")
def jn09(x):
    asked = x.view("f_request").select("issue_no", parse_request_title(F.col("title"))["id"].alias("id"))
    return joins.deep_status(asked, asked.where("issue_no % 3 = 0"), asked.where("issue_no % 2 = 0"))


@R.add("jn10_papers_in_config", f"SELECT id, primary_category, CASE primary_category WHEN 'cs.AI' THEN 0 WHEN 'cs.CL' THEN 1 ELSE 2 END AS category_order FROM f_paper WHERE primary_category IN {IN_CATEGORIES}")
def jn10(x):
    return joins.papers_in_config(x.view("f_paper"), CATEGORIES).select("id", "primary_category", "category_order")


@R.add("jn11_lookup_ids", "SELECT id, source FROM f_paper WHERE id IN ('1', '2', '3', '40', '500', 'none')")
def jn11(x):
    return joins.lookup_ids(x.view("f_paper"), ["1", "2", "3", "40", "500", "none"]).select("id", "source")


@R.add("wn01_first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def wn01(x):
    return ranking.first_wins(x.table("documents").select("doc_id", F.md5("text").alias("k")), "k", "doc_id").select("doc_id")


@R.add("wn02_capped_top_k", f"""SELECT id, primary_category, tracking_score FROM (
    SELECT *, row_number() OVER (PARTITION BY {SHANGHAI} ORDER BY tracking_score DESC, published DESC, id) AS rt FROM (
        SELECT *, row_number() OVER (PARTITION BY {SHANGHAI}, primary_category ORDER BY tracking_score DESC, published DESC, id) AS rc FROM f_paper WHERE tracking_score >= 40) WHERE rc <= 1)
    WHERE rt <= 2""")
def wn02(x):
    return ranking.capped_top_k(x.view("f_paper"), 40.0, 1, 2).select("id", "primary_category", "tracking_score")


ALERTS = """SELECT *, d AND sum(CAST(d AS INT)) OVER w = 1 AS double_alert, t AND sum(CAST(t AS INT)) OVER w = 1 AS ten_x_alert FROM (
    SELECT *, rn > 1 AND stars >= 2 * first_stars AND observed_at <= first_at + INTERVAL 7 DAY AS d, rn > 1 AND stars >= 10 * first_stars AS t FROM (
        SELECT *, first(stars) OVER v AS first_stars, first(observed_at) OVER v AS first_at, row_number() OVER v AS rn FROM f_observation
        WINDOW v AS (PARTITION BY repo_id ORDER BY observed_at, event_id)))
    WINDOW w AS (PARTITION BY repo_id ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)"""


@R.add("wn03_star_alerts", f"SELECT event_id, repo_id, stars, first_stars, rn = 1 AS is_new, double_alert, ten_x_alert FROM ({ALERTS})")
def wn03(x):
    return ranking.star_alerts(x.view("f_observation")).select("event_id", "repo_id", "stars", "first_stars", "is_new", "double_alert", "ten_x_alert")


STATE = f"""SELECT repo_id, min(observed_at) AS first_seen_at, arg_min(stars, (observed_at, event_id)) AS first_seen_stars, max(observed_at) AS last_seen_at,
    arg_max(stars, (observed_at, event_id)) AS last_seen_stars, min(observed_at) FILTER (double_alert) AS double_alerted_at, min(observed_at) FILTER (ten_x_alert) AS ten_x_alerted_at, concat('Repo ', CAST(arg_max(event_id, (observed_at, event_id)) AS STRING)) AS name FROM ({ALERTS}) GROUP BY repo_id"""


@R.add("wn04_star_state", STATE)
def wn04(x):
    return ranking.star_state(x.view("f_observation").withColumn("name", F.concat(F.lit("Repo "), F.col("event_id").cast("string"))))


@R.add("wn04_folded_state", STATE)
def wn04_folded(x):
    rows = x.view("f_observation").withColumn("name", F.concat(F.lit("Repo "), F.col("event_id").cast("string")))
    state, weeks = ranking.empty_star_state(rows), rows.select(F.date_trunc("week", "observed_at").alias("w")).distinct()
    for week in sorted(r["w"] for r in weeks.collect()):
        folded = ranking.fold_star_state(state, rows.where(F.date_trunc("week", "observed_at") == F.lit(week)))
        state = written_table(folded, staging_folder(x.spark, "star-state"))
    return state.drop("first_event", "last_event")


@R.add("wn05_trending_limit", """SELECT page_id, event_id, repo_id, stars FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY event_id) AS rp FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, repo_id ORDER BY event_id) AS rn FROM (SELECT *, CAST(observed_at AS DATE) AS page_id FROM f_observation)) WHERE rn = 1 AND stars > 1000) WHERE rp <= 25""")
def wn05(x):
    pages = x.view("f_observation").withColumn("page_id", F.to_date("observed_at"))
    return ranking.trending_limit(pages, order=("event_id",)).select("page_id", "event_id", "repo_id", "stars")


RANKED = "SELECT id, row_number() OVER (PARTITION BY {day} ORDER BY {order}) AS rank_in_day FROM {view}"
PAPER_ORDER = "CASE WHEN analysis_status = 'success' THEN 0 ELSE 1 END, tracking_score DESC NULLS LAST, published DESC, id"


@R.add("so01_rank_papers", RANKED.format(day="published", view="f_paper", order=PAPER_ORDER))
def so01(x):
    return ranking.ranked(x.view("f_paper"), ranking.paper_order(), "published").select("id", "rank_in_day")


@R.add("so02_rank_news", RANKED.format(day="CAST(published AS DATE)", view="f_news", order="CASE WHEN analysis_status = 'success' THEN 0 ELSE 1 END, weight DESC, published DESC, id"))
def so02(x):
    return ranking.ranked(x.view("f_news").withColumn("day", F.to_date("published")), ranking.news_order(), "day").select("id", "rank_in_day")


@R.add("so03_fetch_order", RANKED.format(day="CAST(published AS DATE)", view="f_news", order="weight DESC, published DESC, id"))
def so03(x):
    return ranking.ranked(x.view("f_news").withColumn("day", F.to_date("published")), ranking.fetch_order(), "day").select("id", "rank_in_day")


@R.add("so04_latest_first", RANKED.format(day="primary_category, source, strftime(published, '%Y-%m')", view="f_paper", order="published DESC NULLS LAST, id"))
def so04(x):
    return ranking.ranked(x.view("f_paper").withColumn("part", F.concat_ws("|", "primary_category", "source", F.date_format("published", "yyyy-MM"))), ranking.latest_order(), "part").select("id", "rank_in_day")


@R.add("so05_page", f"""SELECT id, rank_in_day, n_pages FROM (SELECT id, row_number() OVER (PARTITION BY published ORDER BY {PAPER_ORDER}) AS rank_in_day,
    CAST(ceil(count(*) OVER (PARTITION BY published) / 3) AS BIGINT) AS n_pages FROM f_paper) WHERE rank_in_day BETWEEN 4 AND 6""")
def so05(x):
    return ranking.page(x.view("f_paper"), ranking.paper_order(), "published", 2, 3).select("id", "rank_in_day", "n_pages")


@R.add("so06_latest_day", "SELECT id, published FROM f_paper WHERE published = (SELECT max(published) FROM f_paper)")
def so06(x):
    return ranking.latest_day(x.view("f_paper"), "published").select("id", "published")


@R.add("st01_union_sources", "SELECT id, source, 0 AS batch FROM f_paper WHERE source = 'arxiv' UNION ALL SELECT id, source, 1 AS batch FROM f_paper WHERE source = 'openreview' UNION ALL SELECT id, NULL, 2 FROM f_news")
def st01(x):
    p = x.view("f_paper").select("id", "source")
    return sets.union_sources(p.where("source = 'arxiv'"), p.where("source = 'openreview'"), x.view("f_news").select("id"))


@R.add("st02_historical_ids", "SELECT DISTINCT CAST(user_id AS STRING) AS id FROM events WHERE user_id % 7 <> 0")
def st02(x):
    return sets.historical_ids(x.table("events").select(F.expr("CASE WHEN user_id % 7 = 0 THEN '' ELSE cast(user_id as string) END").alias("id")))


TRACKED = "SELECT 'papers' AS kind, id, first_seen FROM f_fetched"


@R.add("st03_mark_seen", f"SELECT kind, id, min(first_seen) AS first_seen FROM ({TRACKED} UNION ALL SELECT 'papers', id, TIMESTAMP '2030-01-01' FROM f_paper WHERE tracking_score >= 70) GROUP BY kind, id")
def st03(x):
    tracker = x.view("f_fetched").withColumn("kind", F.lit("papers"))
    return sets.mark_seen(tracker, filters.score_gate(x.view("f_paper")), "papers", at("2030-01-01 00:00:00"))


@R.add("st04_expire_seen", "SELECT id, first_seen FROM f_fetched WHERE first_seen >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY")
def st04(x):
    return sets.expire_seen(x.view("f_fetched"), at("2024-02-01 00:00:00")).select("id", "first_seen")


@R.add("st04_expired_count", "SELECT count(*) FILTER (first_seen >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY) AS kept, count(*) FILTER (first_seen < TIMESTAMP '2024-02-01' - INTERVAL 30 DAY) AS removed FROM f_fetched")
def st04_count(x):
    return sets.expired_count(x.view("f_fetched"), at("2024-02-01 00:00:00"))


@R.add("st05_rejected", f"""SELECT id, tracking_score FROM f_paper WHERE id NOT IN (SELECT id FROM (
    SELECT *, row_number() OVER (PARTITION BY {SHANGHAI} ORDER BY tracking_score DESC, published DESC, id) AS rt FROM (
        SELECT *, row_number() OVER (PARTITION BY {SHANGHAI}, primary_category ORDER BY tracking_score DESC, published DESC, id) AS rc FROM f_paper WHERE tracking_score >= 70) WHERE rc <= 10)
    WHERE rt <= 30)""")
def st05(x):
    papers = x.view("f_paper")
    return sets.rejected(papers, ranking.capped_top_k(papers)).select("id", "tracking_score")


@R.add("st06_processing_set", "SELECT CAST(user_id AS STRING) AS id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) IN (SELECT min(event_type) FROM events)")
def st06(x):
    e = x.table("events")
    add = e.agg(F.min("event_type").alias("add"))  # one row
    acts = e.join(F.broadcast(add)).select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == F.col("add"), "add").otherwise("remove").alias("action"))
    return sets.processing_set(acts)
