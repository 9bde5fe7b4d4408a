"""Views that give the paper and news jobs their input from the base tables. The SQL is for Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "f_paper": """SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 20 = 0 THEN 'openreview' ELSE 'arxiv' END AS source,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'cs.AI' WHEN '2-HIGH' THEN 'cs.CL' WHEN '3-MEDIUM' THEN 'cs.CV' WHEN '4-NOT SPECIFIED' THEN 'cs.LG' ELSE 'stat.ML' END AS primary_category,
        o_orderdate AS published, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS updated,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice / 5000, 1) END AS tracking_score,
        CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'failed' END AS analysis_status,
        concat('Paper ', CAST(o_orderkey AS STRING)) AS title FROM orders""",
    "f_signal": """SELECT CAST(l_orderkey AS STRING) AS paper_id, max(CAST(l_quantity AS BIGINT)) AS citation_count,
        CAST(max(l_linenumber) AS BIGINT) AS influential_citation_count FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey""",
    "f_repo": """SELECT CAST(l_orderkey AS STRING) AS paper_id, CAST(floor(l_extendedprice) AS BIGINT) AS stars, l_returnflag = 'A' AS is_official FROM lineitem WHERE l_returnflag <> 'R'""",
    "f_reply": """SELECT CAST(l_orderkey AS STRING) AS forum_id, l_linenumber AS reply_pos, l_partkey AS p1, l_suppkey AS p2,
        CASE WHEN l_linenumber = 1 THEN 'Decision' ELSE 'Official_Review' END AS kind,
        CASE l_returnflag WHEN 'A' THEN 'Accept (oral)' WHEN 'R' THEN 'Reject' ELSE 'Accept (poster)' END AS decision,
        concat(CAST(1 + l_partkey % 10 AS STRING), ': ', l_linestatus) AS rating FROM lineitem""",
    "f_observation": """SELECT event_id, concat('owner/repo', CAST(user_id AS STRING)) AS repo_id, ts AS observed_at, CAST(floor(value * 10) AS BIGINT) + 1 AS stars FROM events""",
    "f_news": """SELECT d.doc_id, substring(md5(concat('https://', d.source, '.example/', CAST(d.doc_id AS STRING))), 1, 16) AS id,
        concat('https://', d.source, '.example/', CAST(d.doc_id AS STRING)) AS url, d.source AS source_name, d.lang AS language, d.text AS content, e.ts AS published,
        CAST(CASE WHEN d.source IN ('src0','src1') THEN 1.0 WHEN d.source IN ('src2','src3') THEN 0.9 ELSE 0.85 END AS DOUBLE) AS weight,
        CASE WHEN l.quality = 1 THEN 'success' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS analysis_status,
        CASE WHEN l.quality = 1 THEN concat('topic', CAST(d.doc_id % 6 AS STRING)) END AS analysis_category, concat('cat-', d.lang) AS source_category
        FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "f_fetched": """SELECT CAST(l.doc_id AS STRING) AS id, e.ts AS first_seen FROM labels l JOIN events e ON e.event_id = l.doc_id""",
    "f_request": """SELECT conv_id * 1000 + turn AS issue_no, concat('[Analysis] 2501.', lpad(CAST(conv_id * 1000 + turn AS STRING), 12, '0'), CASE WHEN conv_id % 2 = 0 THEN 'v2' ELSE '' END, ': ', replace(text, chr(10), ' ')) AS title
        FROM conversations""",
    "f_section": """SELECT CAST(floor(doc_id / 7) AS BIGINT) AS paper_id, doc_id AS sec_idx, 2 AS level, split_part(text, chr(10), 1) AS heading, text AS body FROM documents""",
    "f_title": """SELECT doc_id, text AS title FROM documents""",
    "f_work": """SELECT item_id AS work_id, text AS title FROM benchmark""",
    "f_institution": """SELECT CAST(l_orderkey AS STRING) AS paper_id, CASE n_regionkey WHEN 0 THEN 'Google Research' WHEN 1 THEN 'Smith College' WHEN 2 THEN 'Tsinghua University' ELSE n_name END AS institution
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity >= 25""",
    "f_day": """SELECT 'papers' AS dataset, CAST(o_orderdate AS DATE) AS report_date FROM orders UNION ALL SELECT 'news' AS dataset, CAST(ts AS DATE) AS report_date FROM events""",
}


class Inputs:
    """The base tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """The view over this folder's tables, bound by name, so nothing is registered in the session."""
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
        sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", VIEWS[name])
        return self.spark.sql(sql, **{t: self.table(t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL in front of which the views that it names are defined."""
    used = [v for v in VIEWS if v in sql]
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used) + f"\nSELECT * FROM ({sql})" if used else sql
