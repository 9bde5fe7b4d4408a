"""Streams over the tables, run until all input is read, and the row analyser."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stacksift.functions.text import report_date
from stacksift.operators import analyze
from stacksift.operators.batches import small_batches
from stacksift.plans.queries_core import ALERTS
from stacksift.plans.registry import Registry
from stacksift.plans.views import Inputs
from stacksift.sources import daylog
from stacksift.sources.staging import staging_folder
from stacksift.streaming import alerts, jobs

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def as_stream(x: Inputs, *parts: DataFrame) -> DataFrame:
    """The parts written as files one after the other and read back as a stream; more than one: a file at a time."""
    path = staging_folder(x.spark, "stream-in")
    for df in parts:
        df.write.mode("append").parquet(path)
    reader = x.spark.readStream.schema(parts[0].schema)
    return (reader.option("maxFilesPerTrigger", 1) if len(parts) > 1 else reader).parquet(path)


def finished(query: StreamingQuery) -> None:
    query.awaitTermination()


def drained(x: Inputs, stream: DataFrame) -> DataFrame:
    """All rows of an append-mode stream."""
    out = staging_folder(x.spark, "stream-out")
    finished(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", staging_folder(x.spark, "stream-state")).trigger(availableNow=True).start())
    return x.spark.read.schema(stream.schema).parquet(out)


@R.add("str01_stream_new_items", "SELECT CAST(user_id AS STRING) AS id, 2 AS times FROM events GROUP BY user_id")
def str01(x):
    """All events, and all again 200 days later, when their ids have expired; two rows between push the watermark."""
    rows = x.table("events").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("first_seen"))
    later = lambda df, days: df.withColumn("first_seen", F.col("first_seen") + F.make_interval(days=F.lit(days)))
    newest = rows.agg(F.max("first_seen").alias("first_seen")).select(F.lit("~").alias("id"), "first_seen")
    once = [p.coalesce(1) for p in (rows, later(newest, 90), later(newest, 91), later(rows, 200))]
    found = drained(x, jobs.stream_new_items(as_stream(x, *once))).where("id <> '~'")
    return found.groupBy("id").agg(F.count("*").cast("int").alias("times"))


@R.add("str02_stream_star_alerts", f"SELECT event_id, repo_id, stars, is_new, double_alert, ten_x_alert FROM (SELECT *, rn = 1 AS is_new FROM ({ALERTS})) WHERE is_new OR double_alert OR ten_x_alert")
def str02(x):
    alerts.use_rocksdb(x.spark)
    rows = x.view("f_observation").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    end = rows.agg(F.max("observed_at").alias("e")).select(F.lit(-1).cast("long").alias("event_id"), F.lit("~").alias("repo_id"), (F.col("e") + F.make_interval(days=F.lit(30))).alias("observed_at"), F.lit(0).cast("long").alias("stars"))
    found = drained(x, alerts.stream_star_alerts(as_stream(x, rows.unionByName(end))))  # the last row closes the stream
    return found.where("repo_id <> '~' and not late").select("event_id", "repo_id", "stars", "is_new", "double_alert", "ten_x_alert")


@R.add("str03_stream_daily_upsert", """SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR o.analysis_status = 'success' THEN o.tracking_score ELSE n.tracking_score END AS tracking_score,
    CASE WHEN o.id IS NULL THEN 'pending' ELSE o.analysis_status END AS analysis_status
    FROM (SELECT * FROM f_paper WHERE primary_category <> 'cs.CV') o FULL OUTER JOIN (SELECT id, tracking_score + 1 AS tracking_score FROM f_paper WHERE primary_category <> 'cs.AI') n ON n.id = o.id""")
def str03(x):
    papers = x.view("f_paper").select("id", "tracking_score", "analysis_status", F.date_format("published", "yyyy").alias("report_date"), "primary_category")
    path, base = staging_folder(x.spark, "days"), papers.where("primary_category <> 'cs.CV'").drop("primary_category")
    daylog.publish(base, path)
    new = papers.where("primary_category <> 'cs.AI'").select("id", (F.col("tracking_score") + 1).alias("tracking_score"), "report_date", F.lit(1).alias("arrival"))
    finished(jobs.stream_daily_upsert(as_stream(x, new), path, staging_folder(x.spark, "stream-state"), base.schema))
    return daylog.read_days(x.spark, path, base.schema).select("id", "tracking_score", "analysis_status")


@R.add("str04_stream_daily_counts", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS report_date, event_type AS category, count(*) AS n FROM events GROUP BY ALL")
def str04(x):
    rows = x.table("events").select(F.col("ts").cast("timestamp").alias("published"), F.col("event_type").alias("category"))
    counted = jobs.stream_daily_counts(as_stream(x, rows))
    out = staging_folder(x.spark, "stream-out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    finished(counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", staging_folder(x.spark, "stream-state")).trigger(availableNow=True).start())
    return x.spark.read.schema(counted.schema).parquet(f"{out}/*").groupBy("report_date", "category").agg(F.max("n").alias("n"))


@R.add("udf01_analyze", """SELECT id, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE len(string_split(content, ' ')) END AS n_words, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'success' END AS analysis_status,
    CASE WHEN doc_id % 10 = 0 THEN 'ValueError: tenth' END AS analysis_error, CASE WHEN doc_id % 10 <> 0 THEN CAST(published + INTERVAL 8 HOUR AS DATE) END AS report_date FROM f_news""")
def udf01(x):
    small_batches(x.spark)
    def count_words(row: dict) -> dict:
        if row["doc_id"] % 10 == 0:
            raise ValueError("tenth")
        return {"n_words": len(row["content"].split(" "))}

    done = analyze.analyze(x.view("f_news").select("id", "doc_id", "content", "published"), count_words, T.StructType([T.StructField("n_words", T.LongType())]), datetime(2024, 1, 1))
    return done.select("id", F.coalesce("light_analysis.n_words", F.lit(-1)).alias("n_words"), "analysis_status", "analysis_error", F.when(F.col("analyzed_at").isNotNull(), report_date(F.col("published"))).alias("report_date"))
