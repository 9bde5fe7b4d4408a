"""Set operations on batches and id trackers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(*batches: DataFrame) -> DataFrame:
    """ST-01: the batches one after the other, with batch, the number of each row's batch."""
    tagged = [b.withColumn("batch", F.lit(i)) for i, b in enumerate(batches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def historical_ids(df: DataFrame) -> DataFrame:
    """ST-02: the distinct non-empty ids of all days."""
    return df.select("id").where("id is not null and id <> ''").distinct()


def mark_seen(tracker: DataFrame, ids: DataFrame, kind: str, now: Column) -> DataFrame:
    """ST-03: the tracker (kind, id, first_seen) with these ids; an id that is there keeps its first time."""
    fresh = ids.select(F.lit(kind).alias("kind"), "id", now.alias("first_seen"))
    return tracker.select("kind", "id", "first_seen").unionByName(fresh).groupBy("kind", "id").agg(F.min("first_seen").alias("first_seen"))


def expire_seen(tracker: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """ST-04: what was first seen at most so many days ago."""
    return tracker.where(F.col("first_seen") >= now - F.make_interval(days=F.lit(days)))


def expired_count(tracker: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """ST-04's report: one row (kept, removed)."""
    stays = F.col("first_seen") >= now - F.make_interval(days=F.lit(days))
    return tracker.agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("removed"))


def rejected(everything: DataFrame, kept: DataFrame) -> DataFrame:
    """ST-05: the rows that were not kept."""
    return everything.join(kept.select("id"), "id", "left_anti")


def processing_set(actions: DataFrame) -> DataFrame:
    """ST-06: ids whose last action (id, seq, action) is add."""
    return actions.groupBy("id").agg(F.max_by("action", "seq").alias("last")).where("last = 'add'").select("id")
