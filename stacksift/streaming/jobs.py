"""The stateful jobs as Structured Streaming; each equals its batch twin once all input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stacksift.operators.joins import upsert_keep_success
from stacksift.sources import daylog


def stream_new_items(items: DataFrame, at: str = "first_seen", days: int = 30) -> DataFrame:
    """STR-01: rows whose id was not seen in the last days; state older than that is dropped by the watermark."""
    return items.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(["id"])


def stream_daily_upsert(items: DataFrame, path: str, checkpoint: str, schema: T.StructType, name: str = "daily", order: str = "arrival") -> StreamingQuery:
    """STR-03: merges each micro-batch into its days under path, keeping finished analyses.

    path is a table of `daylog`, with this schema. Only the days that a batch touches are read; their new versions
    are written beside the old ones and take their place in one commit, which also records the batch. A crash before
    the commit leaves the table as it was, and the batch is merged again from the old rows; after it, a repeated
    batch does nothing. Readers see all days at any time. If another writer has replaced a day meanwhile, the merge
    starts again from what that one wrote.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for attempt in range(3):
            seen = daylog.latest(spark, path)
            if seen.streams.get(name, -1) >= number:
                return
            days = [daylog.folder_of(spark, r[0]) for r in batch.select(daylog.DAY).distinct().collect()]
            merged = upsert_keep_success(daylog.read_days(spark, path, schema, days, seen), batch, order)
            try:
                daylog.publish(merged, path, seen, days, (name, number))
                return
            except daylog.CommitConflict:
                if attempt == 2:
                    raise

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily_counts(items: DataFrame, at: str = "published", key: str = "category", late: str = "2 days") -> DataFrame:
    """STR-04: counts per Asia/Shanghai day and category; days begin at 16:00 UTC."""
    day = F.window(at, "1 day", startTime="16 hours")
    counted = items.withWatermark(at, late).groupBy(day.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.to_date(F.from_utc_timestamp("w.start", "Asia/Shanghai")).alias("report_date"), key, "n")
