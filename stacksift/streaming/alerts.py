"""Star alerts of a stream whose rows come in any order, within bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that are later than the watermark still reach the processor, and its side output, for this long.
GRACE_DAYS = 3650
WEEK = 7 * 86_400_000_000

OUTPUT = "repo_id string, event_id long, at long, stars long, is_new boolean, double_alert boolean, ten_x_alert boolean, late boolean"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store to RocksDB, which arbitrary state with timers needs. A setting of the job."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


Row = tuple[int, int, int]  # microseconds, event_id, stars


def open_rows(rows: list[Row]) -> list[Row]:
    """Of waiting rows, in time order, those that can still raise an alert.

    A row with no more stars than an earlier one cannot be the first to reach a bound. Which row is the first
    sighting is not known while rows wait, so the two earliest stay in any case.
    """
    kept: list[Row] = []
    most = None
    for i, row in enumerate(sorted(rows)):
        if i < 2 or row[2] > most:
            kept.append(row)
        most = row[2] if most is None else max(most, row[2])
    return kept


class StarAlerts(StatefulProcessor):
    """Per repository: rows wait in a list until the watermark has passed them, then are looked at in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "first_at long, first_stars long, double_done boolean, ten_done boolean")
        self.waiting = handle.getListState("waiting", "at long, event_id long, stars long")

    def close(self) -> None:
        pass

    def keep(self, rows: list[Row]) -> None:
        """Puts the waiting rows back and asks to be called when the watermark passes the earliest."""
        if rows:
            self.waiting.put(rows)
            self.handle.registerTimer(rows[0][0] // 1000 + 1)
        else:
            self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = [(int(a), int(e), int(s)) for a, e, s in self.waiting.get()]
        late = []
        for batch in rows:
            for row in zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["stars"].tolist(), strict=True):
                if row[0] // 1000 < mark:
                    late.append((key[0], row[1], row[0], row[2], False, False, False, True))
                else:
                    held.append(row)
            held = open_rows(held)
        self.keep(held)
        if late:  # a frame costs more than a repository's rows, and most have nothing to say yet
            yield pd.DataFrame(late, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(a), int(e), int(s)) for a, e, s in self.waiting.get())
        ready = [r for r in held if r[0] // 1000 < mark]
        first_at, first_stars, double_done, ten_done = self.done.get() or (None, None, False, False)
        out = []
        for at, event, stars in ready:
            new = first_at is None
            if new:
                first_at, first_stars = at, stars
            double = not new and not double_done and stars >= 2 * first_stars and at <= first_at + WEEK
            ten = not new and not ten_done and stars >= 10 * first_stars
            double_done, ten_done = bool(double_done or double), bool(ten_done or ten)
            if new or double or ten:
                out.append((key[0], event, at, stars, new, bool(double), bool(ten), False))
        if ready:
            self.done.update((int(first_at), int(first_stars), double_done, ten_done))
        self.keep(held[len(ready) :])
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def stream_star_alerts(observations: DataFrame, delay_hours: int = 48) -> DataFrame:
    """STR-02: alerts of star_alerts() from a stream of (repo_id, event_id, observed_at timestamp, stars), with a flag late.

    Rows may come in any order as long as none is more than delay_hours behind the newest of the micro-batches
    before: each is looked at once the watermark has passed it, in order of time and event_id, so the alerts are
    those of the batch job. Later rows cannot change what was said; they come out as they are, late and without
    an alert, for up to ten years. What waits of a repository is at most its record highs of the last delay_hours;
    else its state is one small row that never expires. The newest rows of a stream wait for the watermark.
    Rows without a time, stars or event_id are dropped.

    The session's state store must be RocksDB: see use_rocksdb.
    """
    sound = observations.where("observed_at is not null and stars is not null and event_id is not null")
    rows = sound.select("repo_id", "event_id", "stars", F.unix_micros("observed_at").alias("at"), (F.col("observed_at") + F.make_interval(days=F.lit(GRACE_DAYS))).alias("_marked"))
    marked = rows.withWatermark("_marked", f"{delay_hours + 24 * GRACE_DAYS} hours")
    found = marked.groupBy("repo_id").transformWithStateInPandas(StarAlerts(), OUTPUT, "Append", "EventTime")
    return found.select("repo_id", "event_id", F.timestamp_micros("at").alias("observed_at"), "stars", "is_new", "double_alert", "ten_x_alert", "late")
