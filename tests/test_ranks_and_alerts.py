"""Ranks of a hot day, folded star state, and star alerts of a stream out of order."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stacksift.operators import ranking
from stacksift.streaming import alerts

DAY0 = datetime(2024, 1, 1)


def observations(seed, n=400, repos=6):
    g = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((k, f"r{g.randint(0, repos - 1)}", DAY0 + timedelta(hours=g.choice([1, 6, 20]) * k // 4, microseconds=g.choice([0, 1, 1500])), g.choice([0, 0, 3, 10, 19, 20, 21, 50, 100, 500]) * g.choice([0, 1, 1, k // 40 + 1]), f"name{k}"))
    return rows


SCHEMA = "event_id long, repo_id string, observed_at timestamp, stars long, name string"


@pytest.mark.parametrize("seed", range(3))
def test_folded_state_equals_the_batch(spark, seed):
    rows = observations(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, ranking.star_state(df).collect()))
    cut = sorted(rows, key=lambda r: (r[2], r[0]))
    first_seen, parts = set(), [[], [], [], []]
    for i, r in enumerate(cut):  # the first sightings in the first part, the rest in any order
        parts[0 if r[1] not in first_seen else random.Random(i).randint(0, 3)].append(r)
        first_seen.add(r[1])
    for split in (parts, [cut[:150], [], cut[150:151], cut[151:]]):
        state = ranking.empty_star_state(df)
        for part in split:
            state = spark.createDataFrame(ranking.fold_star_state(state, spark.createDataFrame(part, SCHEMA)).collect(), state.schema)
        assert sorted(map(tuple, state.drop("first_event", "last_event").collect())) == want


def run_stream(spark, tmp_path, parts, delay):
    """Feeds the parts one micro-batch each and returns what came out."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        alerts.use_rocksdb(spark)
        for k, part in enumerate(parts):
            one = str(tmp_path / f"part{k}")
            spark.createDataFrame(part, SCHEMA).drop("name").coalesce(1).write.parquet(one)
            os.makedirs(tmp_path / "in", exist_ok=True)
            (name,) = [f for f in os.listdir(one) if f.endswith(".parquet")]
            os.rename(f"{one}/{name}", tmp_path / "in" / f"{k:03d}.parquet")
            os.utime(tmp_path / "in" / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        schema = spark.createDataFrame([], SCHEMA).drop("name").schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = alerts.stream_star_alerts(stream, delay)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return [r for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect() if r.repo_id != "~"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def wanted(spark, rows):
    found = ranking.star_alerts(spark.createDataFrame(rows, SCHEMA)).where("is_new or double_alert or ten_x_alert")
    return sorted((r.event_id, r.repo_id, r.observed_at, r.stars, r.is_new, r.double_alert, r.ten_x_alert) for r in found.collect())


CLOSE = [(-1, "~", DAY0 + timedelta(days=4000), 0, "")]


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_of_disordered_batches_equals_the_batch_job(spark, tmp_path, seed):
    """Rows up to the delay apart change places between micro-batches; many micro-batches are smaller than the delay."""
    g = random.Random(seed)
    rows = observations(seed, 300)
    arrival = sorted(rows, key=lambda r: r[2] + timedelta(hours=g.uniform(0, 40)))
    parts = [arrival[k : k + 60] for k in range(0, 300, 60)] + [CLOSE]
    got = run_stream(spark, tmp_path, parts, 48)
    assert not any(r.late for r in got)
    assert sorted((r.event_id, r.repo_id, r.observed_at, r.stars, r.is_new, r.double_alert, r.ten_x_alert) for r in got) == wanted(spark, rows)


def test_late_rows_come_out_aside(spark, tmp_path):
    at = lambda d: DAY0 + timedelta(days=d)
    first = [(1, "a", at(0), 10, ""), (2, "a", at(20), 15, ""), (3, "b", at(20), 7, "")]
    late = [(4, "a", at(1), 900, ""), (5, "c", at(2), 5, "")]
    got = run_stream(spark, tmp_path, [first, [(6, "b", at(21), 70, "")], late, CLOSE], 24)
    assert sorted((r.event_id, r.is_new, r.double_alert, r.ten_x_alert, r.late) for r in got) == [(1, True, False, False, False), (3, True, False, False, False), (4, False, False, False, True), (5, False, False, False, True), (6, False, True, True, False)]


def test_waiting_rows_are_few():
    rising = [(t, t, t) for t in range(50)]
    falling = [(t, t, 1000 - t) for t in range(1000)]
    assert alerts.open_rows(falling) == falling[:2] and alerts.open_rows(rising[::-1]) == rising
    assert alerts.open_rows([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1)]) == [(1, 1, 0), (2, 2, 0), (4, 4, 1)]


class Held:
    """A state of one key, and a handle and timer values, that count what is asked of them."""

    def __init__(self):
        self.asked, self.value = [], None

    def __getattr__(self, name):
        def ask(*values):
            self.asked.append(name)
            if name in ("put", "update", "clear"):
                self.value = values[0] if values else None
            return self if name.startswith("get") and name.endswith("State") else 5000 if name == "getCurrentWatermarkInMs" else self.value

        return ask


def test_a_quiet_repository_costs_no_frame():
    """Without a late row or an alert nothing is put out, and what was said is asked for once."""
    p, now = alerts.StarAlerts(), Held()
    p.handle, p.waiting, p.done = Held(), Held(), Held()
    p.waiting.value = []
    frame = alerts.pd.DataFrame({"at": [6_000_000], "event_id": [1], "stars": [3]})
    assert list(p.handleInputRows(("a",), iter([frame]), now)) == [] and p.waiting.value == [(6_000_000, 1, 3)]
    p.waiting.value, p.done.value = [(4_000_000, 1, 3)], (1, 2, False, False)
    assert list(p.handleExpiredTimer(("a",), now, None)) == [] and p.done.asked == ["get", "update"] and p.waiting.value is None
    p.waiting.value, p.done.value = [(4_000_000, 1, 3)], None
    (said,) = p.handleExpiredTimer(("a",), now, None)
    assert said.values.tolist() == [["a", 1, 4_000_000, 3, True, False, False, False]] and p.done.value == (4_000_000, 3, False, False)


def ranked_by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = lambda r: (0 if r[2] == "success" else 1, r[3] is None, -(r[3] or 0), -r[4].timestamp() if r[4] else float("inf"), r[0])
    return {(day, x[0]): k for day, own in by.items() for k, x in enumerate(sorted(own, key=order), 1)}


@pytest.fixture(scope="module")
def papers(spark):
    """A third of all rows on one day, few different scores."""
    g = random.Random(2)
    day = lambda k: DAY0 if k % 3 == 0 else None if k % 50 == 1 else DAY0 + timedelta(days=g.randint(1, 300))
    rows = [(f"p{k:05d}", day(k), g.choice(["success", "failed", None]), g.choice([None, 1.0, 2.5, 2.5, 90.0]), DAY0 + timedelta(days=g.randint(0, 2)), 5) for k in range(6000)]
    return rows, spark.createDataFrame(rows, "id string, report_date timestamp, analysis_status string, tracking_score double, published timestamp, rank int").repartition(6)


def test_ranks_of_a_hot_day(spark, papers):
    rows, df = papers
    got = ranking.ranked(df, ranking.paper_order(), "report_date")
    assert got.columns == [*df.columns, "rank_in_day"]
    assert {(r.report_date, r.id): r.rank_in_day for r in got.collect()} == ranked_by_hand(rows)
    assert ranking.ranked(df.limit(0), ranking.paper_order(), "report_date").count() == 0


def test_ranked_rows_are_shuffled_once(spark, papers):
    """What is joined to the ranges is small and broadcast: their rows are not shuffled again, by day and range."""
    _, df = papers
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranking.ranked(df, ranking.paper_order(), "report_date")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_range_of_a_hot_day_is_large(spark, papers):
    """Every range holds about the same number of rows, whatever its days."""
    _, df = papers
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        counts = Counter(r.p for r in df.repartitionByRange(12, "report_date", *ranking.paper_order()).select(F.spark_partition_id().alias("p")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(counts.values()) < 2 * sorted(counts.values())[len(counts) // 2]


@pytest.mark.parametrize("number", [1, 2, 70, 71])
def test_pages_of_a_hot_day(spark, papers, number):
    rows, df = papers
    ranks = ranked_by_hand(rows)
    sizes = Counter(day for day, _ in ranks)
    got = ranking.page(df, ranking.paper_order(), "report_date", number, 30).collect()
    want = {(day, i, r, -(-sizes[day] // 30)) for (day, i), r in ranks.items() if (number - 1) * 30 < r <= number * 30}
    assert {(r.report_date, r.id, r.rank_in_day, r.n_pages) for r in got} == want and len(got) == len(want)
