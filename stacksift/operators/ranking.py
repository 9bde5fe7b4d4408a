"""Windows, top-k, order and pages. Every order ends in a unique key, so results don't depend on the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksift.functions.text import report_date
from stacksift.sources.staging import staging_folder, written_table


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """WN-01: the first row of each key in arrival order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def capped_top_k(df: DataFrame, min_score: float = 70.0, per_category: int = 10, total: int = 30, day: str | None = None) -> DataFrame:
    """WN-02: of rows that pass the gate, by score and date, at most per_category and total for each day; a cap of 0 is off.

    day names the day's column; without it days are Asia/Shanghai dates of published. Both ranks are
    limited before their shuffle (a group limit inside the window), and the second runs per day.
    """
    passing = df.where(F.col("tracking_score") >= min_score).withColumn("_day", F.col(day) if day else report_date(F.col("published")))
    best = (F.desc("tracking_score"), F.desc_nulls_last("published"), F.asc("id"))
    if per_category > 0:
        passing = passing.withColumn("_rc", F.row_number().over(Window.partitionBy("_day", "primary_category").orderBy(*best))).where(F.col("_rc") <= per_category).drop("_rc")
    if total > 0:
        passing = passing.withColumn("_rt", F.row_number().over(Window.partitionBy("_day").orderBy(*best))).where(F.col("_rt") <= total).drop("_rt")
    return passing.drop("_day")


def star_alerts(observations: DataFrame) -> DataFrame:
    """WN-03: observations (repo_id, event_id, observed_at, stars) with is_new, double_alert and ten_x_alert.

    An alert goes to the first row that meets its condition after the first sighting: at least twice the
    first stars within 7 days, at least ten times at any time. Both may go to one row.
    """
    by_time = Window.partitionBy("repo_id").orderBy("observed_at", "event_id")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = observations.withColumns({"first_stars": F.first("stars").over(so_far), "first_at": F.first("observed_at").over(so_far), "_rn": F.row_number().over(by_time)})
    later = F.col("_rn") > 1
    double = later & (F.col("stars") >= 2 * F.col("first_stars")) & (F.col("observed_at") <= F.col("first_at") + F.expr("interval 7 days"))
    ten = later & (F.col("stars") >= 10 * F.col("first_stars"))
    counted = seen.withColumns({"_d": double, "_t": ten}).withColumns({"_nd": F.count_if("_d").over(so_far), "_nt": F.count_if("_t").over(so_far)})
    return counted.select(
        *observations.columns,
        "first_stars",
        "first_at",
        (F.col("_rn") == 1).alias("is_new"),
        (F.col("_d") & (F.col("_nd") == 1)).alias("double_alert"),
        (F.col("_t") & (F.col("_nt") == 1)).alias("ten_x_alert"),
    )


def star_state(observations: DataFrame) -> DataFrame:
    """WN-04: one row per repository: first and last sighting, when its alerts went out, and its latest name, owner and url where observations have them."""
    at = F.struct("observed_at", "event_id")
    latest = [F.max_by(c, at).alias(c) for c in ("name", "owner", "url") if c in observations.columns]
    return star_alerts(observations).groupBy("repo_id").agg(
        F.min("observed_at").alias("first_seen_at"),
        F.min_by("stars", at).alias("first_seen_stars"),
        F.max("observed_at").alias("last_seen_at"),
        F.max_by("stars", at).alias("last_seen_stars"),
        F.min(F.when(F.col("double_alert"), F.col("observed_at"))).alias("double_alerted_at"),
        F.min(F.when(F.col("ten_x_alert"), F.col("observed_at"))).alias("ten_x_alerted_at"),
        *latest,
    )


def fold_star_state(state: DataFrame, observations: DataFrame) -> DataFrame:
    """WN-04 as a fold: the state after more observations, from the state before and these alone.

    state has star_state()'s columns and first_event and last_event, the event_ids of both sightings; begin with
    empty_star_state(). Folding in parts gives star_state() of all, in whatever order the parts come, as long as
    none holds a row earlier than a repository's first sighting. One row per repository is joined and written.
    """
    latest = [c for c in ("name", "owner", "url") if c in observations.columns]
    at = F.struct("observed_at", "event_id")
    known = state.select("repo_id", F.struct(*[c for c in state.columns if c != "repo_id"]).alias("old"))
    begun = observations.groupBy("repo_id").agg(F.min(F.struct("observed_at", "event_id", "stars")).alias("_f")).join(known, "repo_id", "left")
    given = F.struct(F.col("old.first_seen_at").alias("observed_at"), F.col("old.first_event").alias("event_id"), F.col("old.first_seen_stars").alias("stars"))
    firsts = begun.select("repo_id", F.when(F.col("old").isNotNull(), given).otherwise(F.col("_f")).alias("first"))
    seen = observations.join(firsts, "repo_id")
    later = at > F.struct("first.observed_at", "first.event_id")
    double = later & (F.col("stars") >= 2 * F.col("first.stars")) & (F.col("observed_at") <= F.col("first.observed_at") + F.expr("interval 7 days"))
    ten = later & (F.col("stars") >= 10 * F.col("first.stars"))
    news = seen.groupBy("repo_id").agg(
        F.first("first").alias("first"),
        F.max(F.struct("observed_at", "event_id", "stars", *latest)).alias("last"),
        F.min(F.when(double, F.col("observed_at"))).alias("double"),
        F.min(F.when(ten, F.col("observed_at"))).alias("ten"),
    )
    both = news.join(known, "repo_id", "full_outer")
    newer = F.col("old").isNull() | (F.struct("last.observed_at", "last.event_id") > F.struct(F.col("old.last_seen_at").alias("observed_at"), F.col("old.last_event").alias("event_id")))
    last = lambda new, old: F.when(F.col("last").isNotNull() & newer, F.col(f"last.{new}")).otherwise(F.col(f"old.{old}"))
    return both.select(
        "repo_id",
        F.coalesce("old.first_seen_at", "first.observed_at").alias("first_seen_at"),
        F.coalesce("old.first_seen_stars", "first.stars").alias("first_seen_stars"),
        last("observed_at", "last_seen_at").alias("last_seen_at"),
        last("stars", "last_seen_stars").alias("last_seen_stars"),
        F.least("old.double_alerted_at", "double").alias("double_alerted_at"),
        F.least("old.ten_x_alerted_at", "ten").alias("ten_x_alerted_at"),
        *[last(c, c).alias(c) for c in latest],
        F.coalesce("old.first_event", "first.event_id").alias("first_event"),
        last("event_id", "last_event").alias("last_event"),
    )


def empty_star_state(observations: DataFrame) -> DataFrame:
    """The state before any observation."""
    kind = dict(observations.dtypes)
    at, stars, event = kind["observed_at"], kind["stars"], kind["event_id"]
    columns = {"repo_id": kind["repo_id"], "first_seen_at": at, "first_seen_stars": stars, "last_seen_at": at, "last_seen_stars": stars, "double_alerted_at": at, "ten_x_alerted_at": at}
    columns |= {c: kind[c] for c in ("name", "owner", "url") if c in kind} | {"first_event": event, "last_event": event}
    return observations.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))


def trending_limit(df: DataFrame, n: int = 25, min_stars: int = 1000, page: str = "page_id", order: Sequence[str] = ("pos",)) -> DataFrame:
    """WN-05: the first n repositories of each page above the star limit; n <= 0: all. A repeated id counts as seen before its stars are looked at."""
    once = df.withColumn("_rn", F.row_number().over(Window.partitionBy(page, "repo_id").orderBy(*order))).where("_rn = 1").drop("_rn")
    passing = once.where(F.col("stars") > min_stars)
    if n <= 0:
        return passing
    return passing.withColumn("_rn", F.row_number().over(Window.partitionBy(page).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def success_first() -> Column:
    return F.when(F.col("analysis_status") == "success", 0).otherwise(1)


def paper_order() -> list[Column]:
    """SO-01: success first, score descending with nulls last, newest first."""
    return [success_first().asc(), F.desc_nulls_last("tracking_score"), F.desc("published"), F.asc("id")]


def news_order() -> list[Column]:
    """SO-02: success first, heaviest source first, newest first."""
    return [success_first().asc(), F.desc("weight"), F.desc("published"), F.asc("id")]


def fetch_order() -> list[Column]:
    """SO-03: heaviest source first, newest first."""
    return [F.desc("weight"), F.desc("published"), F.asc("id")]


def latest_order() -> list[Column]:
    """SO-04: newest first, without a date last."""
    return [F.desc_nulls_last("published"), F.asc("id")]


def ranked(df: DataFrame, order: list[Column], day: str) -> DataFrame:
    """df with rank_in_day from 1, exact also where one day holds most rows.

    Rows are put in ranges of (day, order) of near equal size, sorted in each, and numbered there; a row's rank is
    its number among its day's in its range, and the day's rows in the ranges before. The ranges are written as a
    table of the shared folder, so that a lost executor cannot move their bounds; they are shuffled once. What is
    joined to them has one row per day and range, which is broadcast: a range's rows meet in no task of a further
    shuffle. order must end in a unique key.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ranges = df.repartitionByRange(parts, day, *order).sortWithinPartitions(day, *order)
    numbered = sorted_ranges.withColumn("_at", F.monotonically_increasing_id())  # the range's number and the place in it
    table = written_table(numbered, staging_folder(spark, "ranks")).withColumn("_range", F.shiftright("_at", 33))
    each = table.groupBy(F.col(day).alias("_day"), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_day").orderBy("_of")) - F.col("_n")
    begins = each.select("_day", "_of", (F.col("_first") - before - 1).alias("_base"))
    placed = table.join(F.broadcast(begins), F.col(day).eqNullSafe(F.col("_day")) & (F.col("_range") == F.col("_of")))
    return placed.select(*df.columns, (F.col("_at") - F.col("_base")).cast("int").alias("rank_in_day"))


def page(df: DataFrame, order: list[Column], day: str, number: int, size: int = 30) -> DataFrame:
    """SO-05: the number-th page (from 1) of each day's list, with n_pages.

    Only rows up to the page's end are ranked: every task cuts a day's list there before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    first = df.withColumn("rank_in_day", place).where(F.col("rank_in_day") <= number * size).where(F.col("rank_in_day") > (number - 1) * size)
    pages = df.groupBy(F.col(day).alias("_day")).agg(F.ceil(F.count("*") / size).alias("n_pages"))
    return first.join(pages, F.col(day).eqNullSafe(F.col("_day"))).drop("_day")


def latest_day(df: DataFrame, day: str) -> DataFrame:
    """SO-06: the rows of the newest day."""
    return df.join(df.agg(F.max(day).alias(day)), day, "left_semi")
