"""Row filters and row validation. All are column predicates, so they reach the scan where they can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 70.0


def recent_papers(df: DataFrame, now: Column, hours: int = 25) -> DataFrame:
    """FLT-01: the later of published and updated is at most so many hours ago."""
    return df.where(F.greatest("published", "updated") >= now - F.make_interval(hours=F.lit(hours)))


def recent_news(df: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """FLT-02: published at most so many hours ago; a date that could not be read is kept."""
    return df.where(F.col("published").isNull() | (F.col("published") >= now - F.make_interval(hours=F.lit(hours))))


def target_categories(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """FLT-03: the primary category is one of these."""
    return df.where(F.col("primary_category").isin(list(categories)))


def score_gate(df: DataFrame, min_score: float = MIN_SCORE, enabled: bool = True) -> DataFrame:
    """FLT-04: scored at least min_score; without scoring nothing passes."""
    return df.where((F.col("tracking_score") >= min_score) & F.lit(enabled))


def analyzed_only(df: DataFrame, strict: bool = False, analysis: str = "light_analysis") -> DataFrame:
    """FLT-05: analysed with success; strict: and the analysis is there."""
    done = F.col("analysis_status") == "success"
    return df.where(done & F.col(analysis).isNotNull() if strict else done)


def browse_category(df: DataFrame, category: str) -> DataFrame:
    """FLT-06: 'All', or the category is the primary one or in the list."""
    if category == "All":
        return df
    return df.where((F.col("primary_category") == category) | F.array_contains("categories", category))


def source_url_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """FLT-07: keep items whose URL has one of their source's substrings; a source without rules keeps all.

    rules: (source_name, patterns array, ignore_case boolean), one row per source of a hand-kept table.
    """
    named = rules.select(F.col("source_name"), F.col("patterns").alias("_patterns"), F.col("ignore_case").alias("_fold"))
    url = F.when(F.col("_fold"), F.lower("url")).otherwise(F.col("url"))
    joined = items.join(named, "source_name", "left").withColumn("_url", url)
    hit = F.exists("_patterns", lambda p: F.contains(F.col("_url"), F.when(F.col("_fold"), F.lower(p)).otherwise(p)))
    return joined.where(F.col("_patterns").isNull() | hit).select(*items.columns)


#: Words of decisions.
ACCEPTING, REJECTING = ("accept", "spotlight", "oral", "poster"), ("reject", "withdraw")


def accepted(decision: Column) -> Column:
    """FLT-08: the decision has an accepting word and no rejecting one, in any case; null is not accepted."""
    low = F.lower(F.coalesce(decision, F.lit("")))
    return low.rlike("|".join(ACCEPTING)) & ~low.rlike("|".join(REJECTING))


def accepted_decisions(df: DataFrame, decision: str = "decision") -> DataFrame:
    return df.where(accepted(F.col(decision)))


def min_stars(df: DataFrame, n: int = 1000) -> DataFrame:
    """FLT-09: strictly more stars than n."""
    return df.where(F.col("stars") > n)


def markable_ids(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-10: ids with a score, to be marked as seen, and the others, which a later run tries again."""
    return df.where(F.col("tracking_score").isNotNull()).select("id"), df.where(F.col("tracking_score").isNull()).select("id")


#: What enumerations may hold.
STATUSES = ("pending", "success", "failed")
CONFIDENCES = ("high", "medium", "low")


def validate_rows(df: DataFrame) -> DataFrame:
    """FLT-11: df with violations, the names of the declared rules that a row breaks; rules of absent columns don't count.

    Nulls break no rule: a field that is not there has its default.
    """
    rules = {
        "tags": lambda c: F.size(c).between(3, 5),
        "keywords": lambda c: F.size(c) <= 5,
        "quality_score": lambda c: c.between(0, 100),
        "relevance_score": lambda c: c.between(0, 100),
        "tracking_score": lambda c: c.between(0, 100),
        "weight": lambda c: c.between(0, 1),
        "analysis_status": lambda c: c.isin(*STATUSES),
        "quality_confidence": lambda c: c.isin(*CONFIDENCES),
    }
    found = [F.when(~rule(F.col(name)), F.lit(name)) for name, rule in rules.items() if name in df.columns]
    return df.withColumn("violations", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def deep_eligible(df: DataFrame) -> DataFrame:
    """FLT-12: papers of the preprint source whose id has no review-site prefix."""
    return df.where((F.coalesce("source", F.lit("arxiv")) == "arxiv") & ~F.col("id").startswith("openreview:"))
