"""Quality score as column expressions over an enriched paper.

Inputs are columns: s2 = struct(citation_count, influential_citation_count, venue, publication_types),
code = struct(max_stars, any_official, repos), graph = struct(cited_by_count, institutions, source),
review = struct(decision, rating_avg), each null where there is no signal, and sources, an array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Venues and institutions that count, by plain containment.
TOP_VENUES = ["neurips", "iclr", "icml", "acl", "emnlp", "naacl", "cvpr", "iccv", "eccv", "colm", "aaai", "ijcai", "siggraph"]
TRUSTED = ["anthropic", "berkeley", "cambridge", "carnegie mellon", "cmu", "deepmind", "eth", "google", "meta", "microsoft", "mit", "openai", "oxford", "peking university", "princeton", "stanford", "tsinghua"]
WEIGHTS = {"venue": 0.30, "code": 0.20, "citation": 0.20, "institution": 0.15, "metadata": 0.15}


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def venue_score(review: Column, s2: Column, graph: Column) -> Column:
    """QS-01: an accepting decision; else the mean rating; else a top venue; else a conference."""
    decision = F.lower(F.coalesce(review["decision"], F.lit("")))
    accepted = F.contains(decision, F.lit("accept")) | F.contains(decision, F.lit("spotlight")) | F.contains(decision, F.lit("oral"))
    text = F.lower(F.concat_ws(" ", s2["venue"], graph["source"]))
    top = F.exists(literals(TOP_VENUES), lambda k: F.contains(text, k))
    conference = F.coalesce(F.exists(s2["publication_types"], lambda t: F.contains(F.lower(t), F.lit("conference"))), F.lit(False))
    return F.when(accepted, 100.0).when(review["rating_avg"].isNotNull(), clamp(review["rating_avg"] / 10.0 * 100.0)).when(top, 85.0).when(conference, 55.0).otherwise(0.0)


def code_score(code: Column) -> Column:
    """QS-02: 0 without repositories; stars and an official one add."""
    has = F.coalesce(code["repos"], F.lit(0)) > 0
    base = 70.0 + F.least(F.lit(20.0), F.log1p(code["max_stars"].cast("double")) * 4.0)
    return F.when(has, clamp(base + F.when(code["any_official"], 10.0).otherwise(0.0))).otherwise(0.0)


def age_months(published: Column, now: Column) -> Column:
    """QS-04: whole days since publication over 30; both at least 1."""
    days = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 86400)
    return F.greatest(F.lit(1.0), F.greatest(F.lit(1), days) / 30.0)


def citations(s2: Column, graph: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(s2["citation_count"], F.lit(0)), F.coalesce(graph["cited_by_count"], F.lit(0)))


def influential(s2: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(s2["influential_citation_count"], F.lit(0)))


def citation_score(s2: Column, graph: Column, months: Column) -> Column:
    """QS-03: citations and influential citations per month of age; 0 without any."""
    n, i = citations(s2, graph), influential(s2)
    return F.when((n <= 0) & (i <= 0), 0.0).otherwise(clamp(F.log1p(n / months) * 25.0 + F.log1p(i / months) * 35.0))


def institution_hits(graph: Column) -> Column:
    text = F.lower(F.array_join(graph["institutions"], " "))
    return F.filter(literals(TRUSTED), lambda k: F.contains(F.coalesce(text, F.lit("")), k))


def institution_score(graph: Column) -> Column:
    """QS-05."""
    return F.when(F.size(institution_hits(graph)) > 0, 75.0).otherwise(0.0)


def metadata_score(sources: Column) -> Column:
    """QS-06, the score."""
    n = F.size(sources)
    return F.when(n >= 3, 100.0).when(n == 2, 70.0).when(n == 1, 40.0).otherwise(0.0)


def confidence(sources: Column) -> Column:
    """QS-06, the confidence."""
    n = F.size(sources)
    return F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low")


def halves_to_even(x: Column) -> Column:
    """x at one decimal where it lies exactly between two of them (it is then a multiple of a quarter), else x as it is."""
    return F.when(x * 4 == F.floor(x * 4), F.bround(x, 1)).otherwise(x)


def final_score(venue: Column, code: Column, citation: Column, institution: Column, metadata: Column, sources: Column) -> Column:
    """QS-07: the weighted sum with floors, one decimal; null without sources.

    Halves round away from zero. What is a half is seen at ten times the sum: 31.05 as a sum of doubles may be
    31.049999999999997, whose tenfold is 310.5 again.
    """
    parts = {"venue": venue, "code": code, "citation": citation, "institution": institution, "metadata": metadata}
    total = sum((WEIGHTS[k] * parts[k] for k in WEIGHTS), F.lit(0.0))
    total = F.when(venue >= 100, F.greatest(total, F.lit(90.0))).when(venue >= 85, F.greatest(total, F.lit(75.0))).otherwise(total)
    total = F.when(code >= 90, F.greatest(total, F.lit(72.0))).otherwise(total)
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.round(clamp(total) * 10.0) / 10.0)


def reasons(review: Column, s2: Column, code: Column, graph: Column, venue: Column, sources: Column) -> Column:
    """QS-08: up to four reasons in fixed order; one fixed reason without sources. The institution named is the alphabetically first hit."""
    decision = F.lower(F.coalesce(review["decision"], F.lit("")))
    accepted = F.contains(decision, F.lit("accept")) | F.contains(decision, F.lit("spotlight")) | F.contains(decision, F.lit("oral"))
    first = (
        F.when(accepted, F.concat(F.lit("OpenReview decision: "), review["decision"]))
        .when(review["rating_avg"].isNotNull(), F.format_string("OpenReview avg rating %.1f", halves_to_even(review["rating_avg"])))
        .when(venue == 85, F.lit("top-tier venue signal"))
        .when(venue == 55, F.lit("conference publication signal"))
    )
    has = F.coalesce(code["repos"], F.lit(0)) > 0
    n, i = citations(s2, graph), influential(s2)
    hit = F.get(institution_hits(graph), F.lit(0))
    found = F.array_compact(
        F.array(
            first,
            F.when(has, F.lit("Papers with Code repository found")),
            F.when(has & code["any_official"], F.lit("official implementation available")),
            F.when(has & (code["max_stars"] > 0), F.concat(F.lit("top repo stars: "), code["max_stars"].cast("string"))),
            F.when((n > 0) | (i > 0), F.concat(F.lit("citations: "), n.cast("string"))),
            F.when(i > 0, F.concat(F.lit("influential citations: "), i.cast("string"))),
            F.when(hit.isNotNull(), F.concat(F.lit("trusted institution signal: "), hit)),
            F.concat(F.lit("quality sources: "), F.array_join(sources, ", ")),
        )
    )
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.slice(found, 1, 4)).otherwise(F.array(F.lit("external quality signals unavailable")))


@dataclass(frozen=True)
class Names:
    """Columns of an enriched paper."""

    review: str = "review"
    s2: str = "s2"
    code: str = "code"
    graph: str = "graph"
    sources: str = "sources"
    published: str = "published"


def scored(df, now: Column, names: Names = Names()):
    """df with venue_score .. metadata_score, tracking_score, quality_confidence and quality_reasons."""
    c = {k: F.col(getattr(names, k)) for k in ("review", "s2", "code", "graph", "sources", "published")}
    parts = df.withColumns(
        {
            "venue_score": venue_score(c["review"], c["s2"], c["graph"]),
            "code_score": code_score(c["code"]),
            "citation_score": citation_score(c["s2"], c["graph"], age_months(c["published"], now)),
            "institution_score": institution_score(c["graph"]),
            "metadata_score": metadata_score(c["sources"]),
        }
    )
    return parts.withColumns(
        {
            "tracking_score": final_score(*[F.col(f"{k}_score") for k in WEIGHTS], c["sources"]),
            "quality_confidence": confidence(c["sources"]),
            "quality_reasons": reasons(c["review"], c["s2"], c["code"], c["graph"], F.col("venue_score"), c["sources"]),
        }
    )
