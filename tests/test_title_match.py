"""Title matches against brute force, and what meets under one key."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from stacksift.operators import joins


def normalized(t):
    return re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()


def by_hand(papers, works):
    found = []
    for i, p in papers:
        for j, w in works:
            a, b = normalized(p), normalized(w)
            if a and b and (a in b or b in a):
                found.append((i, j, a == b))
    return sorted(found)


def frames(spark, papers, works):
    return spark.createDataFrame(papers, "id long, title string").repartition(3), spark.createDataFrame(works, "work_id long, title string").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_title_match_equals_brute_force(spark, seed):
    g = random.Random(seed)
    words = ["a", "an", "of", "the", "net", "nets", "internet", "deep", "deeper", "xx", "x1", "survey", "aaaa", "aaa"]

    def title():
        return g.choice([" ", "-", ": "]).join(g.choice(words) for _ in range(g.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 9, 12, 18, 20, 40])))

    papers = [(i, title()) for i in range(140)] + [(200, None), (201, "!!"), (202, "Deep  NETS"), (203, "deep nets"), (204, "é")]
    whole = [t for _, t in papers if t]
    # cuts at any letter, so that they begin and end within tokens
    cuts = [(lambda t, a, b: t[min(a, b) : max(a, b)])(t, g.randint(0, len(t)), g.randint(0, len(t))) for t in g.choices(whole, k=160)]
    works = [(i, t) for i, t in enumerate([*cuts, *(title() for _ in range(40)), None, "", "deep nets", "x", "of the"])]
    got = joins.title_match(*frames(spark, papers, works)).collect()
    assert sorted(map(tuple, got)) == by_hand(papers, works)
    turned = joins.title_match(*frames(spark, works, papers)).collect()
    assert sorted((j, i, e) for i, j, e in turned) == by_hand(papers, works)


def test_title_match_of_empty_tables(spark):
    a, b = frames(spark, [(1, "deep nets")], [(2, "deep")])
    assert [tuple(r) for r in joins.title_match(a, b).collect()] == [(1, 2, False)]
    assert joins.title_match(a.limit(0), b).count() == 0 and joins.title_match(a, b.limit(0)).count() == 0


def test_titles_of_common_tokens_meet_under_no_hot_key(spark, monkeypatch):
    """4,000 by 4,000 titles of the same 60 words: what is verified stays near what matches."""
    g = random.Random(3)
    words = [f"word{i}" for i in range(20)] + ["of", "the", "and", "for", "in", "on", "a", "with"]
    title = lambda n: " ".join(g.choice(words) for _ in range(n))
    papers = [(i, title(g.choice([3, 5, 8, 12]))) for i in range(4000)]
    works = [(i, title(12)) for i in range(4000)]
    p, w = frames(spark, papers, works)
    small, large = (joins.titles(x, k, "i").select("m", "t") for x, k in ((p, "id"), (w, "work_id")))
    monkeypatch.setattr(joins.F, "contains", lambda a, b: F.lit(True))
    candidates = joins.contained(small, large).count() + joins.contained(large, small).count()
    monkeypatch.undo()
    assert candidates < 2 * 4000 * 4000 / 500  # one rarest token meets a twelfth of all titles and more
    sample = works[:150]
    got = sorted(map(tuple, joins.title_match(p, spark.createDataFrame(sample, "work_id long, title string")).collect()))
    assert got == by_hand(papers, sample)


def test_copies_of_a_title_are_compared_once(spark):
    papers = [(i, "the same long title of a paper") for i in range(300)] + [(900, "title of a")]
    works = [(1, "Title of A"), (2, "same long title of a paper"), (3, "another title")]
    got = joins.title_match(*frames(spark, papers, works))
    assert sorted(map(tuple, got.collect())) == by_hand(papers, works)


def test_details_go_to_the_first_items_of_each_source(spark):
    items = [(f"i{k}", f"u{k % 40}", ["a", "b", None][k % 3], k // 3, "t", "c") for k in range(90)] + [("i0", "u0", "a", 0, "t", "c")]
    details = [(f"u{k}", ["", None, "T"][k % 3], ["C", ""][k % 2]) for k in range(30)]
    df = spark.createDataFrame(items, "id string, url string, source_name string, pos int, title string, content string")
    got = sorted((r.id, r.title, r.content) for r in joins.enrich_details(df, spark.createDataFrame(details, "url string, title string, content string"), 4).collect())
    by_url, want = {u: (t, c) for u, t, c in details}, []
    for source in ("a", "b", None):
        own = sorted({(x[3], x[0]) for x in items if x[2] == source})
        first = {i for _, i in own[: 4 if source != "a" else 3]}  # the repeated item counts twice
        for x in items:
            if x[2] == source:
                t, c = by_url.get(x[1], (None, None)) if x[0] in first else (None, None)
                want.append((x[0], t or "t", c or "c"))
    assert got == sorted(want)
