"""The filter of tracked ids: no tracked id is called new, few new ids are looked up."""

from __future__ import annotations

import random

from stacksift.operators import joins, seen


def ids(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "id string, n int").repartition(3)


def test_filtered_dedup_equals_the_anti_join(spark):
    g = random.Random(1)
    tracked = [f"id{g.randint(0, 4000)}" for _ in range(1500)]
    new = [f"id{g.randint(0, 8000)}" for _ in range(2000)] + [None, "", "é"] + ["hot"] * 900
    for more in (tracked, [*tracked, "hot", ""], []):
        tracker, df = ids(spark, more), ids(spark, new)
        for blocks in (1, 7, seen.blocks_for(len(more))):
            half = len(more) // 2
            found = seen.add_to_filter(seen.build_filter(ids(spark, more[:half]), blocks), ids(spark, more[half:]), blocks)
            got = seen.drop_seen_filtered(df, tracker, found, blocks).collect()
            assert sorted((r.n, r.id or "") for r in got) == sorted((r.n, r.id or "") for r in joins.drop_seen(df, tracker).collect())


def test_the_filter_settles_nearly_all_new_ids(spark):
    tracked = spark.range(100_000).selectExpr("concat('t', id) AS id")
    blocks = seen.blocks_for(100_000)
    found = seen.build_filter(tracked, blocks)
    assert found.count() <= blocks
    doubt = lambda df: seen.placed(df, blocks, "id").join(found, "block", "left").where(seen.maybe_seen()).count()
    assert doubt(tracked) == 100_000  # none is ever called new
    assert doubt(spark.range(100_000).selectExpr("concat('n', id) AS id")) < 1500
