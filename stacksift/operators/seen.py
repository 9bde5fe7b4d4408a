"""History dedup for very many tracked ids: a persisted Bloom filter settles most new ids, the rest are joined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksift.sources.staging import staging_folder, written_table

#: Words of 64 bits in a block; an id sets one bit in each word of one block.
WORDS = 8
#: Bits per tracked id for which a filter is laid out: about one new id in a hundred is then looked up for nothing.
BITS_PER_ID = 12


def blocks_for(ids: int) -> int:
    """How many blocks a filter for so many ids should have."""
    return max(1, math.ceil(ids * BITS_PER_ID / (64 * WORDS)))


def placed(ids: DataFrame, blocks: int, *keep: str) -> DataFrame:
    """(block, m0 .. m7, keep): an id's block and the bit it sets in each of the block's words."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    bit = lambda i: F.expr(f"shiftleft(1L, cast(xxhash64({i}, id) & 63 as int))").alias(f"m{i}")
    return ids.select(*keep, block.alias("block"), *[bit(i) for i in range(WORDS)])


def build_filter(ids: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of ids, one row of 64 bytes per block that holds any; ids are combined before the shuffle."""
    return placed(ids.where("id is not null"), blocks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def add_to_filter(found: DataFrame, ids: DataFrame, blocks: int) -> DataFrame:
    """The filter with more ids, as ST-03 tracks them; blocks must be the number that it was built with.

    Expired ids (ST-04) stay in it and cost a join; it is built anew when they are many.
    """
    return found.unionByName(build_filter(ids, blocks)).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def maybe_seen() -> Column:
    """Whether all bits of an id are set: false is certain."""
    hit = F.col("w0").isNotNull()
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0)
    return F.coalesce(hit, F.lit(False))


def drop_seen_filtered(df: DataFrame, tracker: DataFrame, found: DataFrame, blocks: int) -> DataFrame:
    """JN-01 by way of the filter: the rows whose id is not tracked, the same as drop_seen(); rows without an id stay.

    Only keys meet the filter, which is some fifteen times smaller than the tracker; what it does not know is new for
    certain. The other ids, mostly tracked ones, are looked up in the tracker, and only ids that are found there
    are taken out of df. The ids in doubt are written once.
    """
    keys = placed(df.select("id").where("id is not null").distinct(), blocks, "id")
    doubt = keys.join(found, "block", "left").where(maybe_seen()).select("id")
    doubt = written_table(doubt, staging_folder(df.sparkSession, "doubt"))
    seen = doubt.join(tracker.select("id"), "id", "left_semi")
    return df.join(seen, "id", "left_anti")
