"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacksift.llm.common import Ranges, lookup, materialize, partitions


def byte_shards(rows: DataFrame, key: str, size: str, tie: str, shards: int) -> DataFrame:
    """Adds shard and slot: rows in order of key are cut into contiguous shards at equal byte targets.

    rows: narrow rows with an integer key, a positive integer size, and tie, a hash of 32 bits as a long;
    other columns are kept.
    Steps: range partitions by key; each partition's total bytes and rows (one number each per
    partition) give its global offset; a window inside the partition adds the running sum. A row goes
    to the shard that holds its middle byte, so a shard misses its target by less than one row's size.
    slot counts from 0 inside a shard without gaps.

    Null keys come first. Rows of equal key are ordered by tie, then by their other columns, so repeated
    rows get neighbouring slots; many rows of one key, or none, are cut into ranges by tie. An empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    others = [tie, *(c for c in rows.columns if c not in (key, tie))]
    ranges = Ranges.of(rows, key, partitions(spark))
    digest = F.shiftleft(F.col(tie) - 2**31, 32)  # as large as tie among all longs
    cut = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), ranges.number(F.col(key), digest).alias("b"))
    total = {t["b"]: (t["bytes"], t["n"]) for t in cut.groupBy("b").agg(F.sum(f"r.{size}").alias("bytes"), F.count("*").alias("n")).collect()}
    each = [total.get(b, (0, 0)) for b in range(ranges.count)]
    before_bytes = [0, *accumulate(x[0] for x in each)]
    before_rows = [0, *accumulate(x[1] for x in each)]
    order = Window.partitionBy("b").orderBy(F.col(f"r.{key}").asc_nulls_first(), *[F.col(f"r.`{c}`") for c in others])
    placed = (
        cut.select("r", "b", F.sum(f"r.{size}").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("up_to"), F.row_number().over(order).alias("rn"))
        .select("r", (lookup(before_bytes, F.col("b")) + F.col("up_to")).alias("end"), (lookup(before_rows, F.col("b")) + F.col("rn") - 1).alias("at"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * end - r.`{size}`) * {shards}) div {max(1, 2 * before_bytes[-1])}")).cast("int"))
    )
    placed = materialize(placed, "shards")
    first = {t["shard"]: t["at"] for t in placed.groupBy("shard").agg(F.min("at").alias("at")).collect()}
    return placed.select("r.*", "shard", (F.col("at") - lookup([first.get(s, 0) for s in range(shards)], F.col("shard"))).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for all documents, by the law `bytes`.

    size is the text's UTF-8 bytes plus 1 (null text: 1); text_crc32 is unsigned, of the empty string
    for null. grown_shard is null: contiguous shards move when the shard count grows. Columns of docs
    other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = byte_shards(materialize(rows, "sizes"), "doc_id", "size", "text_crc32", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
