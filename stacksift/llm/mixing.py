"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksift.llm.common import Ranges, materialize, partitions, renamed

#: Weights are whole numbers of about this many in all.
UNITS = 1 << 20
#: The least share of a lane in all slots, and that of sources without a weight where weights are given.
LEAST = 1 / 4096
#: Slots that are scheduled together in one row.
ROUND = 4096
#: Sources with a lane of their own: the heaviest. Lighter ones share a lane with those of like weight.
LANES = 128


def source_key(source: Column) -> Column:
    """A text that is never null: null sources form a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def weighted(counts: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(key, n, w) of counts (key, n): whole weights w that follow the targets, the given ones or else n ** power, as shares of UNITS."""
    if weights is None:
        aimed = counts.withColumn("t", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = counts.sparkSession.createDataFrame([("=" + name, float(w)) for name, w in weights.items() if w > 0], "key string, t double")
        aimed = counts.join(F.broadcast(given), "key", "left")  # as many rows as the caller gave
    total = aimed.agg(F.sum("t").alias("t")).first()["t"] or 1.0
    return aimed.select("key", "n", F.greatest(F.lit(1), F.floor(F.coalesce(F.col("t") / total, F.lit(LEAST)) * UNITS + 0.5)).cast("long").alias("w"))


@dataclass(frozen=True)
class Lane:
    key: str
    weight: int
    blocks: int


def with_lanes(sources: DataFrame, block_rows: int) -> tuple[DataFrame, list[Lane]]:
    """sources (key, n, w) with lane, blocks and pooled; and the lanes by key, which are few whatever the sources.

    The LANES heaviest sources are lanes. The others are pooled by the power of two below their weight, so
    that sources of a pool have weights within a factor of two.
    """
    sized = sources.withColumn("blocks", F.expr(f"(n + {block_rows - 1}) div {block_rows}"))
    heavy = [r["key"] for r in sized.orderBy(F.desc("w"), "key").limit(LANES).select("key").collect()]
    pooled = ~F.col("key").isin(heavy)
    placed = sized.withColumn("pooled", pooled).withColumn("lane", F.when(pooled, F.concat(F.lit("~"), F.floor(F.log2("w")).cast("string"))).otherwise(F.col("key")))
    found = placed.groupBy("lane").agg(F.sum("w").alias("w"), F.sum("blocks").alias("blocks")).collect()  # LANES and one per power of two
    least = int(UNITS * LEAST)
    placed = placed.withColumn("w", F.when(F.col("pooled"), F.col("w")).otherwise(F.greatest("w", F.lit(least))))
    return placed, sorted((Lane(r["lane"], max(r["w"], least), r["blocks"]) for r in found), key=lambda x: x.key)


def schedule(spark, lanes: list[Lane]) -> DataFrame:
    """(lane, block, slot): the slot of every block of every lane.

    With weight w of a total U, a lane's block k (from 0) is released at floor(k * U / w) and due by
    ceil((k + 1) * U / w). Each slot goes to the released block that is due first (ties: the first lane).
    One unit per slot and a full load make earliest-deadline-first meet all deadlines, so after any number
    of slots each lane is less than one block away from its share of the whole run, for as long as it has blocks;
    a lane without blocks leaves its slots unused.

    Rounds of ROUND slots are rows of their own and need no others: which blocks are done when slot t0
    begins follows from the weights. All blocks due by t0 are. Of those that are released before t0 and due after
    it, the first by deadline are too, as far as there is room: for every slot a before t0, all that is done
    and was released from a on must fit into the slots a to t0. No lane has a block open for more
    than 1 / LEAST slots, so no a further back needs to be looked at.
    """
    total = sum(x.weight for x in lanes)
    last = max(-(-x.blocks * total // x.weight) for x in lanes)
    rounds = spark.range(0, -(-last // ROUND), 1, partitions(spark)).select((F.col("id") * ROUND).alias("t0"))
    table = rounds.withColumn("all", F.array(*[F.struct(F.lit(x.weight).cast("long").alias("w"), F.lit(x.blocks).cast("long").alias("b")) for x in lanes]))
    u = f"{total}L"
    begun = f"""array_sort(transform(filter(transform(all, (x, i) -> named_struct('i', i, 'w', x.w, 'k', (x.w * t0) div {u})), s -> (s.w * t0) % {u} <> 0),
        s -> named_struct('due', ((s.k + 1) * {u} + s.w - 1) div s.w, 'i', s.i, 'rel', (s.k * {u}) div s.w)))"""
    room = f"t0 - a - aggregate(all, 0L, (n, y) -> n + greatest(0L, (y.w * t0) div {u} - (a * y.w + {u} - 1) div {u}))"
    most = f"(t0 - aggregate(all, 0L, (n, y) -> n + (y.w * t0) div {u}))"
    early = f"""aggregate(begun, named_struct('slack', transform(sequence(low, t0 - 1), a -> {room}), 'early', cast(array() as array<int>)),
        (acc, s) -> if(size(acc.early) < {most} and array_min(slice(acc.slack, 1, cast(s.rel - low + 1 as int))) >= 1, named_struct(
            'slack', transform(acc.slack, (v, j) -> if(j <= s.rel - low, v - 1, v)), 'early', array_append(acc.early, s.i)), acc)).early"""
    early = f"if(size(begun) = 0, cast(array() as array<int>), transform(array(array_min(transform(begun, s -> s.rel))), low -> {early})[0])"
    early = f"transform(array({begun}), begun -> {early})[0]"
    done = f"transform(array({early}), early -> transform(all, (x, i) -> (x.w * t0) div {u} + if(array_contains(early, i), 1L, 0L)))[0]"
    ready = f"""filter(transform(all, (x, i) -> named_struct('due', ((acc.done[i] + 1) * {u} + x.w - 1) div x.w, 'i', i, 'rel', (acc.done[i] * {u}) div x.w)), j -> j.rel <= t0 + t)"""
    picks = f"""aggregate(sequence(0L, least({ROUND}L, {last}L - t0) - 1), named_struct('done', {done}, 'picks', cast(array() as array<struct<i: int, k: bigint>>)),
        (acc, t) -> transform(array(array_min({ready}).i), p -> named_struct(
            'done', transform(acc.done, (c, i) -> c + if(i = p, 1L, 0L)),
            'picks', array_append(acc.picks, named_struct('i', p, 'k', acc.done[p]))))[0]).picks"""
    each = table.select("t0", "all", F.posexplode(F.expr(picks)).alias("t", "p")).where("p.k < all[p.i].b")
    names = F.array(*[F.lit(x.key) for x in lanes])
    return each.select(F.get(names, F.col("p.i")).alias("lane"), F.col("p.k").alias("block"), (F.col("t0") + F.col("t")).alias("slot"))


def pool_order(sources: DataFrame, total: int) -> DataFrame:
    """(key, block, lane, place) of the pooled sources' blocks: places in their lane by deadline, then key and block."""
    blocks = sources.where("pooled").select("lane", "key", "w", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    blocks = materialize(blocks.withColumn("due", F.expr(f"((block + 1) * {total}L + w - 1) div w")), "blocks")
    ranges = Ranges.of(blocks, "due", partitions(sources.sparkSession))
    cut = blocks.withColumn("h", F.xxhash64("key")).withColumn("range", ranges.number(F.col("due"), F.col("h")))
    counts = cut.groupBy("lane", "range").agg(F.count("*").alias("n"))
    before = counts.select("lane", "range", (F.sum("n").over(Window.partitionBy("lane").orderBy("range")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("lane", "range").orderBy("due", "h", "key", "block")
    return cut.join(before, ["lane", "range"]).select("key", "block", "lane", (F.col("before") + F.row_number().over(inside) - 1).alias("place"))


def mix(docs: DataFrame, block_rows: int = 64, weights: dict[str, float] | None = None, power: float = 0.5, seed: str = "mix") -> DataFrame:
    """docs with a column mix_at: struct(slot, block, release, due, offset, weight, total).

    Order by (mix_at.slot, mix_at.offset) to get the mixture. A source's documents, shuffled by a hash
    of doc_id, form blocks of block_rows (the last may be short); block i runs in the slot that the
    schedule gives it: see schedule(). Without weights, targets follow each source's row count to the
    given power; they are kept to a millionth of all slots. A source that is not in the given weights gets
    a share of LEAST. All rows stay: when a source has no blocks left, its later slots stay unused
    and the others keep their order, so the tail of the run holds the sources that are left.

    From the LANES heaviest sources on, the lighter ones share lanes: a lane meets its weight to less than a
    block, and within it blocks are in order of deadline, so a source of n in its lane is at most
    about 2 * n / (n + 1) blocks early besides, while the lane's sources have blocks.

    A hot source is ranked in many parts: rows are cut by ranges of the hash, the counts per part give
    offsets, and a window runs inside each part only. Null source: a source of its own. Null doc_ids
    and repeated rows are ordered by the row's hash. An input column mix_at becomes mix_at_input. An empty
    table gives an empty result.
    """
    spark, docs = docs.sparkSession, renamed(docs, "mix_at")
    parts = partitions(spark)
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    part = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * parts / F.lit(2**32)).cast("int")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("r"), source_key(F.col("source")).alias("key"), part.alias("part"), digest.alias("h"))
    counts = materialize(rows.groupBy("key", "part").agg(F.count("*").alias("n")), "counts")
    offsets = counts.select("key", "part", "n", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"))
    sources, lanes = with_lanes(weighted(counts.groupBy("key").agg(F.sum("n").alias("n")), weights, power), block_rows)
    if not lanes:
        kind = "struct<slot: bigint, block: bigint, release: bigint, due: bigint, offset: int, weight: bigint, total: bigint>"
        return rows.select("r.*", F.lit(None).cast(kind).alias("mix_at")).limit(0)
    total = sum(x.weight for x in lanes)
    slots = schedule(spark, lanes)
    if any(x.key.startswith("~") for x in lanes):
        order, slots = pool_order(sources, total), materialize(slots, "slots")
        shared = order.join(slots.withColumnRenamed("block", "place"), ["lane", "place"]).select("key", "block", "slot")
        slots = slots.where(~F.col("lane").startswith("~")).select(F.col("lane").alias("key"), "block", "slot").union(shared)
    else:
        slots = slots.withColumnRenamed("lane", "key")
    touched = offsets.withColumn("block", F.explode(F.expr(f"sequence(before div {block_rows}, (before + n - 1) div {block_rows})")))
    per_part = touched.join(slots, ["key", "block"]).groupBy("key", "part").agg(F.min("before").alias("before"), F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("s"))  # the blocks of one part
    plan = materialize(per_part.join(sources.select("key", "w"), "key").select("key", "part", "before", "w", F.expr("transform(s, x -> x.slot)").alias("slots")), "plan")
    inside = Window.partitionBy("key", "part").orderBy("h", F.xxhash64("r"))
    placed = (
        rows.withColumn("rn", F.row_number().over(inside))
        .join(plan, ["key", "part"])
        .withColumn("rank", F.col("before") + F.col("rn") - 1)
        .withColumn("block", F.expr(f"rank div {block_rows}"))
    )
    at = F.struct(
        F.expr(f"slots[cast(block - before div {block_rows} as int)]").alias("slot"),
        "block",
        F.expr(f"(block * {total}L) div w").alias("release"),
        F.expr(f"((block + 1) * {total}L + w - 1) div w").alias("due"),
        F.expr(f"cast(rank % {block_rows} as int)").alias("offset"),
        F.col("w").alias("weight"),
        F.lit(total).cast("long").alias("total"),
    )
    return placed.select("r.*", at.alias("mix_at"))
