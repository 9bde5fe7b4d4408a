"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.operators.batches import give_back, slices, small_batches, tidy  # noqa: F401
from stacksift.sources.staging import drop_folder, staging_folder, written_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder. See forget()."""
    path = staging_folder(df.sparkSession, name)
    table = written_table(df, path)
    table.own_folder = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more: all that came of them is in other tables."""
    for t in tables:
        drop_folder(t.sparkSession, t.own_folder)


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """df, its columns of these names (in any case) renamed to <name>_input, so that results can have the names."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_input"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Ranges:
    """Ranges of an integer key, nulls first; those of a hot key are cut further by a hash.

    cuts ascend; a key that is cut m times holds about m ranges' rows, which are dealt to m ranges by the
    hash's size. Only these few values come to the driver: their number follows the shuffle partitions.
    """

    cuts: list[int]
    null_parts: int

    @classmethod
    def of(cls, df: DataFrame, key: str, n: int) -> Ranges:
        at = [i / n for i in range(1, n)]
        cut = F.percentile_approx(key, at, max(10_000, 20 * n)) if at else F.array().cast("array<long>")
        found = df.agg(cut.alias("c"), F.count("*").alias("n"), F.count(key).alias("known")).first()
        return cls(sorted(found["c"] or []), -(-(found["n"] - found["known"]) * n // max(1, found["n"])))

    @property
    def count(self) -> int:
        return self.null_parts + len(self.cuts) + 1

    def number(self, key: Column, digest: Column) -> Column:
        """The range of a row, from 0. digest: a long that orders rows of equal key."""
        share = F.shiftrightunsigned(digest.bitwiseXOR(F.lit(-(2**63))), 33).cast("double") / 2.0**31
        known = below(key, self.cuts, True)
        if len(set(self.cuts)) < len(self.cuts):
            low = below(key, self.cuts, False)
            known = F.when(known - low < 2, known).otherwise(low + 1 + F.floor(share * (known - low)).cast("int"))
        nulls = F.floor(share * self.null_parts).cast("int")
        return F.when(key.isNull(), nulls).otherwise(known + self.null_parts)


def below(key: Column, bounds: list[int], equal: bool) -> Column:
    """How many of the ascending bounds are < key, or <= key, in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    every = F.array(*[F.lit(int(b)) for b in bounds])
    coarse = F.array(*[F.lit(int(b)) for b in bounds[::step]])
    fits = (lambda b: b <= key) if equal else (lambda b: b < key)
    block = F.size(F.filter(coarse, fits))
    within = F.size(F.filter(F.slice(every, (block - 1) * step + 1, F.lit(step)), fits))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + within)


def lookup(values: list[int], index: Column) -> Column:
    """values[index] for a short driver-side list."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index)


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def bounded_sample(rows: DataFrame, group: str, key: str, most: int, cells: int = 64) -> DataFrame:
    """At most `most` rows of each group, chosen by a hash of key, with their rank rn from 1.

    The group column must have few values and no nulls; keep rows narrow. Groups are first thinned by their
    counts to about twice `most`, and ranked in cells of the hash range, so that a hot group has no task of its own.
    """
    per = F.broadcast(rows.groupBy(group).agg(F.count("*").alias("n")))  # one row per group
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    thin = rows.join(per, group).withColumn("_up_to", F.lit(2.0 * most * (1 << 20)) / F.col("n")).withColumn("_place", place).where("_place < _up_to")
    cell = F.floor(F.col("_place") * cells / F.least("_up_to", F.lit(float(1 << 20)))).cast("int")
    thin = materialize(thin.select(*rows.columns, "_place", cell.alias("_cell")), "thin")
    counts = thin.groupBy(group, "_cell").agg(F.count("*").alias("n"))  # at most `cells` rows per group
    before = counts.select(group, "_cell", (F.sum("n").over(Window.partitionBy(group).orderBy("_cell")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy(group, "_cell").orderBy("_place", F.xxhash64(key), key)
    ranked = thin.join(F.broadcast(before), [group, "_cell"]).withColumn("rn", (F.col("_before") + F.row_number().over(inside)).cast("int"))
    return ranked.where(F.col("rn") <= most).select(*rows.columns, "rn")


def document_keys(docs: DataFrame) -> DataFrame:
    """Adds k1 and k2, two 64-bit hashes of doc_id and text that name a document."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc_id"))
