"""Threshold-scaled sketches of word shingles: all hashes below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from stacksift.llm.common import Ranges, partitions

WORDS = 5
#: Share of the hash range that is kept.
FRACTION = 0.25
#: Letters of scripts that are written without spaces; each is a word of its own.
UNSPACED = r"[\u0e01-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"


def shingle_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with an array of 64-bit hashes, one per run of WORDS words; a shorter text is one shingle.

    Words are the lower-cased parts between ASCII white space; letters of unspaced scripts are words too.
    A text without words has no shingle.
    """
    low = F.translate(F.lower(F.col(text)), "\t\n\x0b\x0c\r", "     ")
    spaced = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, UNSPACED, " $0 "))
    words = F.array_remove(F.split(spaced, " "), "")
    hashed = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    w = [F.get(F.col(out), F.lit(0) + k) for k in range(WORDS - 1)]
    run = F.transform(F.sequence(F.lit(0), F.size(out) - WORDS), lambda i: F.xxhash64(*[F.get(F.col(out), i + k) for k in range(WORDS)]))
    short = F.when(F.size(out) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.size(out), *w)))
    return hashed.withColumn(out, F.when(F.size(out) >= WORDS, run).otherwise(short))


def sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """df with the sketch of a text column: its distinct shingle hashes below the fraction, ascending.

    A hash counts as an unsigned number of 62 bits, its sign and lowest bit dropped. Where no hash is
    below the fraction, the sketch is the least one alone, so no text with words has an empty sketch;
    such an element is above the limit, by which merge() can tell it.
    """
    hashed = shingle_hashes(df, text, out)
    values = hashed.withColumn(out, F.transform(F.col(out), lambda h: F.shiftrightunsigned(h, 2)))
    kept = F.filter(F.col(out), lambda h: h < limit(fraction))
    return values.withColumn(out, F.when(F.exists(F.col(out), lambda h: h < limit(fraction)), F.array_sort(F.array_distinct(kept))).otherwise(F.slice(F.array_sort(F.col(out)), 1, 1)))


def limit(fraction: float) -> Column:
    return F.lit(int(fraction * 2**62))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts together, from their sketches."""
    both = F.array_union(a, b)
    kept = F.filter(both, lambda h: h < limit(fraction))
    return F.when(F.size(kept) > 0, F.array_sort(kept)).otherwise(F.slice(F.array_sort(both), 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; two empty sketches: 1, one: 0."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts; two empty sketches: 1."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(1.0)


def fingerprint_text(s: Column) -> Column:
    return F.array_join(s.cast("array<string>"), ",")


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt to ranges of doc_id, so that a window over `at` in in_order() sees each row's next.

    The last row of each range also visits the next range, as a guest, and that of the last range the first
    one: the next row of the least doc_id is the greatest. Texts are shuffled once. Rows of one doc_id, and
    those without one, are cut further by their texts' hashes. One key per range comes to the driver.
    """
    spark = docs.sparkSession
    ranges = Ranges.of(docs, "doc_id", 2 * partitions(spark))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    placed = keyed.withColumn("b", ranges.number(F.col("doc_id"), F.col("h")))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    ends = sorted(placed.select("b", place.alias("place")).groupBy("b").agg(F.max("place").alias("place")).collect())
    after = [(b, x["doc_id"], x["h"], to[0]) for (b, x), to in zip(ends, ends[1:] + ends[:1], strict=True)]
    visits = spark.createDataFrame(after, "b int, end_id long, end_h long, to int")  # one row per range
    is_end = F.col("doc_id").eqNullSafe(F.col("end_id")) & (F.col("h") == F.col("end_h"))
    homes = F.array_compact(F.array(F.struct(F.col("b").alias("at"), F.lit(False).alias("guest")), F.when(is_end, F.struct(F.col("to").alias("at"), F.lit(True).alias("guest")))))
    dealt = placed.join(F.broadcast(visits), "b").select("doc_id", "text", "h", F.explode(homes).alias("home"))
    return dealt.select("doc_id", "text", "h", "home.at", "home.guest").repartition(ranges.count, "at")


def in_order() -> WindowSpec:
    return Window.partitionBy("at").orderBy(F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), "h")


def edited_documents(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, text, s, next_sketch, edited, edited_sketch) for each row; s is the text's sketch.

    Null text counts as empty. A text's edited form has its last floor(n / 3) code points replaced by as
    many from the start of the next document's text in descending doc_id (nulls last; rows of one doc_id by
    their texts' hashes; after the last the first; a single row is its own next). Equal texts get equal
    sketches. Other columns are left out. An empty table gives an empty result.
    """
    dealt = beside_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    rows = sketch(dealt, "text", "s", fraction)
    pairs = rows.withColumn("next", F.lag(F.struct("text", "s")).over(in_order())).where(~F.col("guest"))
    cut = F.expr("cast(floor(char_length(text) / 3) as int)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    full = pairs.select("doc_id", "text", "s", F.col("next.s").alias("next_sketch"), edited.alias("edited"))
    return sketch(full, "edited", "edited_sketch", fraction)
