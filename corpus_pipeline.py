"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back
as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksift.llm import language, linededup, minhash, mixing, pieces
from stacksift.llm.common import documents, materialize, partitions, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and gives those without a lang the predicted one.

    Where nothing could be learned, lang stays null and documents with letters stay all the same.
    """
    small_batches(spark)
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    found = language.identify(whole, language.fit(docs))
    learned = F.col("score") > 0
    lettered = found.where(learned | F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    filled = F.coalesce("r.lang", F.when(learned, F.col("lang_pred")))
    return lettered.select(*[(filled if c == "lang" else F.col(f"r.`{c}`")).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand earlier in the corpus; n_chars follows the text. All rows stay."""
    small_batches(spark)
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("r"))
    own = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return linededup.dedup_lines(whole).select(*[own.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    small_batches(spark)
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the mixture: part files follow the slots, rows the place in a slot."""
    whole = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    ordered = mixing.mix(whole).repartitionByRange(partitions(spark), "mix_at.slot").sortWithinPartitions("mix_at.slot", "mix_at.offset")
    return ordered.select("r.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids, round_trip): piece ids, and whether they decode to the text."""
    small_batches(spark)
    found = pieces.round_trip(docs.select("doc_id", "lang", "source", "n_chars", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Signatures, edit joins and piece ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
