"""The corpus operators as queries over the documents table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksift.llm import byte_bpe, fingerprint, jpeg, language, lexical, license, linededup, minhash, pieces, toxicity, whitening
from stacksift.llm.common import documents, small_batches
from stacksift.llm.mixing import mix
from stacksift.llm.sharding import shard_documents


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return minhash.classes(documents(spark, sf_dir)).drop("uid", "k1", "k2")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, learned from the labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels)).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that stand earlier in the corpus."""
    found = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "text")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited form, compared with each other and with the next document's."""
    found = fingerprint.edited_documents(documents(spark, sf_dir))
    own, edited, after = F.col("s"), F.col("edited_sketch"), F.col("next_sketch")
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint.fingerprint_text(own).alias("fingerprint"),
        fingerprint.fingerprint_text(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, after).alias("near_next"),
        fingerprint.containment(own, edited).alias("contained_in_edited"),
        fingerprint.containment(own, after).alias("contained_in_next"),
    )


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's text as stored in JPEG samples and as read back from them."""
    found = jpeg.media_columns(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2(F.col("thumbnail"), 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"),
        "images",
    )


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections in every document, in digest form."""
    return license.scan_documents(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of all sources."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_at.slot", "mix_at.block", "mix_at.release", "mix_at.due", "mix_at.offset", "mix_at.weight", "mix_at.total")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.round_trip(documents(spark, sf_dir).select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the leading whitened components of the distinct ones."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("packed"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "n_split",
    )


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprint": op4_fingerprint,
    "op5_media": op5_media,
    "op6_license": op6_license,
    "op7_mixing": op7_mixing,
    "op8_pieces": op8_pieces,
    "op9_language": op9_language,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical": op13_lexical,
}
QUERIES = {name: in_small_batches(query) for name, query in QUERIES.items()}

#: CRC-32 of the UTF-8 bytes, by its table of 256 remainders.
CRC_TABLE = "SELECT list(list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) r(i)"
SHARDS_SQL = f"""WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_transform(range(0, CAST(length(h) // 2 AS BIGINT)), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, ({CRC_TABLE})),
d AS (SELECT *, CAST(least(7, ((2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size) * 8) // (2 * sum(size) OVER ())) AS INT) AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d"""

#: Whole weights, earliest-deadline-first slot by slot over the whole run, then each source's blocks by the MD5 of doc_id.
MIX_SQL = """WITH RECURSIVE c AS (SELECT coalesce('=' || source, 'null') AS key, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT key, n, greatest(256, CAST(floor(pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * 1048576 + 0.5) AS BIGINT)) AS w FROM c),
a AS (SELECT list(w ORDER BY key) AS w, CAST(sum(w) AS BIGINT) AS u FROM s),
z AS (SELECT max(((n + 63) // 64 * u + s.w - 1) // s.w) AS slots FROM s, a),
e AS (SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done FROM a
    UNION ALL SELECT t, pick, list_transform(done, lambda d, i: d + CASE WHEN i = pick THEN 1 ELSE 0 END) FROM (
        SELECT e.t + 1 AS t, done, list_min(list_filter(list_transform(range(1, len(w) + 1), lambda i: {'due': ((done[i] + 1) * u + w[i] - 1) // w[i], 'i': i,
            'rel': done[i] * u // w[i]}), lambda j: j.rel <= e.t + 1)).i AS pick FROM e, a, z WHERE e.t < slots - 1)),
k AS (SELECT key, w, row_number() OVER (ORDER BY key) AS i FROM s),
p AS (SELECT key, w, list(t ORDER BY t) AS slots FROM e JOIN k ON i = pick WHERE t >= 0 GROUP BY ALL),
r AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, row_number() OVER (PARTITION BY source ORDER BY md5('mix' || coalesce(CAST(doc_id AS STRING), 'null'))) - 1 AS rank FROM documents)
SELECT doc_id, source, slots[rank // 64 + 1] AS slot, rank // 64 AS block, (rank // 64) * u // p.w AS release, ((rank // 64 + 1) * u + p.w - 1) // p.w AS due,
    CAST(rank % 64 AS INT) AS offset, p.w AS weight, u AS total FROM r JOIN p USING (key), a"""

#: Every score of every document for every item; whole numbers but for the logarithm.
TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
LEXICAL_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, {TERMS} AS ts FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op7_mixing": MIX_SQL, "op10_sharding": SHARDS_SQL, "op13_lexical": LEXICAL_SQL}
