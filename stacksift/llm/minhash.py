"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacksift.llm.common import document_keys, forget, give_back, materialize, slices, tidy
from stacksift.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with probability 0.9999.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Each round compares the members of a bucket with its hubs up to this rank.
RANKS = (1, 6, 16)
#: Candidate texts up to this number are broadcast by id to fetch their shingle sets; more are joined.
FEW = 500_000
#: Texts, and shingles, of about one chunk of a bucket that is compared in blocks of two chunks.
CHUNK, CHUNK_SHINGLES = 256, 400_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (splitmix64)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Characters:
    """Maps code points to the lower-case character of a word, and all others to 0."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            t = np.zeros(0x110000, dtype=np.uint32)
            inside = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), dtype=bool, count=0x110000)
            for c in np.flatnonzero(inside).tolist():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
            cls.table = t
        return cls.table


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(hash of each word, number of its text, digest of each text's words in order).

    Words are runs of letters, digits and underscores, in lower case. The digest of a text without words
    is that of the text itself, null being empty.
    """
    whole = [(t or "") + "\n" for t in texts]
    code = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in whole])
    c = Characters.get()[code]
    inside = c > 0
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    row = np.repeat(np.arange(len(texts)), lengths)[begin] if len(begin) else np.zeros(0, dtype=np.int64)
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    h = np.zeros(0, dtype=np.uint64)
    if len(begin):
        place = np.flatnonzero(inside)
        in_word = place - np.repeat(begin, end - begin)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(in_word.max()), 0x100000001B3, dtype=np.uint64)]))
        starts = np.concatenate([[0], (end - begin).cumsum()[:-1]])
        h = mixed(np.add.reduceat((c[place].astype(np.uint64) + np.uint64(0x632BE5AB)) * power[in_word], starts))
    keep = inside | np.concatenate([[False], inside[:-1]])  # words, each with one mark behind it
    kept = c[keep]
    edges = np.concatenate([[0], keep.cumsum()])[np.concatenate([[0], lengths.cumsum()])]
    digests = [
        hashlib.blake2b(kept[a:b].tobytes() if b > a else b"raw" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for t, a, b in zip(whole, edges, edges[1:], strict=False)
    ]
    return h, row, digests


def shingles(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of WORDS words of each text: (hash, text, weight), by text and hash.

    All weights are 1, however often a run occurs, so that bands go by the plain set likeness that links need.
    """
    n = len(h) - WORDS + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        total = mixed(total ^ h[k : k + n])
    ok = row[:n] == row[WORDS - 1 :]
    s, r = total[ok], row[:n][ok]
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    return s[at], r[at], np.ones(len(at))


def signatures(s: np.ndarray, r: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """ProbMinHash: REGISTERS elements of each text; two texts' registers agree with probability J_P, for equal weights the set Jaccard.

    Each element arrives as a Poisson process whose rate is its weight, at a random register each time.
    A register keeps the element that arrives first. Arrivals are drawn in rounds for all texts together;
    an element stops as soon as its time is past its text's slowest register.
    """
    first = np.full(texts * REGISTERS, np.inf)
    winner = np.zeros(texts * REGISTERS, dtype=np.uint64)
    slowest = np.full(texts, np.inf)
    live, time, step = np.arange(len(s)), np.zeros(len(s)), np.zeros(len(s), dtype=np.uint64)
    while len(live):
        width = int(np.clip(20_000 // len(live), 1, 64))
        count = step[live][:, None] + np.arange(1, width + 1, dtype=np.uint64)
        draw = mixed(s[live][:, None] ^ (count * np.uint64(0xD1342543DE82EF95)))
        wait = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[live][:, None]
        at = time[live][:, None] + wait.cumsum(axis=1)
        register = (mixed(draw) % np.uint64(REGISTERS)).astype(np.int64)
        slot = r[live][:, None] * REGISTERS + register
        useful = at < first[slot]
        slots, times, who = slot[useful], at[useful], np.broadcast_to(s[live][:, None], at.shape)[useful]
        np.minimum.at(first, slots, times)
        won = first[slots] == times
        winner[slots[won]] = who[won]
        slowest = first.reshape(texts, REGISTERS).max(axis=1)
        time[live], step[live] = at[:, -1], count[:, -1]
        live = live[at[:, -1] < slowest[r[live]]]
    return winner.reshape(texts, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    grid = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grid.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key ^ grid[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, digest, bands, shingles) of every row; texts under WORDS words have no bands and no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h, row, digests = words_of(b.column("text").to_pylist())
                s, r, weight = shingles(h, row)
                n = b.num_rows
                keys = band_keys(signatures(s, r, weight, n))
                has = np.bincount(r, minlength=n) > 0
                edges = np.concatenate([[0], np.bincount(r, minlength=n).cumsum()])
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], (has * BANDS).cumsum()]), pa.int32()), pa.array(keys[has].ravel()))
                short = (s >> np.uint64(32)).astype(np.uint32).view(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(short))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(digests, pa.binary()), bands, sets], ["doc_id", "k1", "k2", "digest", "bands", "shingles"])

    return document_keys(docs.select("doc_id", "text")).mapInArrow(tidy(run), "doc_id long, k1 long, k2 long, digest binary, bands array<long>, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def block_links(similarity: float):
    """A function from one block's texts (uid, label, shingles) to pairs (a, b) that link all its classes that are to be linked."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        uid, label, sets = block["uid"].to_numpy(), block["label"].to_numpy(), block["shingles"].to_list()
        n, out = len(uid), []
        if n and (label != label[0]).any():
            size = np.array([len(s) for s in sets])
            _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row, shared = np.repeat(np.arange(n), size), np.zeros((n, n))
            place = np.where(often > 1, (often > 1).cumsum() - 1, -1)[column]
            order = np.argsort(place, kind="stable")
            order = order[place[order] >= 0]
            row, place = row[order], place[order]
            width = 4096
            for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
                a, b = np.searchsorted(place, [low, low + width])
                grid = np.zeros((n, width), dtype=np.float32)
                grid[row[a:b], place[a:b] - low] = 1
                shared += grid @ grid.T
            near = (shared >= similarity * (size[:, None] + size[None, :] - shared)) & (label[:, None] != label[None, :])
            root = {x: x for x in label.tolist()}

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in np.argwhere(np.triu(near)).tolist():
                x, y = top(int(label[i])), top(int(label[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(uid[i], uid[j]), max(uid[i], uid[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def remaining_links(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame | None:
    """Links (a, b) between the classes that share a bucket of more than `most` texts; None if no such bucket holds several.

    members: (key, uid). Every pair of texts of different classes in such a bucket is compared. A class of at
    least CHUNK texts of the bucket forms chunks of its own, the others are chunked together by a hash, and a
    task compares two chunks, but not two of one class: work grows with the pairs of different classes.
    """
    named = members.select("key", "uid").join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    open_ones = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where((F.col("n") > most) & (F.col("x") != F.col("y"))).select("key")
    open_ones = materialize(open_ones, "several")
    if open_ones.isEmpty():
        forget(open_ones)
        return None
    named = materialize(named.join(open_ones, "key").join(sets.select("uid", F.size("shingles").alias("w")), "uid"), "open")
    per = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    per = materialize(per.withColumn("part", F.when(F.col("n") >= CHUNK, F.col("label")).otherwise(-1)), "parts")  # -1: the small classes
    number = F.ceil(F.greatest(F.sum("n") / F.lit(CHUNK), F.sum("w") / F.lit(CHUNK_SHINGLES))).cast("long")
    sizes = materialize(per.groupBy("key", "part").agg(number.alias("m")), "sizes")
    chunks = sizes.select("key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("chunk"))
    one, other = (chunks.select("key", F.struct("part", "chunk").alias(c)) for c in ("one", "other"))
    pairs = one.join(other, "key").where("one <= other and (one.part <> other.part or one.part = -1)")
    pairs = materialize(pairs.withColumn("block", F.struct("key", "one", "other")), "blocks")
    placed = named.join(per.select("key", "label", "part"), ["key", "label"]).join(sizes, ["key", "part"])
    at = F.struct("part", F.pmod(F.xxhash64("uid"), F.col("m")).alias("chunk"))
    placed = materialize(placed.select("key", "uid", "label", at.alias("at")), "placed")
    sides = pairs.select("key", "block", F.explode(F.array_distinct(F.array("one", "other"))).alias("at"))
    blocks = sides.join(placed, ["key", "at"]).join(sets, "uid").select("block", "uid", "label", "shingles")
    found = materialize(blocks.groupBy("block").applyInPandas(block_links(similarity), "a long, b long").distinct(), "links")
    forget(open_ones, named, per, sizes, pairs, placed)
    return found


def links(texts: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """(node, label) of texts (uid, bands) that are linked to others; label is the least uid of the class. sets: (uid, shingles).

    Texts that share a band are candidates. A bucket is not expanded into pairs: its members are compared
    with the bucket's hub, the member that meets most others over all its buckets, which for a text and its
    edited copies is the original. Where a bucket then holds several classes, its members are compared with
    its hubs of the next ranks, unless they are of one class by then. So buckets of up to ranks[-1] texts
    are resolved in full. In larger ones that still hold several classes, all texts of different classes
    are compared, in blocks (remaining_links).
    """
    used: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        used.append(materialize(df, name))
        return used[-1]

    bands = texts.select("uid", F.explode("bands").alias("key"))
    shared = keep(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = keep(bands.join(shared.hint("merge"), "key"), "members")  # both grow with the corpus: one plan for every size
    degree = members.groupBy("uid").agg(F.sum("n").alias("degree"))
    members = keep(members.select("key", "uid").join(degree, "uid"), "members")
    wanted = members.select("uid").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = keep(sets.join(wanted, "uid"), "sets")  # the only time that shingle sets of texts without candidates are touched
    by_degree = Window.partitionBy("key").orderBy(F.desc("degree"), "uid")
    edges = pairs = labels = None
    for low, high in zip((0, *ranks), ranks, strict=False):
        if labels is None:
            named = members.withColumn("label", F.col("uid"))
        else:
            named = members.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
            named = keep(named, "named")
            several = keep(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), "several")
            named = keep(named.join(several, "key"), "open")
        top = named.withColumn("rank", F.row_number().over(by_degree)).where(F.col("rank") <= high).where(F.col("rank") > low)
        hubs = keep(top.groupBy("key").agg(F.collect_list(F.struct(F.col("uid").alias("hub"), F.col("label").alias("other"))).alias("hubs")), "hubs")  # at most high - low of them
        foreign = F.filter("hubs", lambda h: h["other"] != F.col("label"))
        met = named.join(hubs, (named["key"] == hubs["key"]) & (F.size(foreign) > 0)).select("uid", F.transform(foreign, lambda h: h["hub"]).alias("h"))
        each = met.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("h"))  # of at most BANDS buckets
        fresh = each.select("uid", F.explode("h").alias("hub")).select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b")).distinct()
        if pairs is not None:
            fresh = fresh.join(pairs, ["a", "b"], "left_anti")
        fresh = keep(fresh, "pairs")
        found = keep(verified(fresh, texts, similarity), "links")
        edges, pairs = (found, fresh) if edges is None else (edges.union(found), pairs.union(fresh))
        labels = components(edges)
        used.append(labels)
    rest = remaining_links(members, labels, texts, similarity, ranks[-1])
    if rest is not None:
        labels = components(edges.union(rest))
        used.append(labels)
    forget(*used[:-1])
    return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, doc_id, k1, k2, class_id, n_docs, n_texts, kept) for every row of docs; k1 and k2 are hashes of doc_id and text.

    Rows whose words are equal in order are copies; texts of at least WORDS words are linked if their sets
    of word runs have Jaccard similarity of at least `similarity`, and classes are what links connect.
    class_id is the least doc_id of the class, n_docs and n_texts its rows and different texts, and kept
    marks one row: of the least doc_id, nulls last. uid numbers the rows. Null and wordless texts are
    copies only of rows with the same text (null: empty). A lone row is its own class; null doc_ids are
    allowed, and a class of them alone has a null class_id. An empty table gives an empty result.

    Copies are grouped by digest before anything else, so a group of copies costs one signature's pairs;
    only ids, digests and band keys are shuffled, shingle sets for candidate pairs alone.
    """
    rows = materialize(sketches(docs).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("lead")
    copies = materialize(rows.groupBy("digest").agg(lead, F.count("*").alias("copies")).select("digest", "lead", F.col("lead.uid").alias("uid"), "copies"), "copies")
    texts = materialize(rows.select("uid", "bands").where(F.size("bands") > 0).join(copies.select("uid").hint("merge"), "uid"), "texts")
    labels = links(texts, rows.select("uid", "shingles"), similarity)
    named = materialize(copies.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid")), "named")
    sums = materialize(named.groupBy("label").agg(F.min("lead").alias("first"), F.sum("copies").alias("n_docs"), F.count("*").alias("n_texts")), "classes")
    by_digest = materialize(named.select("digest", "label").join(sums, "label").select("digest", "first", "n_docs", "n_texts"), "digests")
    forget(copies, texts, labels, named, sums)
    found = rows.select("uid", "doc_id", "k1", "k2", "digest").join(by_digest.hint("merge"), "digest")
    return found.select("uid", "doc_id", "k1", "k2", F.col("first.doc_id").alias("class_id"), "n_docs", "n_texts", (F.col("uid") == F.col("first.uid")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that classes() marks as kept: one of each near-duplicate class, all columns as they are."""
    kept = classes(docs, similarity).where("kept").select(F.col("k1").alias("kept_k1"), F.col("k2").alias("kept_k2"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    keyed = document_keys(whole.select("r", F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"))).select("r", "k1", "k2")
    found = keyed.join(materialize(kept, "kept"), (F.col("k1") == F.col("kept_k1")) & (F.col("k2") == F.col("kept_k2")))
    once = found.withColumn("rn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))  # rows repeated as a whole
    return once.where("rn = 1").select("r.*")
