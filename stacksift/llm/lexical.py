"""Exact ranked lexical search for many queries at once, by two trees of coordinate maxima."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.llm.common import forget, materialize, tidy

#: Distinct query terms, and queries, that are searched in one pass over the documents. Both are broadcast.
MOST_TERMS, MOST_ITEMS = 1 << 19, 1 << 12
#: Documents of one tree, of a node, and of a leaf; items of a leaf.
TREE, NODE, LEAF, ITEM_LEAF = 4096, 512, 64, 32
#: Every so many documents (by a hash) are searched first, to begin with good bounds.
SEED = 16
#: Whole numbers up to here are exact as doubles; bounds of larger ones are raised by this factor.
EXACT, ROOM = 1 << 53, 1 + 1e-9

#: Bytes of terms: digits, letters, and all of characters beyond ASCII; A-Z become a-z, everything else a blank.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Queries:
    """A batch of items: each as the ascending term numbers it holds, and how often."""

    vocabulary: dict[bytes, int]
    owner: np.ndarray  # item of each posting
    term: np.ndarray
    count: np.ndarray
    items: int

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        owner, term = [], []
        for i, text in enumerate(texts):
            for t in terms_of(text):
                owner.append(i)
                term.append(vocabulary.setdefault(t, len(vocabulary)))
        key, count = np.unique(np.array(owner, dtype=np.int64) * max(1, len(vocabulary)) + np.array(term, dtype=np.int64), return_counts=True)
        owners, terms = np.divmod(key, max(1, len(vocabulary)))
        return cls(vocabulary, owners, terms, count.astype(np.int64), len(texts))


def maxima(owner: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest value of each (owner, term), ascending."""
    if not len(owner):
        return owner, term, value
    key = owner * terms + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] // terms, key[first] % terms, np.maximum.reduceat(value[order], first)


def edges(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


class ItemTree:
    """Items with like terms side by side, in leaves of 32, under one root: for each node the coordinate maxima of weight times count."""

    def __init__(self, queries: Queries, weight: np.ndarray):
        self.terms, self.items = max(1, len(queries.vocabulary)), queries.items
        value = queries.count * weight[queries.term] if len(queries.term) else queries.count
        most = np.bincount(queries.owner, weights=value, minlength=self.items).max(initial=0.0) * 1_000_000  # an impact is less than this
        self.kind = float if most < EXACT else np.int64  # of scores
        heaviest = np.full(self.items, -1, dtype=np.int64)  # an item's place: by its heaviest term
        order = np.lexsort((value, queries.owner)) if len(value) else np.zeros(0, np.int64)
        heaviest[queries.owner[order]] = queries.term[order]
        self.item_at = np.argsort(heaviest, kind="stable")  # place -> item
        place = np.empty(self.items, dtype=np.int64)
        place[self.item_at] = np.arange(self.items)
        self.leaves = -(-self.items // ITEM_LEAF)
        self.root = maxima(np.zeros(len(value), np.int64), queries.term, value, self.terms)[1:]
        self.leaf = maxima(place[queries.owner] // ITEM_LEAF, queries.term, value, self.terms)
        self.by_term = np.argsort(self.leaf[1], kind="stable")  # postings of leaves by term
        self.term_edges = np.searchsorted(self.leaf[1][self.by_term], np.arange(self.terms + 1))
        self.blocks = []  # a leaf's terms and dense values, terms x items
        where = np.argsort(place[queries.owner], kind="stable")
        places, terms, values = place[queries.owner][where], queries.term[where], value[where]
        ends = np.searchsorted(places // ITEM_LEAF, np.arange(self.leaves + 1))
        for k in range(self.leaves):
            part = slice(ends[k], ends[k + 1])
            own = np.unique(terms[part])
            dense = np.zeros((len(own), min(ITEM_LEAF, self.items - k * ITEM_LEAF)), dtype=self.kind)
            dense[np.searchsorted(own, terms[part]), places[part] - k * ITEM_LEAF] = values[part]
            self.blocks.append((own, dense))

    def leaf_bounds(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each leaf, the greatest score that any of its items can reach with these coordinates."""
        begin, size = self.term_edges[term], self.term_edges[term + 1] - self.term_edges[term]
        ends = np.concatenate([[0], size.cumsum()])
        at = self.by_term[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return np.bincount(self.leaf[0][at], weights=self.leaf[2][at] * np.repeat(value, size), minlength=self.leaves) * ROOM

    def root_bound(self, term: np.ndarray, value: np.ndarray) -> float:
        return float(np.dot(self.root[1][np.searchsorted(self.root[0], term)].astype(float), value)) * ROOM


class Best:
    """The k best documents of every item so far: score, then least doc_id. Places as in the item tree."""

    def __init__(self, tree: ItemTree, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors[tree.item_at]  # scores that the k-th best is known to reach
        self.score = np.zeros((k, tree.items), dtype=tree.kind)
        self.doc = np.zeros((k, tree.items), dtype=np.int64)
        self.null = np.zeros((k, tree.items), dtype=bool)

    def bars(self, at: slice) -> np.ndarray:
        """What a score must reach to matter; at least 1."""
        return np.maximum(np.maximum(self.floors[at], self.score[-1, at]), 1)

    def add(self, at: slice, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items of these places; those below the bars are zero or do no harm."""
        some = np.flatnonzero((scores >= self.bars(at)).any(axis=1))
        if not len(some):
            return
        width = scores.shape[1]
        score = np.vstack([self.score[:, at], scores[some]])
        docs = np.vstack([self.doc[:, at], np.repeat(doc[some, None], width, 1)])
        nulls = np.vstack([self.null[:, at], np.repeat(null[some, None], width, 1)])
        order = np.lexsort((docs, ~nulls, -score), axis=0)[: self.k]
        self.score[:, at] = np.take_along_axis(score, order, 0)
        self.doc[:, at] = np.take_along_axis(docs, order, 0)
        self.null[:, at] = np.take_along_axis(nulls, order, 0)


def impacts(term: np.ndarray, tf: np.ndarray, owner: np.ndarray, words: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) for each posting, m = 25 + (75 * n * N) div L of its document."""
    some, back = np.unique(words, return_inverse=True)
    m = np.array([25 + 75 * int(n) * n_docs // n_words for n in some], dtype=np.int64)[back]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])


def search_chunk(tree: ItemTree, best: Best, doc: np.ndarray, null: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
    """Searches the documents of one chunk (owner: the document of each posting, ascending) for all items at once.

    The documents form a tree of nodes with coordinate maxima. A pair of nodes is left out as a whole if the
    product of its maxima, which no pair below it can exceed, lies under the weakest k-th score of its items.
    """
    count = len(doc)
    order = np.lexsort((value * np.maximum(1, tree.root[1][np.searchsorted(tree.root[0], term)]), owner))
    heaviest = np.full(count, -1, dtype=np.int64)
    heaviest[owner[order]] = term[order]
    at = np.argsort(heaviest, kind="stable")
    place = np.empty(count, dtype=np.int64)
    place[at] = np.arange(count)
    doc, null, owner = doc[at], null[at], place[owner]
    order = np.argsort(owner, kind="stable")
    owner, term, value = owner[order], term[order], value[order]
    leaf = maxima(owner // LEAF, term, value, tree.terms)
    node = maxima(leaf[0] * LEAF // NODE, leaf[1], leaf[2], tree.terms)
    top = maxima(np.zeros(len(node[0]), np.int64), node[1], node[2], tree.terms)
    doc_edges, leaf_edges, node_edges = edges(owner, count), edges(leaf[0], -(-count // LEAF)), edges(node[0], -(-count // NODE))
    whole = slice(0, tree.items)
    if tree.root_bound(top[1], top[2]) < best.bars(whole).min():
        return
    for i in range(len(node_edges) - 1):
        part = slice(node_edges[i], node_edges[i + 1])
        bars = np.minimum.reduceat(best.bars(whole), np.arange(0, tree.items, ITEM_LEAF))
        live = tree.leaf_bounds(node[1][part], node[2][part]) >= bars
        if not live.any():
            continue
        for j in range(i * NODE // LEAF, min((i + 1) * NODE // LEAF, len(leaf_edges) - 1)):
            part = slice(leaf_edges[j], leaf_edges[j + 1])
            terms, most = leaf[1][part], leaf[2][part]
            bars = np.minimum.reduceat(best.bars(whole), np.arange(0, tree.items, ITEM_LEAF))
            for k in np.flatnonzero(live & (tree.leaf_bounds(terms, most) >= bars)).tolist():
                own, dense = tree.blocks[k]
                items = slice(k * ITEM_LEAF, k * ITEM_LEAF + dense.shape[1])
                where = np.searchsorted(terms, own)
                both = np.flatnonzero((where < len(terms)) & (terms[np.minimum(where, len(terms) - 1)] == own)) if len(terms) else np.zeros(0, np.int64)
                if not (most[where[both]] @ dense[both] >= best.bars(items)).any():
                    continue
                low, high = j * LEAF, min((j + 1) * LEAF, count)
                rows = slice(doc_edges[low], doc_edges[high])
                spot = np.searchsorted(own, term[rows])
                mine = np.flatnonzero((spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] == term[rows]))
                sparse = np.zeros((high - low, len(own)), dtype=tree.kind)
                sparse[owner[rows][mine] - low, spot[mine]] = value[rows][mine]
                best.add(items, sparse @ dense, doc[low:high], null[low:high])


def document_terms(docs: DataFrame, key: str, text: str, queries: Queries) -> DataFrame:
    """(doc_id, words, terms, tfs) for every document: how many terms it has, and those of the queries with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            words, ends, terms, tfs = [], [0], [], []
            for one in b.column("text"):
                found = terms_of(one.as_py())
                words.append(len(found))
                numbers = np.fromiter((v for v in map(known.get, found) if v is not None), np.int64)
                term, tf = np.unique(numbers, return_counts=True)
                terms.append(term)
                tfs.append(tf)
                ends.append(ends[-1] + len(term))
            edge = pa.array(ends, pa.int32())
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (terms, tfs)]
            lists = [pa.ListArray.from_arrays(edge, pa.array(v.astype(kind))) for v, kind in zip(flat, (np.int32, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), *lists], schema.names)

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), schema)


def local_best(vectors: DataFrame, queries: Queries, weight: np.ndarray, n_docs: int, n_words: int, k: int, floors: np.ndarray) -> DataFrame:
    """(item, doc_id, score): for each task, the k best of its documents for every item, but for those below the floors."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries.owner, queries.term, queries.count, queries.items, weight, floors))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, term, count, items, weights, least = shared.value
        tree = ItemTree(Queries(dict.fromkeys(range(len(weights))), owner, term, count, items), weights)
        best = Best(tree, k, least)
        for b in chunks(batches):
            sizes = b.column("terms").value_lengths().to_numpy()
            owners = np.repeat(np.arange(b.num_rows), sizes)
            terms, tfs = b.column("terms").flatten().to_numpy().astype(np.int64), b.column("tfs").flatten().to_numpy()
            value = impacts(terms, tfs, owners, b.column("words").to_numpy(), n_docs, n_words).astype(tree.kind)
            ids = b.column("doc_id")
            search_chunk(tree, best, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), owners, terms, value)
        rank, at = np.nonzero(best.score > 0)
        doc = pa.array(best.doc[rank, at], pa.int64(), mask=best.null[rank, at])
        yield pa.RecordBatch.from_arrays([pa.array(tree.item_at[at], pa.int32()), doc, pa.array(best.score[rank, at].astype(np.int64))], schema.names)

    return vectors.mapInArrow(tidy(run), schema)


def chunks(batches: Iterator[pa.RecordBatch], postings: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of up to 4,096 documents or about a million postings, so that memory is bounded."""
    held, rows, size = [], 0, 0
    for b in batches:
        b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column("terms")), 0))
        held.append(b)
        rows, size = rows + b.num_rows, size + len(b.column("terms").flatten())
        if rows >= TREE or size >= postings:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def first_k(found: DataFrame, k: int, *items: str) -> DataFrame:
    order = Window.partitionBy(*items).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_batch(docs: DataFrame, key: str, text: str, names: list[int | None], texts: list[str | None], k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for a bounded batch of items over all documents."""
    spark = docs.sparkSession
    queries = Queries.of(texts)
    vectors = materialize(document_terms(docs, key, text, queries), "document_terms")
    all_docs = vectors.agg(F.count(F.when(F.col("words") > 0, 1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("l")).first()
    n_docs, n_words = all_docs["n"], max(1, all_docs["l"])
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = df.select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
    weight = np.zeros(max(1, len(queries.vocabulary)), dtype=np.int64)
    for row in weighed.toLocalIterator():  # one row per term of the batch
        weight[row["term"]] = row["w"]
    floors = np.zeros(queries.items, dtype=np.int64)
    seeds = vectors.where(F.pmod(F.xxhash64("doc_id", "words"), F.lit(SEED)) == 0)
    sure = first_k(local_best(seeds, queries, weight, n_docs, n_words, k, floors), k, "item").where(F.col("rank") == k)
    for row in sure.collect():  # at most one row per item of the batch
        floors[row["item"]] = row["score"]
    found = local_best(vectors, queries, weight, n_docs, n_words, k, floors)
    best = materialize(first_k(found, k, "item"), "best")
    forget(vectors)
    named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents for each item, with a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII, only A-Z lower-cased. N counts the documents
    with a term, L all their terms, n one document's; a term in df documents weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))), and a document's m is 25 + (75 * n * N) div L. Its score is the sum
    of w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the item's terms, repeats included. Equal scores are in order
    of doc_id, null first.

    Each task keeps the terms that items hold, builds trees over chunks of its documents and searches them against
    the tree of the items; the k best per task and item are merged by Spark. A sixteenth of the documents, searched
    first, gives each item a score that its k-th best reaches; the bounds make the result exact whatever they are.
    Items are searched in batches of about 4,096 with at most about half a million distinct terms (a longer item is
    a batch of its own), so what is broadcast is bounded; each batch reads the documents once.

    Null and empty texts have no terms, as an item no result. Repeated documents count and appear each by
    themselves, repeated items have a result each. Extra columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    sizes = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    batches = max(1, -(-sizes["n"] // MOST_ITEMS), -(-sizes["bytes"] // (4 * MOST_TERMS)))
    found = None
    for b in range(batches):
        part: Column = F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b
        rows = asked.where(part).collect()
        if not rows:
            continue
        one = search_batch(docs, key, text, [r["item_id"] for r in rows], [r["text"] for r in rows], k)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
