"""Lexical search, whitening and byte-level BPE against brute force and the public library."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stacksift.llm import byte_bpe, lexical, queries, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

rng = random.Random(5)


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, "a", "  \n\t  x", "it's we'll 'S", "héllo 😀😀 wörld", "語" * 700, "x" * 3000, "<|endoftext|> <s>", "a\x00b\x85  c", "12345 ٣٤٥ ½", "�\U0001f9ff́", " " * 500 + "end", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "'" * 50]


def random_text():
    kinds = ["abcdefghij ", "äöüßéñ ", "語漢字かな", "😀🎉👩‍👩‍👧", "0123456789", " \n\t", "!?.,;:'\"-", "́‍﻿"]
    return "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 120)))


def test_byte_ids_equal_the_library(spark, library):
    rows = [(i, t, 7, "p") for i, t in enumerate(ODD + ODD[:3] + [random_text() for _ in range(400)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, packed string").repartition(3)
    coded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, starts="first", ends="last")
    assert coded.columns == ["doc_id", "text", "ids_input", "packed", "ids", "first", "last"]
    got = byte_bpe.decode(coded, RANKS, text="again").collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["again"] == text
        at, data = 0, text.encode()
        for token, first, last in zip(r["ids"], r["first"], r["last"], strict=True):
            part = library.decode_single_token_bytes(token)
            before, upto = data[:at], data[: at + len(part)]
            lead = lambda b: sum((x & 0xC0) != 0x80 for x in b)
            assert (first, last) == (lead(before) - ((part[0] & 0xC0) == 0x80), lead(upto))
            at += len(part)


def test_byte_spans_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    codec = byte_bpe.Codec(byte_bpe.library_model(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    for text in [t for t in ODD if t] + [random_text() for _ in range(200)]:
        flat, edges = codec.encode([text])
        data, begins, byte_edges = codec.decoder.decode(flat, edges)
        first, last = byte_bpe.character_spans(data, begins, edges, byte_edges)
        want = full.encode(text, add_special_tokens=False)
        assert flat.tolist() == want.ids
        bytes_of = np.diff(begins)
        split = [(data[a] & 0xC0) == 0x80 for a in begins[:-1]]
        for k, (a, b) in enumerate(want.offsets):  # the library gives parts of white space runs alike
            if not split[k] and bytes_of[k] > 1 and text[a:b].strip():
                assert (first[k], last[k]) == (a, b)


def test_byte_words_are_remembered_and_forgotten(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "MEMORY", 40)
    monkeypatch.setattr(byte_bpe, "PIECE", 64)
    codec = byte_bpe.Codec(byte_bpe.library_model(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    texts = [random_text() + " plain words between " * 9 + random_text() for _ in range(60)] + ["", None]
    for k in range(0, len(texts), 7):
        flat, edges = codec.encode(texts[k : k + 7])
        assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [library.encode_ordinary(t or "") for t in texts[k : k + 7]]


def test_byte_cut_ids_decode_to_broken_text(spark, library):
    ids = library.encode_ordinary("a😀語")
    rows = [(1, ids[:-1]), (2, []), (3, None), (4, ids)]
    got = {r["k"]: r for r in byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), RANKS, text="text").collect()}
    assert got[2]["text"] == "" and got[3]["decoded"] is None and got[3]["text"] is None and got[4]["text"] == "a😀語"
    assert bytes(got[1]["decoded"]) == library.decode_bytes(ids[:-1]) and got[1]["text"].endswith("�")


def test_byte_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        starts = np.concatenate([[0], np.cumsum([len(library.decode_single_token_bytes(x)) for x in ids])]).astype(int)[:-1]
        assert got[i]["n_split"] == sum(((t or "").encode()[a] & 0xC0) == 0x80 for a in starts)
    assert byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Whitening


def whitened_by_hand(vectors):
    """(n, S, eigenvalues, eigenvectors, x by position) by singular values of the whole centred matrix."""
    kept = {i: [math.floor(256 * c) for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(x) for x in kept.values()}), dtype=float)
    centred = fit - fit.sum(axis=0) / len(fit)
    _, sigma, rows = np.linalg.svd(centred)
    return len(fit), fit.sum(axis=0), sigma**2 / len(fit), rows.T, kept


def check_whitening(spark, vectors, dims):
    rows = [(i if i != 3 else None, v, 1, 0.5) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, x double").repartition(3)
    vectors = [v and [None if c is None else float(np.float32(c)) for c in v] for v in vectors]
    n, sums, values, columns, kept = whitened_by_hand(vectors)
    got = whitening.whiten(df).collect()
    assert len(got) == len(kept) * min(4, dims)
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for c, found in by.items():
        column = columns[:, c - 1]
        at = max(kept, key=lambda i: abs((np.array(kept[i]) - sums / n) @ column))
        sign = 1 if found[at if at != 3 else None][0]["whitened"] * ((np.array(kept[at]) - sums / n) @ column) > 0 else -1
        for i, x in kept.items():
            (r,) = found[i if i != 3 else None]
            assert r["n"] == n and r["deviation"] == sum((n * v - int(s)) ** 2 for v, s in zip(x, sums, strict=True))
            assert r["whitened"] == pytest.approx(sign * (np.array(x) - sums / n) @ column / math.sqrt(values[c - 1]), abs=1e-8)
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9
    return got


def spread(dims, n, seed):
    g = np.random.default_rng(seed)
    return (g.normal(size=(n, dims)) * np.linspace(3, 0.5, dims) @ g.normal(size=(dims, dims))).tolist()


def test_whitening_equals_singular_values(spark):
    vectors = spread(7, 300, 1)
    vectors[5] = None
    vectors[6] = [1.0] * 6 + [None]
    vectors[7] = [1.0] * 6 + [math.nan]
    vectors[8] = [math.inf] + [1.0] * 6
    vectors[9] = [-math.inf] + [1.0] * 6
    vectors[20:60] = [vectors[19]] * 40  # one hot vector, once in the fit
    vectors[61] = [-0.0, 0.0, -0.001, 0.003, -1.0, 1.0, 0.00390625]
    check_whitening(spark, vectors, 7)


def test_whitening_of_ill_conditioned_and_flat_vectors(spark):
    vectors = spread(6, 200, 2)
    flat = [[*v[:2], 4.0, v[0] * 2000, 0.0, v[3]] for v in vectors]  # two constant dimensions, one far larger
    check_whitening(spark, flat, 4)
    far = [[c + 30000.0 for c in v] for v in vectors]  # far from the origin
    check_whitening(spark, far, 6)


def test_whitening_without_variance(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whiten(df(rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0
    one = whitening.whiten(df([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [5.0])])).collect()  # one component; the odd length goes
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["deviation"]) for r in one) == [(1, 1, 1.0, 256**2), (2, 1, 1.0, 256**2)]


def test_whitening_of_huge_entries(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [2.0**40, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert {r["deviation"] for r in got} == {None} and {1} <= {r["component"] for r in got} <= {1, 2}


def test_gram_passes_orthogonalise():
    g = np.random.default_rng(3)
    rows = g.normal(size=(500, 12)) @ np.diag(10.0 ** -np.arange(12)) @ g.normal(size=(12, 12))  # condition about 1e12
    q, r = rows, np.eye(12)
    for k in range(3):
        a = q.T @ q
        upper = whitening.shifted_cholesky(a, 11 * (500 * 12 + 12 * 13) * 1.1e-16 * np.linalg.norm(a, 2) if k == 0 else 0.0)
        q, r = whitening.solved(q, upper), upper @ r
    assert np.abs(q.T @ q - np.eye(12)).max() < 1e-12 and np.abs(q @ r - rows).max() < 1e-12 * np.abs(rows).max()


# Ranked lexical search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def searched_by_hand(docs, items, k=10):
    split = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted, found = Counter(split(text)), []
        for i, b in bags:
            m = 25 + 75 * b.total() * n_docs // max(1, n_words)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, q in wanted.items() if t in b)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("seed", "words", "n"), [(1, 30, 60), (2, 400, 900), (3, 4000, 2500)])
def test_search_equals_brute_force(spark, seed, words, n):
    g = random.Random(seed)
    common = [f"w{i}" for i in range(words)]
    text = lambda most: " ".join(g.choice(common[: g.choice([5, words])]) for _ in range(g.randint(0, most)))
    docs = [(g.randint(-5, 3 * n), text(40)) for _ in range(n)]
    docs += docs[:30] + [(i, docs[1][1]) for i in range(700, 760)] + [(None, docs[2][1]), (None, None), (1, ""), (2, "!!"), (3, "É É é w1"), (4, text(3000))]
    items = [(g.randint(0, 50), text(12)) for _ in range(37)] + [(60, docs[0][1]), (61, None), (62, "nowhere"), (None, "W1 w1, W2!"), (63, "É w3 w3 w3"), (63, "É w3 w3 w3"), (64, "w1 " * 500)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, rank int").repartition(2)
    i = spark.createDataFrame([(*r, 2.0) for r in items], "item_id long, text string, score double")
    got = Counter(map(tuple, lexical.search(d, i).collect()))
    assert got == searched_by_hand(docs, items)


def test_search_in_batches_and_beyond_exact_doubles(spark, monkeypatch):
    g = random.Random(9)
    docs = [(i, " ".join(f"t{g.randint(0, 60)}" for _ in range(g.randint(1, 30)))) for i in range(300)]
    items = [(i, " ".join(f"t{g.randint(0, 70)}" for _ in range(6))) for i in range(20)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = searched_by_hand(docs, items)
    monkeypatch.setattr(lexical, "MOST_ITEMS", 6)
    assert Counter(map(tuple, lexical.search(d, i).collect())) == want
    monkeypatch.setattr(lexical, "MOST_ITEMS", 4096)
    monkeypatch.setattr(lexical, "EXACT", 1)
    queries_, weight = lexical.Queries.of([t for _, t in items]), None
    weight = np.arange(len(queries_.vocabulary)) + 1
    assert lexical.ItemTree(queries_, weight).kind is np.int64
    assert searched_by_hand(docs, items, 3) == Counter(map(tuple, lexical.search(d, i, k=3).collect()))


def test_search_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0
    assert lexical.search(d.selectExpr("doc_id", "cast(null as string) text"), i).count() == 0
    assert [tuple(r) for r in lexical.search(d, i).collect()] == sorted(searched_by_hand([(1, "a b")], [(1, "b c")]))


def test_search_prunes(spark):
    """Whole pairs of nodes are left out once every item has ten good documents."""
    g = random.Random(4)
    texts = [" ".join(f"t{g.randint(0, 5000)}" for _ in range(30)) for _ in range(4000)]
    items = lexical.Queries.of([texts[i] for i in range(0, 4000, 100)])
    weight = np.full(len(items.vocabulary), 100, dtype=np.int64)
    tree = lexical.ItemTree(items, weight)
    bags = [Counter(items.vocabulary[t] for t in lexical.terms_of(x) if t in items.vocabulary) for x in texts]
    owner, term = (np.array(v) for v in zip(*[(i, t) for i, b in enumerate(bags) for t in sorted(b)], strict=True))
    value = np.full(len(owner), 1000.0)
    calls = []
    best = lexical.Best(tree, 1, np.full(tree.items, 2_500_000))
    add = best.add
    best.add = lambda *a: (calls.append(a[1].shape), add(*a))
    lexical.search_chunk(tree, best, np.arange(4000), np.zeros(4000, bool), owner, term, value)
    assert (best.score[0] >= 2_500_000).all() and len(calls) < 0.7 * tree.leaves * 63


@pytest.mark.parametrize("sizes", [(3, 2, 5), (32, 8, 4), (512, 64, 32)])
def test_tree_search_equals_all_products(monkeypatch, sizes):
    for name, v in zip(("NODE", "LEAF", "ITEM_LEAF"), (sizes[0] // sizes[1] * sizes[1], *sizes[1:]), strict=True):
        monkeypatch.setattr(lexical, name, v)
    g = random.Random(sum(sizes))
    text = lambda: " ".join(f"t{min(g.randint(0, 90), g.randint(0, 90))}" for _ in range(g.randint(0, 12)))
    items = lexical.Queries.of([text() for _ in range(50)])
    weight = np.array([g.choice([0, 1, 7, 300]) for _ in items.vocabulary], dtype=np.int64)
    tree = lexical.ItemTree(items, weight)
    dense = np.zeros((items.items, len(weight)))
    dense[items.owner, items.term] = items.count * weight[items.term]
    best, all_docs, all_scores = lexical.Best(tree, 4, np.zeros(items.items, np.int64)), [], []
    for _ in range(5):
        n = g.randint(1, 150)
        values = np.array([[g.choice([0, 0, 0, 1, 2, 9]) for _ in weight] for _ in range(n)], dtype=float)
        doc = np.array([g.randint(0, 200) for _ in range(n)])
        owner, term = np.nonzero(values)
        lexical.search_chunk(tree, best, doc, np.zeros(n, bool), owner, term, values[owner, term])
        all_docs.append(doc)
        all_scores.append(values @ dense.T)
    docs, scores = np.concatenate(all_docs), np.vstack(all_scores)
    for place, item in enumerate(tree.item_at):
        want = sorted((-s, d) for s, d in zip(scores[:, item], docs, strict=True) if s > 0)[:4]
        got = [(-s, d) for s, d in zip(best.score[:, place], best.doc[:, place], strict=True) if s > 0]
        assert got == want


def test_search_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = Counter(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op13_lexical']})").fetchall())
    assert Counter(map(tuple, queries.QUERIES["op13_lexical"](spark, sf).select("item_id", "rank", "doc_id", "score").collect())) == want
