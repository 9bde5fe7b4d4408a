"""The corpus operators against brute force, libraries and held-out rows, with edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stacksift.llm import common, fingerprint, jpeg, language, license, linededup, minhash, mixing, pieces, queries, sharding, toxicity
from stacksift.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

rng = random.Random(11)
SYLLABLES = "the an er tion re ou ing ed ha le st nd ea wh on in".split()


def word():
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(n):
    return " ".join(word() for _ in range(n))


#: (doc_id, text): null ids and texts, empty and wordless texts, one long text, repeated rows.
EDGES = [(1, None), (2, ""), (3, "  \n "), (4, "!!! ???"), (None, "a null id here"), (5, "é漢😀 Ünï"), (6, "x" * 5000), (7, prose(6000)), (8, "same row"), (8, "same row"), (9, "a\x00b\tc\r\nd")]


@pytest.fixture(scope="module")
def edges(spark):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{(i or 0) % 2}", 0, "k", 1, "r") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, uid int, r string")


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.limit(0)


# Sharding


@pytest.mark.parametrize("n", [1, 7, 400])
def test_shards_are_contiguous_and_even(spark, n):
    rows = [(rng.randint(-50, 10**6), "x" * rng.choice([0, 5, 40, 400])) for _ in range(n)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    by = {s: [r for r in got if r["shard"] == s] for s in range(8)}
    total, largest, before = sum(r.size for r in got), max(r.size for r in got), None
    for s in range(8):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r.size for r in by[s]) - total / 8) <= largest
        ids = [r.doc_id for r in sorted(by[s], key=lambda r: r.slot)]
        assert ids == sorted(ids) and (before is None or not ids or before <= ids[0])
        before = ids[-1] if ids else before


def test_shards_of_edge_cases(spark, edges, nothing):
    got = sharding.shard_documents(edges).collect()
    assert len(got) == len(EDGES) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert next(r for r in got if r.doc_id == 1).size == 1 and next(r for r in got if r.doc_id == 1).text_crc32 == 0
    assert sharding.shard_documents(nothing).count() == 0


# Mixing


def edf(weights, slots):
    """Pfair by hand: at each slot the released block that is due first."""
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        i = min((-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] * total // w <= t)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


@pytest.mark.parametrize("length", [5, 32])
def test_schedule_is_earliest_deadline_first_over_the_whole_run(spark, monkeypatch, length):
    """Rounds that are worked out on their own join to the schedule of the whole run."""
    monkeypatch.setattr(mixing, "ROUND", length)
    for weights in ([1], [3, 1], [5, 3, 2, 1, 1], [40, 7, 7, 5, 5], [1] * 9, [997, 31, 5, 2], *([rng.choice([1, 2, 7, 30, 400]) for _ in range(rng.randint(2, 14))] for _ in range(6))):
        total = sum(weights)
        blocks = [max(1, 130 * w // total) for w in weights]
        slots = max(-(-b * total // w) for b, w in zip(blocks, weights, strict=True))
        want = edf(weights, slots)
        got = mixing.schedule(spark, [mixing.Lane(f"s{i:02d}", w, b) for i, (w, b) in enumerate(zip(weights, blocks, strict=True))]).collect()
        assert {(r.lane, r.block): r.slot for r in got} == {(f"s{i:02d}", k): t for t, (i, k) in enumerate(want) if k < blocks[i]}
        for i, w in enumerate(weights):  # less than one block off after any number of slots
            count = 0
            for t, (x, _) in enumerate(want, 1):
                count += x == i
                assert abs(count * total - w * t) < total


def test_mix_keeps_all_rows_and_targets(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"s{k % 5}" if k % 7 else None, k) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text long").withColumn("text", F.col("text").cast("string"))
    got = mixing.mix(docs, block_rows=4).select("doc_id", "source", "mix_at.*").collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert len({(r.slot, r.offset) for r in got}) == 900
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.release <= r.slot < r.due
    total = sum(len(x) ** 0.5 for x in by.values())
    for x in by.values():
        assert abs(x[0].weight / x[0].total - len(x) ** 0.5 / total) < 1e-5
        blocks = Counter(r.block for r in x)
        assert sorted(blocks) == list(range(len(blocks))) and all(n == 4 for b, n in blocks.items() if b < len(blocks) - 1)
        assert all(len({r.slot for r in x if r.block == b}) == 1 for b in blocks)
    weighted = mixing.mix(docs, 4, {"hot": 3.0, "s1": 1.0}).select("source", "mix_at.weight", "mix_at.total").distinct().collect()
    shares = {r.source: r.weight / r.total for r in weighted}
    assert abs(shares["hot"] / shares["s1"] - 3) < 0.01 and abs(shares[None] - 1 / 4096) < 1e-5


def test_many_sources_share_lanes(spark, monkeypatch):
    """Sources beyond the lanes: all rows stay, and each source is within three blocks of its share."""
    monkeypatch.setattr(mixing, "LANES", 3)
    sizes = [200, 150, 90] + [rng.randint(20, 70) for _ in range(30)]
    rows = [(s, k) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame([(i, f"s{s}", "t") for i, (s, _) in enumerate(rows)], "doc_id long, source string, text string")
    got = mixing.mix(docs, block_rows=2).select("doc_id", "source", "mix_at.*").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows))) and len({(r.slot, r.offset) for r in got}) == len(rows)
    first_end = min(r.due for r in got if r.block == max(x.block for x in got if x.source == r.source))
    for s in range(len(sizes)):
        own = {r.block: r for r in got if r.source == f"s{s}"}
        assert all(abs(b - r.slot * r.weight / r.total) < 3 for b, r in own.items() if r.slot < first_end)


def test_mix_edge_cases(edges, nothing):
    assert mixing.mix(edges).count() == len(EDGES) and mixing.mix(nothing).count() == 0
    assert mixing.mix(edges.withColumn("mix_at", F.lit(1))).columns == [*edges.columns, "mix_at_input", "mix_at"]
    assert mixing.mix(nothing).columns == [*edges.columns, "mix_at"]


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(library):
    vocabulary = pieces.Vocabulary.load(MODEL)
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    alphabet = "ab ▁\n\té漢😀ﬁ\x00<0x0A>theing  　\r�⁇.,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [prose(300), "", " ", "x" * 300, prose(1).upper() * 40]
    want = library.encode(texts)
    assert encoder.encode_lists(texts) == want
    assert [list(encoder.by_agenda(c)) for c in ("▁theing", "▁" * 20 + "ing", "▁reouingtion" * 9)] == [encoder.encode_lists([c.replace("▁", " ")[1:]])[0] for c in ("▁theing", "▁" * 20 + "ing", "▁reouingtion" * 9)]
    assert [decoder.decode(x) for x in want] == library.decode(want)
    odd = [[rng.choice([rng.randint(0, 31999), rng.randint(3, 258), 0, 1, 2, 259]) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in odd])])
    assert [decoder.decode(x) for x in odd] == library.decode(odd)
    assert decoder.decode_all(np.array([i for x in odd for i in x]), edges).to_pylist() == library.decode(odd)


def test_pieces_query_equals_the_library(spark, edges, library, tmp_path):
    edges.withColumns({"ids": F.lit(1), "decoded": F.lit("x")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op8_pieces"](spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in EDGES:
        ids = library.encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    taken = pieces.encode(edges.withColumn("IDS", F.lit(1)), MODEL)
    assert taken.columns == [*edges.columns, "IDS_input", "ids"] and pieces.decode(taken.withColumn("decoded", F.lit(1)), MODEL).columns[-2:] == ["decoded_input", "decoded"]


def test_media_query_equals_brute_force(spark, edges, tmp_path):
    edges.withColumns({"width": F.lit(1), "media": F.lit("x"), "n_bytes": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op5_media"](spark, str(tmp_path)).collect()}
    for i, t in EDGES:
        raw = (t or "").encode()
        stored = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
        media = jpeg.store([stored])[0]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert jpeg.media_columns(edges.withColumn("media", F.lit(1))).columns[: len(edges.columns) + 1] == [*edges.columns, "media_input"]


def test_pieces_of_edge_cases(spark, edges, nothing, library):
    got = pieces.decode(pieces.encode(edges, MODEL), MODEL).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_eos=True) and r.decoded == library.decode(r.ids)
    assert pieces.encode(nothing, MODEL).count() == 0
    one = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(one, MODEL).collect()] == [None, ""]


# JPEG


def test_jpeg_keeps_payloads():
    payloads = [rng.randbytes(64 * n) for n in (1, 2, 3, 70, 9000, 8191, 8192, 20000)] + [bytes(64), b"\xff" * 640]
    media = jpeg.store(payloads)
    images, width, height, gray, _ = jpeg.read_back(media)
    assert gray == payloads and images == [1, 1, 1, 1, 2, 1, 2, 3, 1, 1]
    assert all(w == 512 for w in width) and [h // 8 * 64 for h in height] == [len(p) for p in payloads]
    assert all(m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" for m in media)


def scalar_jpeg(coefficients, width, height, sampling, step=16, interval=0):
    """A baseline image with AC coefficients and several components, written bit by bit. coefficients: per component, blocks in coded order."""
    ac_counts, ac_symbols = bytes([0, 2, 2, 1] + [0] * 12), bytes([0x00, 0x01, 0x11, 0xF0, 0x02])
    dc, ac = jpeg.huffman_codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS), jpeg.huffman_codes(ac_counts, ac_symbols)
    n = len(sampling)
    frame = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    out = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([step]) + b"\x01" * 63) + jpeg.segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + frame)
    out += jpeg.segment(0xC4, b"\x00" + jpeg.DC_COUNTS + jpeg.DC_SYMBOLS) + jpeg.segment(0xC4, b"\x10" + ac_counts + ac_symbols)
    out += jpeg.segment(0xDD, interval.to_bytes(2, "big")) + jpeg.segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0]))
    bits, previous, data, units = "", [0] * n, b"", 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    blocks = [iter(c) for c in coefficients]
    total = len(coefficients[0]) // (sampling[0][0] * sampling[0][1] if n > 1 else 1)
    for unit in range(total):
        if interval and unit and unit % interval == 0:
            data += flush(bits) + bytes([0xFF, 0xD0 + units % 8])
            bits, previous, units = "", [0] * n, units + 1
        for c, (h, v) in enumerate(sampling):
            for _ in range(h * v if n > 1 else 1):
                value, pairs = next(blocks[c])
                size, extra = number(value - previous[c])
                previous[c] = value
                bits += format(dc[size][0], f"0{dc[size][1]}b") + extra
                for symbol, ac_value in pairs:  # run and size, value
                    bits += format(ac[symbol][0], f"0{ac[symbol][1]}b") + (number(ac_value)[1] if ac_value else "")
                bits += format(ac[0][0], f"0{ac[0][1]}b")
    return out + data + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("sampling", "interval"), [([(1, 1)], 0), ([(1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1)], 3)])
def test_jpeg_reads_general_baseline(sampling, interval):
    width, height = 40, 24
    h, v = sampling[0]
    across, down = (-(-width // (8 * h)), -(-height // (8 * v))) if len(sampling) > 1 else (5, 3)
    blocks = lambda k: [(rng.randint(-60, 60), rng.choice([[], [(0x01, 1)], [(0x11, -1), (0x02, 3)], [(0xF0, 0), (0x01, -1)]])) for _ in range(k)]
    coefficients = [blocks(across * down * (a * b if len(sampling) > 1 else 1)) for a, b in sampling]
    media = scalar_jpeg(coefficients, width, height, sampling, 16, interval)
    (image, thumbnail), = jpeg.thumbnails([media])[0]
    assert (image.width, image.height, thumbnail.shape) == (width, height, (3, 5))
    want = np.zeros((3, 5))
    it = iter(coefficients[0])
    for my in range(down):
        for mx in range(across):
            for y in range(v if len(sampling) > 1 else 1):
                for x in range(h if len(sampling) > 1 else 1):
                    value = next(it)[0] * 2 + 128
                    py, px = (my * v + y, mx * h + x) if len(sampling) > 1 else (my, mx)
                    if py < 3 and px < 5:
                        want[py, px] = min(255, max(0, value))
    assert (thumbnail == want).all()


def test_media_of_edge_cases(spark, edges, nothing):
    got = jpeg.media_columns(edges).collect()
    assert len(got) == len(EDGES)
    for r in got:
        raw = (r.text or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.thumbnail) == raw + bytes(-len(raw) % 64 if raw else 64)
    assert len({r.media for r in got if r.doc_id == 8}) == 1
    assert jpeg.media_columns(nothing).count() == 0
    broken = spark.createDataFrame([(bytearray(got[0].media),), (None,), (bytearray(b"no"),), (bytearray(got[0].media[:-9]),)], "media binary")
    assert [r.width for r in jpeg.thumbnail_columns(broken).collect()] == [512, None, None, None]


# Fingerprints


def reference_sketch(text):
    """The sketch by hand, with the xxhash library: chained hashes of words, then of runs of words."""
    as_long = lambda h: h.to_bytes(8, "little")
    spaced = "".join(f" {c} " if "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\u0e01" <= c <= "\u0e3a" else c for c in (text or "").lower())
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]", spaced) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]

    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(as_long(v), seed=seed)
        return seed

    if len(hashes) >= 5:
        found = {chain(hashes[i : i + 5]) for i in range(len(hashes) - 4)}
    elif hashes:
        found = {chain(hashes, xxhash.xxh64_intdigest(len(hashes).to_bytes(4, "little"), seed=42))}
    else:
        return []
    values = sorted(h >> 2 for h in found)
    kept = [h for h in values if h < int(0.25 * 2**62)]
    return kept or values[:1]


def likeness_by_hand(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def test_fingerprints_equal_brute_force(spark):
    texts = [prose(rng.choice([0, 1, 2, 3, 4, 5, 6, 40, 200])) for _ in range(80)] + [None, "A  b\nc\td E f", "漢字かな混じりの長い文です", "ภาษาไทย abc"]
    rows = fingerprint.sketch(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("text", F.coalesce("text", F.lit(""))), "text", "s").collect()
    for r in rows:
        assert r.s == reference_sketch(texts[r.doc_id])


@pytest.mark.parametrize("parts", [4, 300])
def test_fingerprint_query_equals_brute_force(spark, tmp_path, parts):
    """All columns of the query, with the wrap-around, null ids, repeated ids and rows, short and long texts."""
    rows = [(i, t) for i, t in EDGES] + [(100 + k, prose(rng.randint(1, 60))) for k in range(60)] + [(None, prose(9)) for _ in range(30)] + [(150, prose(7)) for _ in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("edited", F.lit(1)).withColumn("s", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = queries.QUERIES["op4_fingerprint"](spark, str(tmp_path)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), seed=42), "big", signed=True)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    name = lambda s: ",".join(map(str, s))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        new = t[: len(t) - cut] + after[:cut]
        own, edited_sketch, next_sketch = reference_sketch(t), reference_sketch(new), reference_sketch(after)
        want[i, len(t), sha(new), name(own), name(edited_sketch), likeness_by_hand(own, edited_sketch), likeness_by_hand(own, next_sketch)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want


def test_edited_documents(spark, nothing):
    assert fingerprint.edited_documents(nothing).count() == 0
    single = fingerprint.edited_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert single.edited == "abcdab"
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))
    assert spark.range(1).select(fingerprint.likeness(a, b), fingerprint.containment(a, b)).first()[:] == (1 / 3, 0.5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    fingerprint.edited_documents(many)._jdf.queryExecution().executedPlan()  # neither the plan's depth nor its size follows the ranges
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_merge_of_sketches_is_the_sketch_of_both(spark):
    a, b = prose(200), prose(150)
    s = lambda t: fingerprint.sketch(spark.createDataFrame([(t,)], "text string"), "text", "s").first().s
    both = spark.createDataFrame([(s(a), s(b))], "a array<long>, b array<long>").select(fingerprint.merge(F.col("a"), F.col("b")).alias("m")).first().m
    assert both == sorted({*s(a), *s(b)})


# Licenses


def matches_by_hand(text, table):
    """(number of words, matches as (first, last, rule))."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(words) + " "
    found = []
    for k, r in enumerate(table):
        for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), k))
    return len(words), found


def suppressed_by_hand(found, table):
    """All pairs: which detections beat which, and then who is beaten by a survivor, from the top rank down."""
    rank = {d: (-table[d[2]].priority, d[0] - d[1], d) for d in found}
    beats = {d: {e for e in found if e != d and (e[0] <= d[0] and e[1] >= d[1] or d[0] <= e[0] and d[1] >= e[1]) and rank[e] < rank[d]} for d in found}
    alive = {}
    for d in sorted(found, key=rank.get):
        alive[d] = not any(alive[e] for e in beats[d])
    return {d for d in found if alive[d]}


def spans_of(array):
    return [(d["first"], d["last"], d["rule"]) for d in array]


LICENSE_PARTS = ["GNU General Public License", "version 2 or later", "Apache License, Version 2.0", "MIT License", "CC BY-SA 4.0", "cc by", "licensed under the", "SPDX-License-Identifier: MPL-2.0", "all rights reserved", "Copyright (c) 2024", "BSD 3-clause license", "public domain", "é", "x", "license", "http://creativecommons.org/licenses/by/4.0/", "the freetype project license", "public domain dedication and license"]


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_license_scan_equals_brute_force(spark, edges, monkeypatch, chunk):
    monkeypatch.setattr(license, "CHUNK", chunk)
    table = license.rules()
    assert len(table) > 400 and sum(r.base for r in table) == 4
    texts = [rng.choice([" ", "\n", "--"]).join(rng.choice(LICENSE_PARTS) for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["MIT License " * 100, " ".join(rng.choice(LICENSE_PARTS) for _ in range(120)), None, "MIT", "mit license"]
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        n, found = matches_by_hand(texts[r.doc_id], table)
        assert r.n_words == n
        assert sorted(spans_of(r.found)) == sorted(found) and [d["first"] for d in r.found] == sorted(d[0] for d in found)
        assert len(r.kept) == len({*spans_of(r.kept)}) and {*spans_of(r.kept)} == suppressed_by_hand(found, table)


@pytest.mark.parametrize("chunk", [2, 64])
def test_license_suppression_of_random_rules(spark, monkeypatch, chunk):
    """Rules over few words, so that detections nest, repeat and overlap in chains."""
    monkeypatch.setattr(license, "CHUNK", chunk)
    for _ in range(4):
        table = [license.Rule(f"r{k}", " ".join(rng.choice(["a", "b", "(?:a|b)"]) for _ in range(rng.randint(1, 5))), "", rng.choice([10, 20, 30, 40]), 0.5) for k in range(9)]
        texts = ["".join(rng.choice(["a ", "b ", "a ", "x "]) for _ in range(rng.randint(0, 90))) for _ in range(25)]
        for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "text", table).collect():
            n, found = matches_by_hand(texts[r.doc_id], table)
            assert {*spans_of(r.kept)} == suppressed_by_hand(found, table)


def test_license_priorities_among_nested_detections(spark):
    words = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"
    rule = lambda label, a, b, priority: license.Rule(label, " ".join(words.split()[a : b + 1]), "", priority, 0.5)
    kept = lambda *table: [d["label"] for d in license.scan(spark.createDataFrame([(words,)], "text string"), "text", list(table)).first().kept]
    assert kept(rule("A", 0, 7, 40), rule("B", 5, 9, 10), rule("C", 6, 7, 20)) == ["A", "B"]  # C lies in A
    assert kept(rule("outer", 0, 2, 10), rule("inner", 1, 1, 40)) == ["inner"]
    assert kept(rule("outer", 0, 2, 10), rule("inner", 1, 1, 10)) == ["outer"]
    assert kept(rule("one", 0, 2, 10), rule("two", 0, 2, 10)) == ["one"]
    assert kept(rule("weak", 1, 3, 20), rule("strong", 1, 1, 40), rule("last", 3, 3, 10)) == ["strong", "last"]  # weak went, so it drops nothing


def test_license_query_and_edge_cases(spark, edges, nothing, tmp_path):
    """The digest columns by hand; a text of 400 KB with very many detections."""
    texts = [" ".join(rng.choice(LICENSE_PARTS) for _ in range(rng.randint(0, 5))) for _ in range(40)] + [t for _, t in EDGES]
    spark.createDataFrame([(k, t, 1, "f") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, found string").write.parquet(str(tmp_path / "documents.parquet"))
    table = license.rules()
    for r in queries.QUERIES["op6_license"](spark, str(tmp_path)).collect():
        n, found = matches_by_hand(texts[r.doc_id], table)
        kept = suppressed_by_hand(found, table)
        base = [d for d in found if table[d[2]].base]
        starts = [d[0] for d in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({table[d[2]].label for d in base}))
        assert r.labels == ",".join(sorted({table[d[2]].label for d in [*base, *kept]}))
        assert r.score == max((table[d[2]].weight for d in kept), default=0.0) and r.n_kept == len(kept)
    scanned = license.scan(edges.withColumn("kept", F.lit(7)))
    assert scanned.columns == [*edges.columns, "kept_input", "n_words", "found", "kept"] and scanned.count() == len(EDGES)
    assert license.scan_documents(nothing).count() == 0
    began = time.perf_counter()
    many = license.scan(spark.createDataFrame([("mit license " * 32_000,)], "text string")).select("n_words", F.size("found").alias("found"), F.size("kept").alias("kept")).first()
    assert many.n_words == 64_000 and many.found >= 64_000 and many.kept == 32_000
    assert time.perf_counter() - began < 60


def examples(regex, most=60):
    """Texts that a rule's regex matches: each choice of its groups, their options and character sets."""
    import itertools

    at, parts = 0, []
    while at < len(regex):
        c = regex[at]
        if regex.startswith("(?:", at):
            depth, end = 1, at + 3
            while depth:
                depth += (regex[end] == "(") - (regex[end] == ")")
                end += 1
            inner, level, options = regex[at + 3 : end - 1], 0, [""]
            for x in inner:
                level += (x == "(") - (x == ")")
                if x == "|" and not level:
                    options.append("")
                else:
                    options[-1] += x
            found, at = [e for o in options for e in examples(o, 8)], end
        elif c == "[":
            end = regex.index("]", at)
            chars = regex[at + 1 : end]
            found, at = (["foo"] if chars[0] == "^" else ["4"] if "-" in chars else list(chars)), end + 1
        else:
            found, at = [c], at + 1
        if regex.startswith("{0,2}", at):
            found, at = [*found, "", found[0] * 2], at + 5
        elif at < len(regex) and regex[at] in "?*":
            found, at = [*found, ""], at + 1
        elif at < len(regex) and regex[at] == "+":
            at += 1
        parts.append(found)
    return ["".join(x) for x in itertools.islice(itertools.product(*parts), most)]


def test_every_rule_has_its_gates():
    """Gates and prefilter let all that a rule matches pass."""
    coarse = license.coarse_gates(license.rules())
    for r in license.rules():
        options, level = [""], 0
        for x in r.regex:
            level += (x == "(") - (x == ")")
            if x == "|" and not level:
                options.append("")
            else:
                options[-1] += x
        for e in (e for o in options for e in examples(o)):
            assert re.fullmatch(r.regex, e), (r, e)
            assert r.gate in e and any(g in e for g in coarse), (r, e)


# Toxicity and language


def test_toxicity_on_held_out_rows(spark, edges, nothing):
    bad = ["grumf", "snarkle", "bleepo"]
    rows = []
    for k in range(700):
        toxic = k % 4 == 0
        w = prose(rng.randint(20, 60)).split()
        for _ in range(rng.randint(1, 8) if toxic else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(bad) + rng.choice(["", "ing", "ou"]))
        rows.append((k, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows if r[0] % 3] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i].toxic == bool(t) for i, _, t in test) >= 0.97 * len(test)
    many = " ".join(bad * 4)
    assert sum(model.above(many)) > sum(model.above(bad[0] + " " + prose(30))) > sum(model.above(prose(30)))
    scored = toxicity.score(edges, model).collect()
    assert len(scored) == len(EDGES) and not any(r.toxic for r in scored) and toxicity.score(nothing, model).count() == 0
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).take(20))


def test_toxicity_query_equals_brute_force(spark, tmp_path):
    """All columns by hand from the model's weights; ties, repeats, very long, empty and null texts, clashing names."""
    vile = ["grumf", "snarkle"]
    texts = [" ".join(prose(20).split() + [rng.choice(vile)] * rng.randint(1, 9)) if k % 3 == 0 else prose(20) for k in range(240)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, (_, t) in enumerate(EDGES)] + [(2000, "grumf " * 50_000), (2001, "Grumf"), (2001, "Grumf"), (2002, "grumfing SNARKLES")]
    spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, grade int, severity string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["op2_toxicity"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "p_toxic", "severity", "grade", "toxic"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, labels)
    for i, t in rows:
        total = 0.0
        for w, n in Counter(re.findall(r"[^\W\d_]+", (t or "").lower())).items():
            total += np.log1p(n) * sum(model.weights.get(f, 0.0) for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)])
        above = [1 / (1 + np.exp(-min(30, max(-30, total - x)))) for x in model.thresholds]
        toxic = above[0] >= model.cutoff
        want = (above[0], sum(above), max(1, sum(a >= 0.5 for a in above)) if toxic else 0)
        r = found[i]
        assert abs(r.p_toxic - want[0]) < 1e-9 and abs(r.severity - want[1]) < 1e-9 and (r.grade, r.toxic) == (want[2], toxic)
    assert all(found[k].toxic == (k % 3 == 0) for k in range(240)) and found[2000].grade == 3 and found[2001].toxic and found[1000].grade == 0
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "grade_input", "severity_input", "p_toxic", "severity", "grade", "toxic"]


def test_best_cutoff():
    p, toxic = np.array([0.01, 0.02, 0.2, 0.9, 0.2]), np.array([0, 0, 1, 1, 1])
    assert 0.02 < toxicity.best_cutoff(p, toxic) < 0.2
    assert 0.4 < toxicity.best_cutoff(np.array([0.1, 0.5, 0.5, 0.9]), np.array([0, 0, 1, 1])) < 0.9


def test_ordinal_regression_shares_weights_and_orders_thresholds():
    r = np.random.default_rng(1)
    x = [{0: float(v)} for v in r.normal(0, 2, 600)]
    grade = np.array([int(d[0] > -1) + int(d[0] > 1) for d in x])
    w, theta = toxicity.fit_ordinal(x, grade, 1, 3)
    assert w[0] > 0 and theta[0] < theta[1] and abs(theta[0] / w[0] + 1) < 0.3 and abs(theta[1] / w[0] - 1) < 0.3


def test_language_on_held_out_rows(spark, edges, nothing):
    sounds = {"en": "the ing wh th".split(), "de": "sch ung ei ü".split(), "fr": "eau é ou ç".split(), "es": "ción ñ ll ue".split(), "fi": "kk ää yö".split()}
    rows = [(k, " ".join("".join(rng.choice(sounds[x] + ["a", "r"]) for _ in range(3)) for _ in range(rng.randint(3, 60))), x) for k in range(600) for x in [list(sounds)[k % 5]]]
    docs = spark.createDataFrame([(k, t, None if k % 50 == 7 else x) for k, t, x in rows], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "uralic": ["fi"]}
    got = {r.doc_id: r for r in language.identify(docs.drop("lang"), model).collect()}
    test = [(k, x) for k, _, x in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(test) > 80 and sum(got[k].lang_pred == x for k, x in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = language.identify(edges, model).collect()
    assert len(odd) == len(EDGES) and {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 4)} == {"und"} and language.identify(nothing, model).count() == 0
    empty = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(edges, empty).collect()} <= {"und"}


def language_by_hand(model, text):
    """(language, score) from the model's weights, one text and one gram at a time."""
    letters = [c.lower() if len(c.lower()) == 1 else c for c in f" {text or ''} "]
    letters = [c if c.isalpha() or o.isalpha() else " " for c, o in zip(letters, f" {text or ''} ", strict=True)]
    run = [ord(c) for i, c in enumerate(letters) if i == 0 or c != " " or letters[i - 1] != " "]
    if all(c == 32 for c in run):
        return "und", 0.0
    low, grams = 0xFFFFFFFF, Counter()
    for i, c in enumerate(run):
        one = c * 0x9E3779B1 & low
        if c != 32:
            grams[one >> 19] += 1
        if i + 1 < len(run):
            two = (one ^ run[i + 1] + 0x85EBCA6B & low) * 0xC2B2AE35 & low
            grams[two >> 19] += 1
        if i + 2 < len(run):
            three = (two ^ run[i + 2] + 0x27D4EB2F & low) * 0x165667B1 & low
            grams[three >> 19] += 1
    total = sum(grams.values())

    def choose(level, names):
        marks = {n: [] for n in names}
        for (at, a, b), w in zip(model.columns, model.weights, strict=True):
            if at == level:
                m = sum(w[g] * n * language.SCALE / total for g, n in grams.items()) + w[-1]
                marks[a].append(m)
                if b is not None:
                    marks[b].append(-m)
        best = max(sorted(names), key=lambda n: (sum(m > 0 for m in marks[n]), sum(marks[n])))
        return best, 1 / (1 + np.exp(-min(30, max(0, min(marks[best]))))) if marks[best] else 1.0

    family, sure = choose("", list(model.members))
    best, within = choose(family, model.members[family])
    return best, sure * within


def test_language_query_equals_brute_force(spark, tmp_path):
    """All columns by hand from the model's weights: two, three and more families, letters of all planes, clashing names."""
    sounds = {"en": "the ing wh".split(), "de": "sch ung ü".split(), "fr": "eau é ou".split(), "es": "ción ñ ll".split(), "fi": "kk ää yö".split(), "xx": "zz qq".split()}
    for names in (["en", "de"], ["en", "fr"], ["en", "de", "fr", "es"], list(sounds)):
        texts = [(k, " ".join("".join(rng.choice(sounds[x] + ["a", "r"]) for _ in range(3)) for _ in range(rng.randint(1, 30))), x) for k in range(160) for x in [names[k % len(names)]]]
        rows = texts + [(None if i is None else 1000 + i, t, None) for i, t in EDGES] + [(2000, "\U00030000\U00031350", "en"), (2001, "İstanbul ǅ ß 1a2b", None), (2002, "a" * 300_000, None)]
        path = tmp_path / "-".join(names)
        spark.createDataFrame([(*r, 0.5, "y") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").write.parquet(str(path / "documents.parquet"))
        model = language.fit(spark.read.parquet(str(path / "documents.parquet")))
        got = queries.QUERIES["op9_language"](spark, str(path)).collect()
        assert len(got) == len(rows)
        by = {i: t for i, t, _ in rows}
        for r in got:
            want = language_by_hand(model, by[r.doc_id])
            assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6, (by[r.doc_id], r, want)
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert next(r for r in got if r.doc_id == 2000).lang_pred != "und"
    renamed = language.identify(spark.read.parquet(str(path / "documents.parquet")), model)
    assert renamed.columns == ["doc_id", "text", "lang", "score_input", "lang_pred_input", "lang_pred", "score"]


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(k, f"text {k}", "en" if k % 2 else "de") for k in range(100)] + [(1000 + k, "x y", f"junk{k}") for k in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=2)
    assert model.members == {"germanic": ["de", "en"]}


# Near-duplicates


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, tuple(w) or ("raw", text or "")


def classes_by_hand(texts):
    found = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(found):
        for j, (b, y) in enumerate(found[:i]):
            if x == y or a and b and len(a & b) >= 0.8 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randint(0, len(w) - 1)] = word()
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    originals = [prose(rng.choice([5, 30, 150, 300])) for _ in range(25)]
    texts = [*originals, *(edited(t, rng.randint(0, 6)) for t in originals for _ in range(4)), *(edited(originals[3], 1).upper() + "!" for _ in range(30)), None, "", "", "??", "one two", "one two"]
    got = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = classes_by_hand(texts)
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    assert Counter(r.class_id for r in got if r.kept) == Counter(set(want))
    sizes = Counter(want)
    assert all(r.n_docs == sizes[r.class_id] for r in got)


def test_a_large_group_of_edited_copies_is_one_class(spark):
    base = prose(200)
    texts = [base] + [edited(base, 2) for _ in range(400)]
    got = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.class_id == 0 for r in got) == sum(w == 0 for w in classes_by_hand(texts))


def test_copies_that_repeat_a_passage_are_linked(spark):
    """The sets are nearly equal, whatever the number of repeats."""
    texts = []
    for _ in range(12):
        w = prose(230).split()
        texts += [" ".join(w), " ".join(w[:100] + w[100:124] * 50 + w[124:])]
    want = classes_by_hand(texts)
    assert want == [k - k % 2 for k in range(24)]
    got = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


@pytest.mark.parametrize(("pairs", "singles", "copies", "chunk"), [(40, 40, 30, 8), (300, 350, 150, 64)])
def test_pairs_inside_a_large_family_are_linked(spark, monkeypatch, pairs, singles, copies, chunk):
    """Texts 0.794 alike, among them pairs of 0.808, and one of them with many copies; the larger family fills buckets of over 1,000."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    start = prose(204)
    unique = lambda n: " ".join(f"w{rng.getrandbits(60)}" for _ in range(n))
    texts = [f"{start} {two} {unique(24)}" for two in (unique(2) for _ in range(pairs)) for _ in range(2)] + [f"{start} {unique(26)}" for _ in range(singles)]
    texts += [f"{texts[-1]} {unique(1)}" for _ in range(copies)]
    want = classes_by_hand(texts)
    n, last = 2 * pairs, 2 * pairs + singles - 1
    assert want[:n] == [k - k % 2 for k in range(n)] and want[n:last] == list(range(n, last)) and set(want[last:]) == {last}
    got = minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_registers_agree_with_probability_jaccard():
    a, b = Counter({i: rng.choice([1, 2, 5]) for i in range(300)}), Counter({i: rng.choice([1, 2, 5]) for i in range(120, 420)})
    wants = [sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in {*a, *b}) for i in {*a} & {*b})]
    rows = [(i, k) for k, c in enumerate((a, b)) for i in sorted(c)]
    hashes = minhash.mixed(np.array([i for i, _ in rows], dtype=np.uint64))
    weight = np.array([(a, b)[k][i] for i, k in rows], dtype=float)
    hits = []
    for salt in range(40):
        s = minhash.signatures(minhash.mixed(hashes + np.uint64(salt)), np.array([k for _, k in rows]), weight, 2)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - wants[0]) < 0.02


def test_near_duplicates_of_edge_cases(edges, nothing):
    got = minhash.classes(edges).collect()
    assert len(got) == len(EDGES)
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and {r.class_id for r in got if r.doc_id in (3, 4)} == {3, 4}
    assert sum(r.kept for r in got if r.doc_id == 8) == 1 and next(r for r in got if r.doc_id is None).class_id is None
    kept = minhash.keep_one(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r.kept for r in got)
    assert minhash.classes(nothing).count() == 0 and minhash.keep_one(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_edit_distance():
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) if rng.random() < 0.5 else a[: rng.randint(0, 9)] + rng.choice("abc ") + a[rng.randint(0, 9) :]
        for most in (0, 1, 2, 3):
            assert linededup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def lines_by_hand(docs, edits=1, least=linededup.MIN_CHARS, exact=linededup.EXACT_CHARS):
    """Texts after deduplication; docs in order."""
    lines = {}
    for t in docs:
        for x in (t or "").split("\n"):
            if len(x) >= exact:
                lines.setdefault(x, len(lines))
    stays = []
    for x in lines:
        if len(x) < least or not any(len(y) >= least and abs(len(x) - len(y)) <= edits and levenshtein(x, y) <= edits for y in stays):
            stays.append(x)
    stays = set(stays)
    seen, out = set(), []
    for t in docs:
        if t is None:
            out.append(None)
            continue
        kept = []
        for x in t.split("\n"):
            if len(x) < exact:
                kept.append(x)
            elif x in stays and x not in seen:
                seen.add(x)
                kept.append(x)
        out.append("\n".join(kept))
    return out


def typo(line):
    k = rng.randint(0, len(line) - 1)
    return rng.choice([line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "q" + line[k + 1 :], line])


@pytest.mark.parametrize(("edits", "small"), [(1, 2), (1, 32), (2, 2), (2, 32), (3, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, edits, small):
    """Also with tiny buckets, so that hot ones are split again and again."""
    monkeypatch.setattr(linededup, "SMALL", small)
    base = [prose(rng.randint(3, 5)) for _ in range(9)] + ["abababababababababab", "item 0000 of the list"]

    def line():
        x = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, edits, edits + 1])):
            x = typo(x)
        return x

    texts = ["\n".join(line() if rng.random() < 0.8 else rng.choice(["", "short", "nine char"]) for _ in range(rng.randint(1, 6))) for _ in range(35)] + [None, "", base[0][:16], base[0][:15], base[0][:15], base[0][:8], base[0][:7]]
    texts += [f"item {k:04d} of the list" for k in range(0, 400, 37)]
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), edits).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(lines_by_hand(texts, edits)))


@pytest.mark.parametrize(("edits", "in_task"), [(1, 20), (2, 20), (2, 100_000), (3, 100_000)])
def test_numbered_lines_stay_unless_near_one_that_stays(spark, monkeypatch, edits, in_task):
    """Chains of near copies: a line goes for one that stays, not for one that went. Also decided in rounds."""
    monkeypatch.setattr(linededup, "IN_TASK", in_task)
    numbers = [*range(1000, 1150)] + [rng.randint(1000, 9999) for _ in range(30)]
    texts = [f"Invoice number {k} was paid in full" for k in numbers]
    rng.shuffle(texts)
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), edits).collect()
    want = lines_by_hand(texts, edits)
    assert {r.doc_id: r.text for r in got} == dict(enumerate(want))
    assert edits > 1 or sum(map(bool, want)) > 15


def test_segments_find_all_pairs_within_the_edits():
    """Two lines within the edits share a key, and go on sharing one down to the leaf."""
    for _ in range(60):
        edits = rng.randint(1, 3)
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(8, 12)))
        b = a
        for _ in range(edits):
            b = typo(b) if len(b) > 8 else b + "a"
        if len(b) < len(a):
            a, b = b, a

        def names(line, host, pairs):
            out, todo = set(), pairs
            while todo:
                key, parts, as_host = todo.pop()
                found = linededup.split(parts, as_host)
                if found is None:
                    out |= {(key, n, as_host) for n in linededup.leaf_names(line, parts, as_host)}
                else:
                    todo += [((*key, tag, line[x:y]), rest, h) for tag, x, y, h, rest in found]
            return out

        every = linededup.probes(edits)
        starts = []
        for line in (a, b):
            here = []
            for longer, j, shift in every:
                n = len(line) - longer
                x, y = j * n // (edits + 1) + shift, (j + 1) * n // (edits + 1) + shift
                if n > edits and x >= 0 and y <= len(line):
                    here.append(((n, j, line[x:y]), linededup.first_parts((longer, j, shift), len(line), edits), longer == 0 and shift == 0))
            starts.append(here)
        hosts = {(k, n) for k, n, h in names(a, True, starts[0]) if h}
        others = {(k, n) for k, n, _ in names(b, False, starts[1])}
        near = levenshtein(a, b) <= edits
        assert bool(hosts & others) == near, (a, b, edits)


def test_lines_of_a_very_long_document(spark):
    """80,000 lines in one text: time follows their number."""
    text = "\n".join(f"{k:06d} {hashlib.md5(str(k).encode()).hexdigest()}" for k in range(80_000))
    began = time.perf_counter()
    got = linededup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).select("doc_id", F.length("text").alias("n"), "line_dedup.*").collect()
    assert {r.doc_id: (r.n, r.n_lines, r.n_removed) for r in got} == {1: (len(text), 80_000, 0), 2: (0, 80_000, 80_000)}
    assert time.perf_counter() - began < 60


def test_lines_of_edge_cases(edges, nothing):
    got = linededup.dedup_lines(edges)
    assert got.columns == [*edges.columns, "line_dedup"] and got.count() == len(EDGES)
    assert linededup.dedup_lines(edges.withColumn("line_dedup", F.lit(1))).columns == [*edges.columns, "line_dedup_input", "line_dedup"]
    assert {r.doc_id: r.text for r in got.collect() if r.doc_id != 8} == {i: t for i, t in EDGES if i != 8}
    assert linededup.dedup_lines(nothing).count() == 0


# The whole


def test_pipeline_equals_brute_force(spark, tmp_path, library):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [prose(40) for _ in range(20)]
    texts = [*base, *base[:5], *(edited(t, 1) for t in base[:6]), "12 34", None, "!!"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    after = lines_by_hand([t for t in texts if t and re.search("[a-z]", t)])
    group = classes_by_hand(after)
    want = {i: after[i] for i in set(group)}
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(t, add_eos=True) for i, t in want.items()}
    assert all(r.round_trip and r.n_chars == len(want[r.doc_id]) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "tokenize"]


def test_pipeline_language_keeps_clean_documents_and_fills_null_lang(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kinds = {"en": "the weather is nice and they were walking through the woods", "ru": "погода хорошая и они гуляли по лесу весь день"}
    rows = [(k, f"{kinds[x]} {word() if x == 'en' else 'снова'}", x, "s", 9) for k, x in enumerate(["en", "ru"] * 30)]
    rows += [(100, kinds["en"], None, "s", 9), (101, kinds["ru"], None, "s", 9), (102, "12 34", None, "s", 5), (103, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id: r.lang for r in got.collect()} == {**{r[0]: r[2] for r in rows[:60]}, 100: "en", 101: "ru"}
    blank = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert {r.doc_id: r.lang for r in blank} == {**dict.fromkeys(range(60)), 100: None, 101: None}


def test_helpers(spark):
    ids = [rng.randint(-1000, 1000) for _ in range(500)] + [7] * 400
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)] * 300, "k long").withColumn("h", F.xxhash64(F.monotonically_increasing_id()))
    for n in (1, 2, 7, 40):
        ranges = common.Ranges.of(df, "k", n)
        assert ranges.cuts == sorted(ranges.cuts) and len(ranges.cuts) == n - 1
        got = sorted(((r.k is not None, r.k or 0, r.h), r.b) for r in df.select("k", "h", ranges.number(F.col("k"), F.col("h")).alias("b")).collect())
        numbers = [b for _, b in got]
        assert numbers == sorted(numbers) and 0 <= numbers[0] and numbers[-1] < ranges.count  # in order of key and hash
        assert max(Counter(numbers).values()) <= 3 * len(got) / n + 9  # the hot key and the nulls are cut
    labels = spark.createDataFrame([("a" if k % 9 else "b", k) for k in range(2000)], "g string, k long")
    chosen = common.bounded_sample(labels, "g", "k", 150).collect()
    assert {g: sorted(r.rn for r in chosen if r.g == g) for g in "ab"} == {"a": list(range(1, 151)), "b": list(range(1, 151))}
    assert common.renamed(labels.withColumn("K_input", F.lit(1)), "k", "z").columns == ["g", "k_input_", "K_input"]
