"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksift.llm.common import document_keys, forget, materialize, renamed, slices, tidy
from stacksift.llm.components import components
from stacksift.llm.minhash import mixed

#: Lines within this many edits are near copies; a line is cut into one segment more.
EDITS = 1
#: Shorter lines (in code points) are compared for equality only, and still shorter ones always kept.
MIN_CHARS, EXACT_CHARS = 16, 8
#: Members of a bucket that are compared with each other; larger buckets are split by a further segment.
SMALL = 32
#: Group memberships of a component that one task goes through; larger components are decided in rounds.
IN_TASK = 100_000
#: Candidate lines up to this number are broadcast as (key, position) to fetch their text; more are joined.
FEW = 100_000

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


class Powers:
    """Powers of BASE and of its inverse, modulo 2 ** 64."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 1 << 20)
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)])) for b in (BASE, INVERSE))
        return cls.up, cls.down


class Prefixes:
    """Hashes of any substring of some lines in constant time, from prefix sums over all of them."""

    def __init__(self, lines: list[str]):
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        up, self.down = Powers.upto(len(code))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(code.astype(np.uint64)) * up[: len(code)])])
        self.length = np.array([len(x) for x in lines], dtype=np.int64)
        self.start = self.length.cumsum() - self.length

    def of(self, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of characters a to b (not with b) of lines row."""
        i, j = self.start[row] + a, self.start[row] + b
        return mixed((self.sums[j] - self.sums[i]) * self.down[i] + (b - a).astype(np.uint64))


def window(j: int, b: int, delta: int) -> range:
    """Where segment j of a host may stand in a visitor that is delta longer, relative to its place in the host.

    Of b edits at most j lie in front of the segment and b - j behind it.
    """
    return range(max(-j, delta - (b - j)), min(j, delta + (b - j)) + 1)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much longer than the host, segment, shift) of a line's keys: as a host first, then as a visitor."""
    visits = [(d, j, o) for d in range(edits + 1) for j in range(edits + 1) for o in window(j, edits, d)]
    return [(0, j, 0) for j in range(edits + 1)] + [v for v in visits if v[0] or v[2]]


def line_keys(p: Prefixes, edits: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether they hold) of all lines and probes. A host's segments are its even (edits + 1)-ths."""
    row, keys, holds = np.arange(len(p.length)), [], []
    for longer, j, shift in probes(edits):
        host = p.length - longer
        start, end = j * host // (edits + 1), (j + 1) * host // (edits + 1)
        ok = (host >= min_chars) & (start + shift >= 0) & (end + shift <= p.length)
        a, b = np.where(ok, start + shift, 0), np.where(ok, end + shift, 0)
        keys.append(mixed(mixed(host.astype(np.uint64)) ^ mixed(p.of(row, a, b) ^ np.uint64(j + 1))))
        holds.append(ok)
    return np.stack(keys, axis=1), np.stack(holds, axis=1)


#: What is still open of a line in a bucket: characters of the host, own first and last (not with it) character, edits left.
Part = tuple[int, int, int, int]


def first_parts(probe: tuple[int, int, int], length: int, edits: int) -> list[Part]:
    longer, j, shift = probe
    host = length - longer
    start, end = j * host // (edits + 1), (j + 1) * host // (edits + 1)
    return [(start, 0, start + shift, j), (host - end, end + shift, length, edits - j)]


def split(parts: list[Part], host: bool) -> Iterator[tuple[int, int, int, bool, list[Part]]] | None:
    """The buckets that a member's bucket is split into: (segment, its start, its end, as a host, parts); None at a leaf.

    The longest open part of the host is cut into segments, one more than its edits; two lines that are
    within them share one. All members of a bucket have the same parts of the host. Hosts among themselves
    are of one length, but edits within a part may shift a segment, so a host is a visitor there too.
    """
    at = max(range(len(parts)), key=lambda i: parts[i][0] if parts[i][0] > parts[i][3] else 0)
    size, lo, hi, b = parts[at]
    if size <= b:
        return None

    def children() -> Iterator[tuple[int, int, int, bool, list[Part]]]:
        for j in range(b + 1):
            start, end = j * size // (b + 1), (j + 1) * size // (b + 1)
            for shift in window(j, b, hi - lo - size):
                x, y = lo + start + shift, lo + end + shift
                if lo <= x and y <= hi:
                    yield at << 8 | j, x, y, host and shift == 0, [*parts[:at], *parts[at + 1 :], (start, lo, x, j), (size - end, y, hi, b - j)]

    return children()


def leaf_names(line: str, parts: list[Part], host: bool) -> list[str]:
    """Names of a member of a leaf, where no part of the host has more characters than edits.

    A host has one for each choice of its open characters, none of them too: hosts are within the edits of
    each other. A visitor has the choices that an alignment within each part's edits can match.
    """
    names = [""]
    for size, lo, hi, b in parts:
        own, found = line[lo:hi], set()
        for m in range(min(size, len(own)) + 1):
            for i in combinations(range(size), m):
                for k in [i] if host else combinations(range(len(own)), m):
                    gaps = zip((-1, *i), (*i, size), (-1, *k), (*k, len(own)), strict=True)
                    if host or sum(max(b2 - a2, d2 - c2) - 1 for a2, b2, c2, d2 in gaps) <= b:
                        found.add("".join(f"{x}{own[y]}" for x, y in zip(i, k, strict=True)))
        names = [f"{n}|{f}" for n in names for f in found]
    return names


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance if it is at most `most` (up to 31), else most + 1: bit-parallel in a diagonal band.

    Bit vectors hold the vertical differences of the band's 2 * most + 1 cells of a column; they move
    one row down with each column.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a:
        return min(len(b), most + 1)
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # Bit k of column j stands for row j - most + k; rows above 0 act as if they were an edge of zeros.
    vp, vn, distance = full & ~((1 << most) - 1), 0, min(most, len(a))
    top = 1 << (width - 1)
    for j, c in enumerate(b):
        first = j - most
        match = (where.get(c, 0) >> first if first >= 0 else where.get(c, 0) << -first) & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + most < len(a):
            distance += not d0 & top
        else:
            row = 1 << (len(a) - 1 - first) if len(a) - 1 - first >= 0 else 0
            distance += bool(hp & row) - bool(hn & row)
        vp = (hn | ~(d0 >> 1 | hp)) & full
        vn = d0 >> 1 & hp
    return min(distance, most + 1)


def line_order() -> Column:
    """Where a line stands in the corpus: by doc_id (nulls last), the document's hash and the line's number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "pos")


def line_rows(docs: DataFrame, edits: int, min_chars: int, exact_chars: int) -> DataFrame:
    """(doc_id, k1, k2, pos, d1, d2, keys) for each line of at least exact_chars code points.

    d1 and d2 are a 128-bit digest of the line; keys has one key per probe, null where the probe cannot be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                lines, doc, pos = [], [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    for k, x in enumerate((t or "").split("\n")):
                        if len(x) >= exact_chars:
                            lines.append(x)
                            doc.append(i)
                            pos.append(k)
                if not lines:
                    continue
                digest = np.frombuffer(b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines), dtype=np.int64).reshape(-1, 2)
                keys, holds = line_keys(Prefixes(lines), edits, min_chars)
                flat = pa.array(keys.ravel().view(np.int64), mask=~holds.ravel())
                at = pa.array(doc, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("k1").take(at), b.column("k2").take(at), pa.array(pos, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * keys.shape[1], pa.int32()), flat)],
                    ["doc_id", "k1", "k2", "pos", "d1", "d2", "keys"],
                )

    return docs.select("doc_id", "text", "k1", "k2").mapInArrow(tidy(run), "doc_id long, k1 long, k2 long, pos int, d1 long, d2 long, keys array<long>")


def buckets(members: DataFrame) -> DataFrame:
    """Members (key, uid, host and other columns) of the buckets that hold a host and another line, with the bucket's size n."""
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.max("host").alias("any")).where("n > 1 and any").select("key", "n")
    shared = materialize(shared, "shared")
    found = materialize(members.join(shared, "key"), "buckets")
    forget(shared)
    return found


def small_pairs(found: DataFrame) -> DataFrame:
    """Pairs of a host and another line of buckets of at most SMALL members."""
    few = found.where(F.col("n") <= SMALL)
    a, b = few.where("host").select("key", F.col("uid").alias("a")), few.select("key", F.col("uid").alias("b"), "host")
    return a.join(b, "key").where("a <> b and (not host or a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def split_members(hot: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Members (key, uid, host, parts, leaf) of the buckets that hot ones (key, uid, host, probe or parts) are split into.

    parts holds four numbers per Part; leaf marks buckets that need no further split.
    """
    every = probes(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "line"):
                lines = b.column("line").to_pylist()
                row, key, lo, hi, tag, out = [], [], [], [], [], []
                for i, (line, k, uid, host, probe, flat) in enumerate(zip(lines, *(b.column(c).to_pylist() for c in ("key", "uid", "host", "probe", "parts")), strict=True)):
                    parts = first_parts(every[probe], len(line), edits) if flat is None else list(zip(*[iter(flat)] * 4, strict=True))
                    found = split(parts, host)
                    if found is None:
                        for name in leaf_names(line, parts, host):
                            digest = hashlib.blake2b(f"{k}{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                            out.append((int.from_bytes(digest, "little", signed=True), uid, host, [], True))
                    else:
                        for t, x, y, as_host, rest in found:
                            row.append(i), key.append(k), lo.append(x), hi.append(y), tag.append(t)
                            out.append((len(row) - 1, uid, as_host, [n for part in rest for n in part], False))
                if row:
                    inner = Prefixes(lines).of(np.array(row), np.array(lo), np.array(hi))
                    keys = mixed(np.array(key, dtype=np.int64).view(np.uint64) ^ mixed(inner ^ (np.array(tag, dtype=np.uint64) << np.uint64(8)) + np.uint64(7))).view(np.int64).tolist()
                    out = [x if x[4] else (keys[x[0]], *x[1:]) for x in out]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "uid", "host", "parts", "leaf"])

    rows = hot.join(texts, "uid").select("key", "uid", "host", "probe", "parts", "line")
    return rows.mapInArrow(tidy(run), "key long, uid long, host boolean, parts array<int>, leaf boolean")


def leaf_groups(parts: DataFrame) -> DataFrame:
    """(g, uid, host, head) for the members of leaves g with a host, the least of which is head.

    In a leaf every host is within the edits of all other members; others need not be of each other.
    """
    members = parts.where("leaf").groupBy(F.col("key").alias("g"), "uid").agg(F.max("host").alias("host"))
    heads = materialize(members.groupBy("g").agg(F.min(F.when(F.col("host"), F.col("uid"))).alias("head"), F.count("*").alias("n")).where("head is not null and n > 1"), "heads")
    return members.join(heads.select("g", "head"), "g")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, line) for wanted (uid, k1, k2, pos): the pos-th line of document k1, k2."""
    places = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "uid")).alias("w"))
    if wanted.count() <= FEW:
        places = F.broadcast(places)
    found = docs.select("k1", "k2", "text").join(places, ["k1", "k2"]).select(F.split("text", "\n").alias("s"), F.explode("w").alias("w"))
    return found.select(F.col("w.uid").alias("uid"), F.get("s", F.col("w.pos")).alias("line")).dropDuplicates(["uid"])


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of lines that are within so many edits of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [edit_distance(x, y, edits) <= edits for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.distinct().join(texts.select(F.col("uid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("uid").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


#: Columns of a place in the corpus, in the order of comparison.
PLACE = ["at.none", "at.doc_id", "at.k1", "at.k2", "at.pos"]


def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, near): of memberships (label, uid, g, host) in the order of label and place, lines near an earlier one that stays.

    A line goes if one of its groups holds a line that stays and one of the two is a host there.
    """
    label = line = None
    hosts: dict[int, int] = {}
    others: dict[int, int] = {}
    own: list[tuple[int, bool]] = []

    def decided() -> int | None:
        for g, host in own:
            near = hosts.get(g) if hosts.get(g) is not None or not host else others.get(g)
            if near is not None:
                return near
        for g, host in own:
            (hosts if host else others).setdefault(g, line)
        return None

    for b in batches:
        out = []
        for now, uid, g, host in zip(*(b.column(c).to_pylist() for c in ("label", "uid", "g", "host")), strict=True):
            if line is not None and (uid != line or now != label):
                out.append((line, decided()))
                own.clear()
            if now != label:
                hosts.clear(), others.clear()
            label, line = now, uid
            own.append((g, host))
        gone = [x for x in out if x[1] is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in gone], pa.int64()) for k in (0, 1)], ["uid", "near"])
    if own:
        near = decided()
        yield pa.RecordBatch.from_arrays([pa.array([x] if near is not None else [], pa.int64()) for x in (line, near)], ["uid", "near"])


def in_tasks(members: DataFrame) -> DataFrame:
    """greedy() for memberships (label, g, uid, host, at) of components that each fit a task."""
    ordered = members.repartition("label").sortWithinPartitions("label", *PLACE, "uid")
    return ordered.select("label", "uid", "g", "host").mapInArrow(tidy(greedy), "uid long, near long")


def in_rounds(members: DataFrame) -> DataFrame:
    """greedy() for large components: in each round the lines that come first in all their groups stay, and others of these groups go.

    A round decides the first open line of every component at least; once few memberships are open, one task ends it.
    """
    gone = None
    while members.count() > IN_TASK:
        first = members.groupBy("g").agg(F.min("at").alias("any"), F.min(F.when(F.col("host"), F.col("at"))).alias("first_host"))
        leads = F.when(F.col("host"), F.col("any") == F.col("at")).otherwise(F.col("first_host").isNull() | (F.col("first_host") > F.col("at")))
        stays = materialize(members.join(first, "g").groupBy("uid").agg(F.bool_and(leads).alias("leads")).where("leads").select("uid"), "stays")
        kept = members.join(stays, "uid").groupBy("g").agg(F.min("uid").alias("one"), F.min(F.when(F.col("host"), F.col("uid"))).alias("one_host"))
        open_ = members.join(stays, "uid", "left_anti")
        near = F.when(F.col("host"), F.col("one")).otherwise(F.col("one_host"))
        went = materialize(open_.join(kept, "g").where(near.isNotNull()).groupBy("uid").agg(F.min(near).alias("near")), "went")
        gone = went if gone is None else gone.unionByName(went)
        members = materialize(open_.join(went, "uid", "left_anti"), "open")
    last = in_tasks(members.withColumn("label", F.lit(0).cast("long")))
    return last if gone is None else gone.unionByName(last)


def near_kept(edges: DataFrame, leaves: DataFrame | None, firsts: DataFrame) -> DataFrame:
    """(uid, near): the lines of firsts (uid, at) that go, each with a line within the edits of it that stays.

    In corpus order a line stays unless one that stays is joined to it, by an edge (a, b) or in a leaf (g, uid, host).
    """
    labels = components(edges)
    pair = F.xxhash64(F.lit("pair"), "a", "b").alias("g")
    groups = edges.select(pair, F.explode(F.array("a", "b")).alias("uid"), F.lit(True).alias("host"))
    if leaves is not None:
        groups = groups.unionByName(leaves.select("g", "uid", "host"))
    members = materialize(groups.join(labels.withColumnRenamed("node", "uid"), "uid").join(firsts.select("uid", "at"), "uid"), "members")
    large = materialize(members.groupBy("label").count().where(F.col("count") > IN_TASK).select("label"), "large")
    gone = in_tasks(members.join(large, "label", "left_anti"))
    if not large.isEmpty():
        gone = gone.unionByName(in_rounds(members.join(large, "label", "left_semi")))
    gone = materialize(gone, "gone")
    forget(labels, members, large)
    return gone


def kept_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """(uid, at) of the different lines that stay; at is the line's first place in the corpus.

    docs has doc_id, text, k1 and k2. Equal lines are one line. In corpus order a line of at least min_chars code
    points goes if it is within so many edits of one that stays; each that goes has been compared with such a one.
    """
    rows = line_rows(docs, edits, min_chars, exact_chars)
    firsts = rows.groupBy("d1", "d2").agg(F.min(line_order()).alias("at"), F.first("keys").alias("keys"))
    firsts = materialize(firsts.select("at", "keys").withColumn("uid", F.monotonically_increasing_id()), "lines")
    members = firsts.select("uid", F.posexplode("keys").alias("probe", "key")).where("key is not null")
    members = members.select("key", "uid", (F.col("probe") <= edits).alias("host"), F.col("probe").cast("byte").alias("probe"))
    found = buckets(members)
    wanted = materialize(firsts.join(found.select("uid").distinct(), "uid").select("uid", "at.k1", "at.k2", "at.pos"), "wanted")
    texts = materialize(line_texts(docs, wanted), "texts")
    pairs, leaves, used = small_pairs(found), None, [found, wanted]
    hot = found.where(F.col("n") > SMALL).withColumn("parts", F.lit(None).cast("array<int>"))
    while not hot.isEmpty():
        parts = materialize(split_members(hot, texts, edits), "parts")
        more = materialize(leaf_groups(parts), "leaves")
        pairs = pairs.union(more.where("uid <> head").select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b")))
        leaves = more if leaves is None else leaves.unionByName(more)
        inner = buckets(parts.where("not leaf").drop("leaf").distinct())
        pairs = pairs.union(small_pairs(inner))
        hot = inner.where(F.col("n") > SMALL).withColumn("probe", F.lit(None).cast("byte"))
        used += [parts, inner, more]
    edges = materialize(verified(pairs, texts, edits), "edges")
    gone = near_kept(edges, leaves, firsts)
    sure = materialize(verified(gone.select(F.col("uid").alias("a"), F.col("near").alias("b")), texts, edits), "sure")
    forget(*used, edges, gone, texts)
    return firsts.select("uid", "at").join(sure.select(F.col("a").alias("uid")), "uid", "left_anti")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """docs with repeated lines taken out of text, and columns n_lines and n_removed of struct line_dedup.

    In the order of the corpus (by doc_id, nulls last, then the text's hash and the line's number) a line goes if an
    equal one stays before it or, for at least min_chars code points, one that is within so many edits. Nothing goes
    for being near a line that went. Lines under exact_chars code points always stay. Lines end at a line feed.
    All rows stay; a row whose lines all went has an empty text. Null text stays null.
    Rows equal in doc_id and text count as one document, so each of them gets the same text. Other columns
    pass through as they are, one named line_dedup as line_dedup_input; an empty table gives an empty result.

    A hot line costs one row after partial aggregation. Buckets of more than SMALL lines are never
    expanded into pairs but split by further segments until they are small or differ in a few characters.
    With one edit that stays linear; with more, a family of lines meets again in several segments' buckets.
    Which lines stay is decided component by component inside tasks; components of more than IN_TASK memberships
    are decided in rounds over the whole table.
    """
    docs = renamed(docs, "line_dedup")
    names = docs.columns
    keyed = document_keys(docs.select("doc_id", "text"))
    lines = kept_lines(keyed, edits, min_chars, exact_chars)
    kept = materialize(lines.groupBy("at.k1", "at.k2").agg(F.collect_list("at.pos").alias("kept")), "kept")
    whole = document_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("r")))
    joined = whole.join(kept, ["k1", "k2"], "left").withColumn("s", F.split("text", "\n"))
    short = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.char_length(F.get("s", i)) < exact_chars)
    out = joined.withColumn("stays", F.when(F.col("s").isNotNull(), F.array_sort(F.concat(short, F.coalesce("kept", F.array().cast("array<int>"))))))
    text = F.array_join(F.transform("stays", lambda i: F.get("s", i)), "\n")
    counts = F.struct(F.size("s").alias("n_lines"), (F.size("s") - F.size("stays")).alias("n_removed"))
    return out.select(*[(text if c == "text" else F.col(f"r.`{c}`")).alias(c) for c in names], counts.alias("line_dedup"))
