"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stacksift.llm.common import renamed, slices, tidy, with_field

SPACE = "▁"
#: Chunks up to this length are merged together, in arrays; longer ones one by one, on a heap.
LONG = 48
#: Entries of the chunk memory of one Python worker; a full one is emptied.
MEMORY = 60_000
#: Chunks that are merged at a time.
TOGETHER = 20_000
#: Size of a table of mergeable pairs, as a power of two.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model file; small, of a fixed size, so it may be broadcast."""

    pieces: list[str]
    scores: list[float]
    mergeable: list[bool]
    byte_ids: dict[int, int]
    unknown: int
    end: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads the model; its normalizer must be the identity with a dummy space in front."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  b \n ") != f"{SPACE}a{SPACE}{SPACE}b \n{SPACE}":
            raise ValueError("only models with the identity normalizer are supported")
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces must not run over a word's start")
        return cls(pieces, [model.get_score(i) for i in range(n)], [not s for s in special], byte_ids, model.unk_id(), model.eos_id())


class Encoder:
    """Merges adjacent symbols, best score first and leftmost among equals, as long as the result is a piece."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.id_of = {p: i for i, p in enumerate(v.pieces) if v.mergeable[i]}
        ranked = sorted((i for i in self.id_of.values()), key=lambda i: -v.scores[i])
        rank, last = {}, None
        for i in ranked:  # equal scores share a rank, so the leftmost wins
            if last is None or v.scores[i] != last:
                last = v.scores[i]
                step = len(rank)
            rank[i] = step
        pairs = []
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank[i], i))
        self.pair_rank = np.array([x[1] for x in pairs] + [2**31 - 1], dtype=np.int32)
        self.pair_id = np.array([x[2] for x in pairs] + [-1], dtype=np.int64)
        self.none = len(pairs)  # the place of pairs that don't merge
        self.tables = []  # hash tables without collisions: what finds its place taken goes on to the next
        keys, places = np.array([x[0] for x in pairs], dtype=np.int64), np.arange(len(pairs), dtype=np.int32)
        while len(keys):
            slot = self.slot_of(keys)
            slots, first = np.unique(slot, return_index=True)
            table_keys, table_places = np.full(SLOTS, -1, dtype=np.int64), np.full(SLOTS, self.none, dtype=np.int32)
            table_keys[slots], table_places[slots] = keys[first], places[first]
            self.tables.append((table_keys, table_places))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, places = keys[rest], places[rest]
        self.best = {k: (r, i) for k, r, i in pairs}
        inside = set("".join(p for p in self.id_of if len(p) > 1))
        alone = "".join(c for c in "\n\t\r" if c not in inside)  # in no longer piece: a chunk may end here
        stop = re.escape(alone)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+" + (f"|[{stop}]" if alone else "")).findall
        self.forget()

    def forget(self) -> None:
        """Empties the chunk memory: a chunk's number, and by number the place of its ids in the store."""
        self.memory: dict[str, int] = {}
        self.store, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.count = np.zeros(MEMORY, dtype=np.int64), np.zeros(MEMORY, dtype=np.int64)

    def remember(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first, n = len(self.memory), len(chunks)
        self.memory.update(zip(chunks, range(first, first + n), strict=True))
        while first + n > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        self.store[self.used : self.used + len(ids)] = ids
        self.start[first : first + n], self.count[first : first + n] = self.used + counts.cumsum() - counts, counts
        self.used += len(ids)

    def symbols(self, chunk: str) -> list[int]:
        """Ids of the characters; -1 - code point for a character outside the vocabulary."""
        get = self.id_of.get
        return [get(c, -1 - ord(c)) for c in chunk]

    def finish(self, ids: list[int]) -> tuple[int, ...]:
        """Characters outside the vocabulary become the ids of their bytes."""
        if min(ids, default=0) >= 0:
            return tuple(ids)
        byte = self.v.byte_ids
        return tuple(chain.from_iterable((i,) if i >= 0 else (byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")) for i in ids))

    def by_agenda(self, chunk: str) -> tuple[int, ...]:
        """One chunk by a heap of adjacent pairs, ordered by score and place."""
        ids = self.symbols(chunk)
        n = len(ids)
        after, before, best = list(range(1, n + 1)), list(range(-1, n - 1)), self.best
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and ids[left] >= 0 and ids[right] >= 0 and (found := best.get(ids[left] << 32 | ids[right])):
                heapq.heappush(agenda, (found[0], left, ids[left], ids[right], found[1]))

        for i in range(n - 1):
            offer(i)
        gone = -(2**30)
        while agenda:
            _, left, a, b, merged = heapq.heappop(agenda)
            if ids[left] != a or (right := after[left]) >= n or ids[right] != b:
                continue  # one of the two has been merged meanwhile
            ids[left], ids[right] = merged, gone
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return self.finish([i for i in ids if i != gone])

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs in the pair table; its last place for pairs that don't merge."""
        keys = (a << 32) | b
        slot = self.slot_of(keys)
        at = np.full(len(keys), self.none, dtype=np.int32)
        for table_keys, table_places in self.tables:
            hit = table_keys[slot] == keys
            at[hit] = table_places[slot[hit]]
        at[(a < 0) | (b < 0)] = self.none
        return at

    @staticmethod
    def slot_of(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of one length, one after the other, and their numbers of ids: in each round, every chunk merges the first pair of its own agenda."""
        n, width = len(chunks), len(chunks[0])
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        used, back = np.unique(code, return_inverse=True)
        ids = np.array([self.id_of.get(chr(c), -1 - c) for c in used.tolist()], dtype=np.int64)[back].reshape(n, width)
        live, size, out = np.arange(n), np.full(n, width), ids.copy()
        if width > 1:
            pair = self.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while width > 1 and len(live):
            rank = self.pair_rank[pair]
            first = rank.argmin(axis=1)
            row = np.arange(len(live))
            at = pair[row, first]
            go = at < self.none
            if not go.all():
                out[live[~go], :width] = ids[~go]
                live, ids, pair, first, at = live[go], ids[go], pair[go], first[go], at[go]
                row = row[: len(live)]
            if not len(live):
                break
            size[live] -= 1
            ids[row, first] = self.pair_id[at]
            grid = np.arange(width - 1)
            source = grid + (grid[None, :] > first[:, None])  # all behind the merged pair move up by one
            ids = np.take_along_axis(ids, source, axis=1)
            width -= 1
            if width > 1:
                pair = np.take_along_axis(pair, source[:, :-1], axis=1)
                left, right = np.maximum(first - 1, 0), np.minimum(first, width - 2)
                pair[row, left] = self.look_up(ids[row, left], ids[row, left + 1])
                pair[row, right] = self.look_up(ids[row, right], ids[row, right + 1])
        if len(live):
            out[live, :width] = ids
        flat = out[np.arange(out.shape[1]) < size[:, None]]
        if (flat >= 0).all():
            return flat, size
        full = [self.finish(x[:k]) for x, k in zip(out.tolist(), size.tolist(), strict=True)]
        return np.array(list(chain.from_iterable(full))), np.array([len(x) for x in full])

    def learn(self, chunks: set[str]) -> None:
        same: dict[int, list[str]] = {}
        for c in chunks:
            same.setdefault(len(c), []).append(c)
        for n, group in same.items():
            if n > LONG:
                for c in group:
                    ids = np.array(self.by_agenda(c))
                    self.remember([c], ids, np.array([len(ids)]))
            else:
                for k in range(0, len(group), TOGETHER):
                    self.remember(group[k : k + TOGETHER], *self.together(group[k : k + TOGETHER]))

    def encode(self, texts: list[str | None], tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the edges between texts; tail: an id for each text's end."""
        if len(self.memory) > MEMORY:
            self.forget()
        split = [self.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        chunks = list(chain.from_iterable(split))
        number = np.fromiter(map(self.memory.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self.learn({chunks[i] for i in new})
            number[new] = [self.memory[chunks[i]] for i in new]
        count = self.count[number]
        ids = self.store[spans(self.start[number], count)]
        of_text = np.concatenate([[0], np.cumsum([len(s) for s in split])])
        edges = np.concatenate([[0], count.cumsum()])[of_text]
        if tail is not None:
            ids = np.insert(ids, edges[1:], tail)
            edges = edges + np.arange(len(edges))
        return ids, edges

    def encode_lists(self, texts: list[str | None]) -> list[list[int]]:
        ids, edges = self.encode(texts)
        return [x.tolist() for x in np.split(ids, edges[1:-1])] if texts else []


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1], and so on."""
    before = count.cumsum() - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


class Decoder:
    #: Stand-ins, while pieces are joined, for byte 0 (others count down) and for ids that are silent.
    ZERO, SILENT = 0x10FFFF, "\U0010fe00"

    def __init__(self, v: Vocabulary):
        self.text = [p.replace(SPACE, " ") if m else self.SILENT for p, m in zip(v.pieces, v.mergeable, strict=True)]
        self.text[v.unknown] = " ⁇ "
        for b, i in v.byte_ids.items():
            self.text[i] = chr(self.ZERO - b)
        self.plain = {*v.byte_ids.values(), v.unknown}  # these have no dummy space in front
        self.stand_ins = re.compile(f"[{chr(self.ZERO - 255)}-{chr(self.ZERO)}]+|{self.SILENT}")

        raw = [p.replace(SPACE, " ").encode() if m else b"" for p, m in zip(v.pieces, v.mergeable, strict=True)]
        raw[v.unknown] = " ⁇ ".encode()
        for b, i in v.byte_ids.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.size = np.array([len(x) for x in raw])
        self.start = self.size.cumsum() - self.size
        self.is_byte = np.zeros(len(raw), dtype=bool)
        self.is_byte[list(v.byte_ids.values())] = True
        self.spaced = np.array([m and p.startswith(SPACE) for p, m in zip(v.pieces, v.mergeable, strict=True)])

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The texts of ids between the edges. Texts whose bytes aren't all UTF-8 take the slower way, one by one."""
        size, start = self.size[ids], self.start[ids]
        audible = np.flatnonzero(size > 0)
        first = np.searchsorted(audible, edges[:-1])
        lead = audible[first[first < len(audible)]]
        lead = np.unique(lead[self.spaced[ids[lead]]])
        inside = np.searchsorted(edges, lead, side="right") - 1
        lead = lead[lead == audible[first[inside]]]  # of its own text
        start[lead] += 1
        size[lead] -= 1
        data = self.raw[spans(start, size)].tobytes()
        at = np.concatenate([[0], size.cumsum()])[edges]
        silent = np.flatnonzero(size[:-1] == 0)  # bytes on both sides of a silent id make no character together
        try:
            data.decode()
            if self.is_byte[ids[silent + 1]].any() or any(data[i] & 0xC0 == 0x80 for i in at[:-1].tolist() if i < len(data)):
                raise UnicodeError
        except UnicodeError:
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)], pa.string())
        return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; control ids are silent, the first piece loses one space in front.

        As in the library, bytes that aren't UTF-8 become U+FFFD, one each.
        """
        first = next((k for k, i in enumerate(ids) if self.text[i] != self.SILENT), len(ids))
        out = "".join(map(self.text.__getitem__, ids[first:]))
        if out.startswith(" ") and ids[first] not in self.plain:
            out = out[1:]
        return self.stand_ins.sub(lambda m: "" if m[0] == self.SILENT else as_utf8(bytes(self.ZERO - ord(c) for c in m[0])), out)


def as_utf8(raw: bytes) -> str:
    """Valid characters; U+FFFD for each byte that is part of none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for k in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def id_lists(edges: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """df with an array column of ids: whole texts, an end id only, no sampling.

    Null and empty texts give just the end id. Any other columns, repeated rows and empty tables pass
    through, an input column named as the result as <name>_input. The vocabulary, of a fixed size, is
    broadcast; nothing is shuffled.
    """
    df = renamed(df, ids)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder(shared.value), shared.value.end if end else None
        for whole in batches:
            for b in slices(whole, text):
                flat, edges = encoder.encode(b.column(text).to_pylist(), tail)
                yield pa.RecordBatch.from_arrays([*b.columns, id_lists(edges, flat)], [*b.schema.names, ids])

    return df.mapInArrow(tidy(run), with_field(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give null. Clashing names: see encode."""
    df = renamed(df, text)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                column = b.column(ids)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                found = decoder.decode_all(column.flatten().to_numpy(), np.concatenate([[0], counts.cumsum()]))
                if column.null_count:
                    found = pa.compute.if_else(column.is_valid(), found, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, text])

    return df.mapInArrow(tidy(run), with_field(df, text, T.StringType()))


def round_trip(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", end: bool = True) -> DataFrame:
    """df with its texts' ids and the text decoded from them: encode() and decode() in one pass over the rows."""
    df = renamed(df, ids, decoded)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, tail = Encoder(shared.value), Decoder(shared.value), shared.value.end if end else None
        for whole in batches:
            for b in slices(whole, text):
                flat, edges = encoder.encode(b.column(text).to_pylist(), tail)
                yield pa.RecordBatch.from_arrays([*b.columns, id_lists(edges, flat), decoder.decode_all(flat, edges)], [*b.schema.names, ids, decoded])

    schema = T.StructType([*with_field(df, ids, T.ArrayType(T.IntegerType())).fields, T.StructField(decoded, T.StringType())])
    return df.mapInArrow(tidy(run), schema)
