"""Byte-level BPE encoding and decoding by the tokenizers library, in Arrow batches."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stacksift.llm.common import renamed, slices, tidy, with_field

#: Texts are cut into pieces of about this many characters.
PIECE = 1 << 16
#: Words, and characters in words, that a Python worker remembers; then it begins anew.
MEMORY, MEMORY_CHARACTERS = 100_000, 4_000_000
#: A match of the usual patterns ends between a letter and a space that a letter follows.
SEAM = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank. Ranks must be gapless and hold every single byte."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    tokens = [found[i] for i in range(len(found))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("the vocabulary must hold every byte")
    return tokens


def merge_pairs(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair each longer token is made of, by rank: what merges of lower rank leave of its bytes."""
    rank = {t: i for i, t in enumerate(tokens)}
    pairs = []
    for limit, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = [rank.get(a + b, limit) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(at)), key=at.__getitem__)
            if at[k] >= limit:
                raise ValueError(f"token {limit} cannot be made of two earlier ones")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


def library_model(tokens: list[bytes]) -> str:
    """The vocabulary as the library's JSON: bytes as characters, a text is one word, no special tokens."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_characters()
    written = lambda token: "".join(table[b] for b in token)
    model = models.BPE(vocab={written(t): i for i, t in enumerate(tokens)}, merges=[(written(a), written(b)) for a, b in merge_pairs(tokens)])
    built = Tokenizer(model)
    built.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return built.to_str()


def pieces_of(text: str) -> list[str]:
    """text in pieces that are encoded alike alone and together; one piece where it has no seam."""
    if len(text) <= PIECE:
        return [text]
    cuts, at = [0], PIECE
    while at < len(text) and (seam := SEAM.search(text, at)):
        cuts.append(seam.start())
        at = seam.start() + PIECE
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class ByteDecoder:
    """Token ids to bytes, in arrays, through the table from characters back to bytes."""

    def __init__(self, model: str):
        back = {c: b for b, c in enumerate(byte_characters())}
        by_id = sorted(json.loads(model)["model"]["vocab"].items(), key=lambda x: x[1])
        parts = [bytes(map(back.__getitem__, token)) for token, _ in by_id]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.concatenate([[0], self.size.cumsum()[:-1]])
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, each token's first byte (and the end), and the texts' edges in bytes."""
        size = self.size[ids]
        begins = np.concatenate([[0], size.cumsum()])
        at = np.repeat(self.start[ids] - begins[:-1], size) + np.arange(begins[-1])
        return self.flat[at], begins, begins[edges]


def character_spans(flat: np.ndarray, begins: np.ndarray, edges: np.ndarray, byte_edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of its text that each token touches, as (first, end): a split character counts for all its tokens."""
    lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])  # characters begun before a byte
    own = np.repeat(lead[byte_edges[:-1]], np.diff(edges))
    inside = np.concatenate([(flat & 0xC0) == 0x80, [False]])
    return lead[begins[:-1]] - inside[begins[:-1]] - own, lead[begins[1:]] - own


class Numbers(dict):
    """Words by number, in the order of their first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Codec:
    """One Python worker's encoder and decoder. The library encodes each word once, for as long as it is remembered."""

    def __init__(self, model: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.words = regex.compile(pattern)
        self.decoder = ByteDecoder(model)
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.characters = 0
        self.flat, self.edges = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Encodes the words that have a number and no ids yet."""
        new = list(islice(self.number, len(self.edges) - 1, None))
        if new:
            found = self.library.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype=np.uint32)
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in new), np.int64, len(new)))  # in bytes, as the tokens' below
            self.edges = np.concatenate([self.edges, len(self.flat) + np.searchsorted(self.decoder.size[ids].cumsum(), ends) + 1])
            self.flat = np.concatenate([self.flat, ids])
            self.characters += sum(map(len, new))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the texts' edges among them."""
        parts, counts = [], []
        for text in texts:
            count = 0
            for piece in pieces_of(text or ""):
                parts.append(np.fromiter(map(self.number.__getitem__, self.words.findall(piece)), np.int64))
                count += 1
                if len(self.number) > MEMORY or self.characters > MEMORY_CHARACTERS:
                    self.settle(parts)
                    self.forget()
            counts.append(count)
        self.settle(parts)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        return np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint32), edges[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)

    def settle(self, parts: list[np.ndarray]) -> None:
        """Puts the ids in the place of the word numbers, which are of type int64."""
        self.learn()
        k = len(parts)
        while k and parts[k - 1].dtype == np.int64:
            k -= 1
        if k == len(parts):
            return
        at = np.concatenate(parts[k:])
        sizes = np.diff(self.edges)[at]
        ends = np.concatenate([[0], sizes.cumsum()])
        flat = self.flat[np.repeat(self.edges[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        places = np.concatenate([[0], np.cumsum([len(p) for p in parts[k:]])])
        parts[k:] = [flat[ends[a] : ends[b]] for a, b in zip(places, places[1:], strict=False)]


def binary(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def lists(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", starts: str | None = None, ends: str | None = None) -> DataFrame:
    """df with the token ids of whole texts, each match of pattern by itself, without special tokens.

    starts and ends, if given, name columns with the first character each token touches and the one after its
    last; tokens that share a split character all touch it. pattern must be one whose matches end between an
    ASCII letter and a space that a letter follows, as that of `public_tokenizers` does: very long texts are cut
    there. Null and empty texts have no ids. Repeated rows, empty tables and other columns pass through; an input
    column with a result's name comes out as <name>_input. The vocabulary, of a fixed size, is broadcast.
    """
    spans = [starts, ends] if starts and ends else []
    df = renamed(df, ids, *spans)
    shared = df.sparkSession.sparkContext.broadcast(library_model(read_ranks(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for whole in batches:
            for b in slices(whole, text):
                flat, edges = codec.encode(b.column(text).to_pylist())
                more = []
                if spans:
                    data, begins, byte_edges = codec.decoder.decode(flat, edges)
                    more = [lists(x, edges) for x in character_spans(data, begins, edges, byte_edges)]
                yield pa.RecordBatch.from_arrays([*b.columns, lists(flat, edges), *more], [*b.schema.names, ids, *spans])

    kind = T.ArrayType(T.IntegerType())
    return df.mapInArrow(tidy(run), T.StructType([*with_field(df, ids, kind).fields, *[T.StructField(n, kind) for n in spans]]))


def decode(df: DataFrame, ranks: str, ids: str = "ids", data: str = "decoded", text: str | None = None) -> DataFrame:
    """df with the bytes of its ids and, if text names a column, their text.

    A character split between tokens is whole again once its bytes are side by side; bytes that are no UTF-8, as
    at the end of a cut list of ids, become U+FFFD in the text and stay as they are in the bytes. Null ids give
    null, an id outside the vocabulary or a null inside a list is an error. Clashing names: see encode.
    """
    df = renamed(df, data, *([text] if text else []))
    shared = df.sparkSession.sparkContext.broadcast(library_model(read_ranks(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = ByteDecoder(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                column = b.column(ids)
                flat = column.flatten()
                if flat.null_count:
                    raise ValueError("ids must not hold nulls")
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                found, _, edges = decoder.decode(flat.to_numpy(), np.concatenate([[0], counts.cumsum()]))
                result = binary(found, edges)
                if column.null_count:
                    result = pa.compute.if_else(column.is_valid(), result, pa.scalar(None, pa.binary()))
                more = [pa.array([v and v.decode("utf-8", "replace") if v != b"" else "" for v in result.to_pylist()], pa.string())] if text else []
                yield pa.RecordBatch.from_arrays([*b.columns, result, *more], [*b.schema.names, data, *([text] if text else [])])

    more = [T.StructField(text, T.StringType())] if text else []
    return df.mapInArrow(tidy(run), T.StructType([*with_field(df, data, T.BinaryType()).fields, *more]))


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", packed: str = "packed", data: str = "decoded", split: str = "n_split") -> DataFrame:
    """df with its texts' ids as little-endian unsigned 32-bit integers, the bytes decoded from them, and how many tokens begin inside a character.

    encode() and decode() in one pass over the rows, in the form in which token shards are stored.
    """
    df = renamed(df, packed, data, split)
    shared = df.sparkSession.sparkContext.broadcast(library_model(read_ranks(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for whole in batches:
            for b in slices(whole, text):
                flat, edges = codec.encode(b.column(text).to_pylist())
                found, begins, byte_edges = codec.decoder.decode(flat, edges)
                inside = np.concatenate([[0], np.cumsum((found[begins[:-1]] & 0xC0) == 0x80)]) if len(flat) else np.zeros(1, np.int64)
                columns = [binary(flat.astype("<u4"), edges * 4), binary(found, byte_edges), pa.array(np.diff(inside[edges]), pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, packed, data, split])

    more = [T.StructField(packed, T.BinaryType()), T.StructField(data, T.BinaryType()), T.StructField(split, T.LongType())]
    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, *more]))
