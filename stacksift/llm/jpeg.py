"""Baseline JPEG columns: texts stored as JPEG samples, and DC-only luminance thumbnails read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stacksift.llm.common import renamed, slices, tidy, with_field

#: Blocks of 8 x 8 samples in a stored image's row; one byte per block.
ROW = 64
#: Most rows of blocks in one image: a JPEG has at most 65,535 lines. Longer payloads take more images.
ROWS = 8191

#: The typical luminance DC code counts by length, with the symbols in order (ITU-T T.81, K.3).
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: The AC table of stored images holds one symbol, end of block, of one bit.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def huffman_codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): codes count up within a length and double at the next."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def huffman_window(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: symbol << 8 | code length; 0 where no code fits."""
    table = np.zeros(1 << 16, dtype=np.int32)
    for s, (code, length) in huffman_codes(counts, symbols).items():
        at = code << (16 - length)
        table[at : at + (1 << (16 - length))] = s << 8 | length
    return table


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """SOI to SOS of a grey image whose quantiser of 8 makes a DC step one grey level; one restart interval per row of blocks."""
    return b"".join((
        b"\xff\xd8",
        segment(0xDB, b"\0" + b"\x08" + b"\x01" * 63),
        segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        segment(0xDD, struct.pack(">H", ROW)),
        segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def dc_bits() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: its code, extra bits and the end of block as one number, and their bits."""
    code = huffman_codes(DC_COUNTS, DC_SYMBOLS)
    value, width = np.zeros(511, dtype=np.uint32), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        word, length = code[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], width[d + 255] = (word << size | extra) << 1, length + size + 1  # end of block: one bit, 0
    return value, width


BITS = dc_bits()


def encode_scans(payloads: list[bytes]) -> list[bytes]:
    """Entropy-coded data of each payload of at most ROWS * ROW bytes, with its restart markers."""
    value, width = BITS
    v = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int16).reshape(-1, ROW) - 128
    d = np.diff(v, axis=1, prepend=np.int16(0)) + 255
    bits, code = width[d], value[d]
    end = bits.cumsum(axis=1)
    row_bytes = (end[:, -1] + 7) // 8
    start = np.concatenate([[0], row_bytes.cumsum()])
    at = start[:-1, None] * 8 + end - bits
    total = int(start[-1])
    out = np.zeros(total + 4, dtype=np.int64)
    word = code.astype(np.int64) << (32 - bits - (at & 7))  # a code takes at most 20 bits, so four bytes hold it
    place = (at >> 3).ravel()
    for k in range(4):
        part = (word >> (24 - 8 * k)) & 255
        out += np.bincount(place + k, weights=part.ravel(), minlength=total + 4).astype(np.int64)  # bits don't overlap: sums are ors
    out = out[:total]
    pad = row_bytes * 8 - end[:, -1]
    out[start[1:] - 1] |= (1 << pad) - 1
    stuffed = np.concatenate([[0], (1 + (out == 255)).cumsum()])  # a byte FF is followed by 00
    place = stuffed[:-1].copy()
    first, of_row = 0, np.arange(len(v))
    marks, firsts = np.zeros(len(v) + 1, dtype=np.int64), []
    for p in payloads:
        firsts.append(first)
        first += len(p) // ROW
    number = of_row - np.repeat(firsts, [len(p) // ROW for p in payloads])
    marks[1:] = (2 * (number > 0)).cumsum()  # room for the markers in front of all rows but an image's first
    place += np.repeat(marks[1:], row_bytes)
    data = np.zeros(int(stuffed[-1] + marks[-1]), dtype=np.uint8)
    data[place] = out
    row_at = stuffed[start[:-1]] + marks[:-1]
    later = number > 0
    data[row_at[later]], data[row_at[later] + 1] = 0xFF, 0xD0 + (number[later] - 1) % 8
    raw = data.tobytes()
    edges = [*row_at[firsts].tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of ROW bytes, as one or more JPEG images back to back.

    A byte is the grey level of one flat block of 8 x 8 samples, which baseline JPEG keeps without loss.
    """
    parts, owner = [], []
    for i, p in enumerate(payloads):
        for k in range(0, len(p), ROW * ROWS):
            parts.append(p[k : k + ROW * ROWS])
            owner.append(i)
    out: list[list[bytes]] = [[] for _ in payloads]
    if parts:
        for i, p, scan in zip(owner, parts, encode_scans(parts), strict=True):
            out[i] += [header(len(p) // ROW), scan, b"\xff\xd9"]
    return [b"".join(x) for x in out]


@dataclass
class Image:
    """What the markers of one baseline image say."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # horizontal and vertical sampling, DC and AC table of each
    quantiser: int  # the DC step of the first component
    tables: dict[int, tuple[bytes, bytes]]
    interval: int
    scan: tuple[int, int]

    def layout(self) -> tuple:
        """Images of one layout can be decoded together."""
        used = {(0x00 | c[2]) for c in self.components} | {(0x10 | c[3]) for c in self.components}
        return (tuple(self.components), self.quantiser, tuple(sorted((k, self.tables[k]) for k in used)))

    def units(self) -> tuple[int, int]:
        """Minimum coded units across and down."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes, at: int) -> tuple[Image, int]:
    """The image that starts at `at`, and where it ends. Raises ValueError for what is no baseline image of one scan."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    frame, steps, tables, interval = None, {}, {}, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = (width, height, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)})
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("no baseline image")
    if frame is None or body[0] != len(frame[2]):
        raise ValueError("only images of one scan are supported")
    width, height, parts = frame
    order = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
    components = [(*((1, 1) if len(order) == 1 else parts[c][:2]), t >> 4, t & 15) for c, t in order]
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("no end of image")
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
        else:
            break
    return Image(width, height, components, steps[parts[order[0][0]][2]], tables, interval, (at, end)), end + 2


def decode_dc(images: list[tuple[Image, bytes]]) -> list[np.ndarray]:
    """DC values of the first component of images of one layout, in coded order.

    All restart intervals of all images advance together, one Huffman symbol at a time.
    """
    first = images[0][0]
    raw = np.frombuffer(b"".join(d for _, d in images), dtype=np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(d) for _, d in images])])
    lead = np.flatnonzero(raw[:-1] == 0xFF)
    lead = lead[(raw[lead + 1] == 0) | (raw[lead + 1] >= 0xD0)]
    stuffing, restart = lead[raw[lead + 1] == 0] + 1, lead[(raw[lead + 1] >= 0xD0) & (raw[lead + 1] <= 0xD7)]
    keep = np.ones(len(raw), dtype=bool)
    keep[stuffing] = keep[restart] = keep[restart + 1] = False
    moved = np.concatenate([[0], keep.cumsum()])
    starts = np.unique(np.concatenate([edges[:-1], restart + 2]))
    owner = np.searchsorted(edges, starts, side="right") - 1
    data = np.concatenate([raw[keep], np.full(8, 255, dtype=np.uint8)]).astype(np.uint32)
    at = moved[starts] * 8
    limit = np.concatenate([moved[starts[1:]], [moved[-1]]]) * 8
    units = [np.prod(im.units()) for im, _ in images]
    left = np.zeros(len(starts), dtype=np.int64)
    for i, (im, _) in enumerate(images):
        mine = np.flatnonzero(owner == i) if len(images) == 1 else np.arange(np.searchsorted(owner, i), np.searchsorted(owner, i + 1))
        each = im.interval or units[i]
        left[mine] = np.clip(units[i] - each * np.arange(len(mine)), 0, each)
    blocks = [c for c, (h, v, _, _) in enumerate(first.components) for _ in range(h * v)]
    dc_tables = [huffman_window(*first.tables[c[2]]) for c in first.components]
    ac_tables = [huffman_window(*first.tables[0x10 | c[3]]) for c in first.components]
    own = sum(1 for c in blocks if c == 0)
    base = np.concatenate([[0], (left * own).cumsum()])
    out = np.zeros(int(base[-1]), dtype=np.int32)
    done = np.zeros(len(starts), dtype=np.int64)
    guess = np.zeros((len(first.components), len(starts)), dtype=np.int32)
    live = np.flatnonzero(left > 0)

    def window(p: np.ndarray) -> np.ndarray:
        i = p >> 3
        return (((data[i] << 24) | (data[i + 1] << 16) | (data[i + 2] << 8) | data[i + 3]) << (p & 7).astype(np.uint32)) >> 16

    def bits(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (window(p) >> (16 - n).astype(np.uint32)).astype(np.int32)

    while len(live):
        for c in blocks:
            found = dc_tables[c][window(at[live])]
            if (found == 0).any() or (at[live] >= limit[live]).any():
                raise ValueError("broken scan")
            at[live] += found & 255
            size = found >> 8
            extra = bits(at[live], size)
            at[live] += size
            guess[c, live] += np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
            if c == 0:
                out[base[live] + done[live]] = guess[0, live]
                done[live] += 1
            inside, k = live, np.ones(len(live), dtype=np.int32)
            while len(inside):
                found = ac_tables[c][window(at[inside])]
                if (found == 0).any():
                    raise ValueError("broken scan")
                symbol = found >> 8
                at[inside] += (found & 255) + (symbol & 15)
                k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
                inside, k = inside[k < 64], k[k < 64]
        left[live] -= 1
        live = live[left[live] > 0]
    ends = base[np.searchsorted(owner, np.arange(1, len(images) + 1))]
    return np.split(out, ends[:-1])


def thumbnails(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """The images of each value with their thumbnails: one grey pixel per 8 x 8 block of the first component."""
    groups: dict[tuple, list[tuple[int, int, Image, bytes]]] = {}
    out: list[list] = []
    for i, m in enumerate(media):
        at, found = 0, 0
        out.append([])
        while at < len(m):
            image, end = parse(m, at)
            groups.setdefault(image.layout(), []).append((i, found, image, m[image.scan[0] : image.scan[1]]))
            out[i].append(None)
            at, found = end, found + 1
    for same in groups.values():
        for (i, k, image, _), dc in zip(same, decode_dc([(x[2], x[3]) for x in same]), strict=True):
            across, down = image.units()
            h, v = image.components[0][:2]
            grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
            out[i][k] = (image, np.clip(np.rint(grid * (image.quantiser / 8)) + 128, 0, 255).astype(np.uint8))
    return out


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid are brighter than the mean of all cells."""
    rows = np.linspace(0, thumbnail.shape[0], 9).astype(int)[:-1]
    cols = np.linspace(0, thumbnail.shape[1], 9).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(thumbnail.astype(np.int64), rows, axis=0), cols, axis=1)
    n = np.outer(np.maximum(1, np.diff([*rows, thumbnail.shape[0]])), np.maximum(1, np.diff([*cols, thumbnail.shape[1]])))
    cells = sums / n
    return f"{int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), 'big'):016x}"


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of ROW, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ROW if raw else ROW), len(raw)


SCHEMA = [
    ("n_bytes", T.LongType()), ("media", T.BinaryType()), ("images", T.IntegerType()), ("width", T.IntegerType()),
    ("height", T.IntegerType()), ("thumbnail", T.BinaryType()), ("thumbnail_hash", T.StringType()),
]


def media_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts stored as JPEG and what is read back from the stored bytes.

    Adds n_bytes, media, images, width and height (of all images stacked), thumbnail (grey bytes, row by
    row) and thumbnail_hash. Null counts as empty, which is stored as one row of zero bytes. Very long
    texts take several images. Equal texts get equal values; other columns and repeated rows pass through, input
    columns with a name of these as <name>_input; an empty table gives an empty result. Nothing is shuffled; texts are worked on in runs of about half a megabyte.
    """
    schema = df = renamed(df, *(n for n, _ in SCHEMA))
    for name, kind in SCHEMA:
        schema = with_field(schema, name, kind) if schema is df else T.StructType([*schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for whole in batches:
            for b in slices(whole, text):
                pairs = [text_payload(t) for t in b.column(text).to_pylist()]
                media = store([p for p, _ in pairs])
                columns: list[list] = [[n for _, n in pairs], media, *read_back(media)]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*b.schema.names, *(n for n, _ in SCHEMA)])

    return df.mapInArrow(tidy(run), schema)


def read_back(media: list[bytes]) -> list[list]:
    """Columns images, width, height, thumbnail and hash of stored values."""
    rows = []
    for found in thumbnails(media):
        gray = np.concatenate([t for _, t in found])
        rows.append((len(found), found[0][0].width, sum(im.height for im, _ in found), gray.tobytes(), average_hash(gray)))
    return [list(x) for x in zip(*rows, strict=True)]


def thumbnail_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """df with images, width, height, thumbnail and thumbnail_hash of a column of baseline JPEG values.

    Null and broken values, and images that are not baseline of one scan, give nulls.
    """
    schema = df = renamed(df, *(n for n, _ in SCHEMA[2:]))
    for name, kind in SCHEMA[2:]:
        schema = with_field(schema, name, kind) if schema is df else T.StructType([*schema.fields, T.StructField(name, kind)])

    def one(value: bytes | None) -> list:
        try:
            return [c[0] for c in read_back([value])] if value else [None] * 5
        except (ValueError, IndexError, KeyError, struct.error):
            return [None] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for whole in batches:
            for b in slices(whole, media):
                values = b.column(media).to_pylist()
                try:
                    columns = read_back(values)
                except (ValueError, IndexError, KeyError, TypeError, struct.error):  # some value is null or broken
                    columns = [list(x) for x in zip(*map(one, values), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*b.schema.names, *(n for n, _ in SCHEMA[2:])])

    return df.mapInArrow(tidy(run), schema)
