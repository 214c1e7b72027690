"""Media columns: payloads as baseline JPEG, read back as DC-only luminance thumbnails.

`decode` reads any baseline JPEG (sequential, Huffman, 8 bits a sample): it parses the
markers, decodes the scan and rebuilds the first component's thumbnail of one sample a
block from the DC coefficients. Samples are an eighth of a luminance block's DC term plus
128, clipped to 0..255. Codes are looked up 16 bits at a time, so the time is linear in the
scan. Runs between restart markers are independent: those of all pictures of a batch that
have the same tables are decoded side by side in numpy, a code of each at a time.

`encode` makes a grey JPEG whose thumbnail is the payload: one block of 8 x 8 equal
pixels for each byte, so the payload is stored without loss as 8-bit samples of the
thumbnail. The quantiser is 8 for DC; DC codes are those of the format's typical luminance
table, the AC table has one code, the end of block. A restart marker follows each row of
blocks. A payload wider than a picture may be becomes several pictures, one after another.

Null and empty texts: a payload of 192 spaces. Repeated rows have equal values. Media that
are null or that no picture can be read from (damaged, progressive, not JPEG) have null
values; they fail no batch.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import bound_batches, lean, read, utf8

UNIT = 192
#: Blocks in a row at least and at most, and rows of blocks at most, of a picture of up to 65,535 pixels each way.
ROW, WIDEST, TALLEST = 192, 8064, 8191
# Fixed values of the format: codes of each length 1, 2, ... of the typical DC table for luminance; its symbols are 0 to 11.
DC_COUNTS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: Rows of blocks whose bits are laid out at a time.
SLICE = 512


def pad(text: bytes) -> bytes:
    """text and spaces up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, as canonical Huffman tables define it."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """The bits of a block for each difference from -255 to 255, the end of block included, and their number."""
    codes = {s: (n, c) for (n, c), s in _codes(DC_COUNTS, DC_SYMBOLS).items()}
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        length, code = codes[cat]
        bits[diff + 255] = (code << cat | (diff if diff >= 0 else diff + (1 << cat) - 1)) << 1
        size[diff + 255] = length + cat + 1
    return bits, size


BITS, SIZE = _patterns()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _rows_of_bits(rows: np.ndarray) -> list[bytes]:
    """Each row's blocks as bytes of a scan, the last one filled up with ones."""
    diffs = np.diff(rows.astype(np.int16) - 128, axis=1, prepend=np.int16(0)) + 255
    bits, size = BITS[diffs], SIZE[diffs].astype(np.int64)
    rest = -size.sum(1) % 8
    bits = np.hstack([bits, ((1 << rest) - 1).astype(np.uint32)[:, None]])
    size = np.hstack([size, rest[:, None]])
    shift = (size.astype(np.int8) - 1)[:, :, None] - np.arange(int(size.max()), dtype=np.int8)
    flat = np.packbits(((bits[:, :, None] >> np.maximum(shift, 0).astype(np.uint32)) & 1).astype(np.uint8)[shift >= 0]).tobytes()
    ends = np.cumsum(size.sum(1) // 8).tolist()
    return [flat[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip([0, *ends], ends, strict=False)]


def encode_one(payload: bytes, width: int) -> bytes:
    """A picture of width blocks a row; the payload fills its rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    scan: list[bytes] = []
    for i in range(0, len(rows), SLICE):
        scan += _rows_of_bits(rows[i : i + SLICE])
    marked = [b for n, r in enumerate(scan) for b in ((r,) if not n else (bytes([0xFF, 0xD0 + (n - 1) % 8]), r))]
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * len(rows), 8 * width, 1, 1, 0x11, 0))
    head += _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0") + _segment(0xDD, struct.pack(">H", width))
    return head + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"".join(marked) + b"\xff\xd9"


def encode(payload: bytes) -> bytes:
    out, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        width = ROW
        while left // width > TALLEST and width < WIDEST:
            width = min(WIDEST, width * 2)
        if left % width:  # a row that isn't full goes into a picture of narrower rows
            take = min(left // width, TALLEST) * width
        else:
            take = min(left, TALLEST * width)
        out.append(encode_one(payload[at : at + take], width))
        at += take
    return b"".join(out)


@dataclass
class Picture:
    width: int
    height: int
    #: Of each component: name, sampling across and down, quantiser.
    parts: list[tuple[int, int, int, int]]
    #: Of each component: its DC and AC tables, as the file has them.
    tables: list[tuple[bytes, bytes]]
    #: The DC term's step.
    step: int
    restart: int
    scan: bytes

    @property
    def most(self) -> tuple[int, int]:
        return max(p[1] for p in self.parts), max(p[2] for p in self.parts)

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of the first component's blocks that show."""
        (_, h, v, _), (hm, vm) = self.parts[0], self.most
        return -(-self.height * v // (8 * vm)), -(-self.width * h // (8 * hm))

    def image(self, levels: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(levels * self.step / 8) + 128, 0, 255).astype(np.uint8)


def decode(data: bytes) -> list[np.ndarray]:
    """The thumbnails of all pictures in data."""
    return decode_many([data])[0]


def decode_many(media: list[bytes]) -> list[list[np.ndarray]]:
    """The thumbnails of each medium's pictures."""
    all_of, found = [], []
    for data in media:
        at, own = 0, []
        while at < len(data) or not own:
            picture, at = parse(data, at)
            own.append(len(all_of))
            all_of.append(picture)
        found.append(own)
    images: list[np.ndarray | None] = [None] * len(all_of)
    side: dict[tuple[bytes, bytes], list[int]] = {}
    for n, p in enumerate(all_of):
        if len(p.parts) == 1 and p.restart:
            side.setdefault(p.tables[0], []).append(n)
        else:
            rows, cols = p.grid
            images[n] = p.image(_by_code(p)[:rows, :cols])
    for tables, which in side.items():
        for n, levels in zip(which, _side_by_side([all_of[n] for n in which], *tables), strict=True):
            images[n] = all_of[n].image(levels)
    return [[images[n] for n in own] for own in found]


def parse(data: bytes, at: int = 0) -> tuple[Picture, int]:
    """The picture at `at`, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at += 2
    quant: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    parts: list[tuple[int, int, int, int]] = []
    restart = height = width = 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            raise ValueError("no scan")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("samples must have 8 bits, and pictures a size")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            end = at
            while True:  # stuffed zeros and restart markers belong to the scan
                end = data.index(b"\xff", end)
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            chosen = [(tables[use[p[0]] >> 4], tables[0x10 | use[p[0]] & 15]) for p in parts]
            return Picture(width, height, parts, chosen, quant[parts[0][3]], restart, data[at:end]), end + 2 if data[end + 1] == 0xD9 else end


@lru_cache(maxsize=16)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits, the symbol that they begin with, times 32, and the length of its code; 0 where no code is."""
    out = np.zeros(1 << 16, np.int32)
    for (length, code), symbol in _codes(table[:16], table[16:]).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 5 | length
    return out


def _side_by_side(pictures: list[Picture], dc_table: bytes, ac_table: bytes) -> list[np.ndarray]:
    """DC levels of pictures of one component with restart markers; all runs between markers advance a code at a time."""
    dc, ac = _lookup(dc_table), _lookup(ac_table)
    raw = np.frombuffer(b"".join(p.scan + b"\0" for p in pictures), np.uint8)  # a zero parts the scans
    ends = np.cumsum([len(p.scan) + 1 for p in pictures])
    ff, after = np.flatnonzero(raw[:-1] == 0xFF), raw[1:]
    marks = ff[(after[ff] >= 0xD0) & (after[ff] <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[after[ff] == 0] + 1] = keep[marks] = keep[marks + 1] = False
    starts = np.sort(np.concatenate([[0], ends[:-1], marks + 2]))
    place = np.concatenate([[0], np.cumsum(keep)])
    at, limit = place[starts] * 8, place[np.append(starts[1:], len(raw))] * 8
    data = np.concatenate([raw[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    runs = []
    for p, n in zip(pictures, np.diff(np.searchsorted(starts, [0, *ends])).tolist(), strict=True):
        blocks = p.grid[0] * p.grid[1]
        if n != -(-blocks // p.restart):
            raise ValueError("runs are missing")
        runs += [min(p.restart, blocks - i) for i in range(0, blocks, p.restart)]
    blocks = np.array(runs)
    first = np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    at, left, first = at[order].astype(np.int64), blocks[order], first[order]
    levels, last = np.zeros(int(blocks.sum()), np.int32), np.zeros(len(runs), np.int32)

    def bits(pos: np.ndarray) -> np.ndarray:
        return window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7).astype(np.uint32)

    def symbols(pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = table[bits(pos) >> np.uint32(16)]
        if not got.all():
            raise ValueError("no such code")
        return got >> 5, pos + (got & 31)

    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))  # runs with a block more
        cat, pos = symbols(at[:n], dc)
        cat = cat & 15
        extra = (bits(pos).astype(np.int64) >> (32 - cat)).astype(np.int32)
        half = (1 << cat) >> 1
        last[:n] += np.where(extra < half, extra - (1 << cat) + 1, extra)
        levels[first[:n] + step] = last[:n]
        pos = pos + cat
        open_, k, where = np.arange(n), np.ones(n, np.int32), pos
        while len(open_):
            s, where = symbols(where, ac)
            where = where + (s & 15)
            pos[open_] = where
            k = np.where(s == 0, 64, k + (s >> 4) + 1)
            go = k < 64
            if not go.any():
                break
            open_, k, where = open_[go], k[go], where[go]
        at[:n] = pos
    if (at > limit[order]).any():
        raise ValueError("the scan is cut short")
    cut = np.cumsum([p.grid[0] * p.grid[1] for p in pictures])[:-1]
    return [x.reshape(p.grid) for p, x in zip(pictures, np.split(levels, cut), strict=True)]


def _by_code(p: Picture) -> np.ndarray:
    """DC levels of the first component, one Huffman code after another."""
    lone, (h_most, v_most) = len(p.parts) == 1, p.most
    mcus_x, mcus_y = (p.grid[1], p.grid[0]) if lone else (-(-p.width // (8 * h_most)), -(-p.height // (8 * v_most)))
    h0, v0 = (1, 1) if lone else p.parts[0][1:3]
    grid = np.zeros((mcus_y * v0, mcus_x * h0), np.int32)
    runs = iter(re.split(rb"\xff[\xd0-\xd7]", p.scan))
    looks = [tuple(_lookup(t).tolist() for t in pair) for pair in p.tables]
    data, at, held, left = b"", 0, 0, 0

    def fill() -> None:
        """At least 32 bits in `held`; ones follow the run's end."""
        nonlocal at, held, left
        more = data[at : at + 6]
        held, left, at = (held & ((1 << left) - 1)) << 48 | int.from_bytes(more.ljust(6, b"\xff"), "big"), left + 48, at + 6

    def symbol(look: list[int]) -> int:
        nonlocal left
        if left < 32:
            fill()
        got = look[held >> (left - 16) & 0xFFFF]
        if not got:
            raise ValueError("no such code")
        left -= got & 31
        return got >> 5

    def take(n: int) -> int:
        nonlocal left
        if left < 32:
            fill()
        left -= n
        return held >> left & ((1 << n) - 1)

    last = [0] * len(p.parts)
    for m in range(mcus_x * mcus_y):
        if m % (p.restart or mcus_x * mcus_y) == 0:
            data, at, held, left = next(runs).replace(b"\xff\x00", b"\xff"), 0, 0, 0
            last = [0] * len(p.parts)
        for c, (_, h, v, _) in enumerate(p.parts):
            dc, ac = looks[c]
            for b in range(1 if lone else h * v):
                cat = symbol(dc) & 15
                extra = take(cat) if cat else 0
                last[c] += extra if not cat or extra >> (cat - 1) else extra - (1 << cat) + 1
                k = 1
                while k < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    k += (s >> 4) + 1
                    take(s & 15)
                if c == 0:
                    x, y = m % mcus_x, m // mcus_x
                    grid[y * v0 + (0 if lone else b // h), x * h0 + (0 if lone else b % h)] = last[0]
    return grid


def thumbnail_hash(image: np.ndarray, side: int = 8) -> str:
    """64 bits: which cells of a side x side average of the picture are over its mean."""
    rows = np.linspace(0, image.shape[0], side + 1).astype(int)[:-1]
    cols = np.linspace(0, image.shape[1], side + 1).astype(int)[:-1]
    rows = np.minimum(rows, image.shape[0] - 1)
    sums = np.stack([np.add.reduceat(image[r : max(r + 1, e)].sum(0, dtype=np.int64), cols) for r, e in zip(rows, [*rows[1:], image.shape[0]], strict=True)])
    heights = np.maximum(1, np.diff([*rows, image.shape[0]]))
    widths = np.maximum(1, np.diff([*cols, image.shape[1]]))
    means = sums / heights[:, None] / widths[None, :]
    return np.packbits(means.ravel() > means.mean()).tobytes().hex()


def store(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_bytes and media, the text's payload as JPEG."""
    bound_batches(df.sparkSession)
    schema = df.select(key).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [t.as_buffer().to_pybytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, utf8(column).alias("_bytes")).mapInArrow(lean(run), schema)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def load(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads media back: digests of payload and stored form, dimensions in pixels, and a hash of the thumbnail."""
    bound_batches(stored.sparkSession)
    names = [key, "n_bytes", *(c.split()[0] for c in READ.split(", "))]
    schema = f"{stored.select(key, 'n_bytes')._jdf.schema().toDDL()}, {READ}"

    def one(media: bytes, images: list[np.ndarray]) -> tuple:
        payload = b"".join(x.tobytes() for x in images)
        high, wide = sum(x.shape[0] for x in images), images[0].shape[1]
        feature = f"{8 * wide}x{8 * high}:" + ".".join(map(thumbnail_hash, images))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), 8 * wide, 8 * high, feature

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def readable(media: list[bytes | None]) -> list[list[np.ndarray] | None]:
        known = [m for m in media if m is not None]
        try:
            images = iter(decode_many(known))
            return [None if m is None else next(images) for m in media]
        except (ValueError, IndexError, KeyError, StopIteration, struct.error):
            return [None] if len(media) == 1 else [x for m in media for x in readable([m])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [m.as_buffer().to_pybytes() if m.is_valid else None for m in b.column(2)]
            rows = [(None,) * len(kinds) if x is None else one(m, x) for m, x in zip(media, readable(media), strict=True)]
            made = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names)

    return stored.select(key, "n_bytes", "media").mapInArrow(lean(run), schema)


def document_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(store(read(spark, sf_dir, "documents").select("doc_id", "text")))
