"""Media columns: payloads stored as progressive JPEGs, and progressive JPEGs decoded to RGB tensors.

A payload's bytes become the quantised coefficients of a 4:2:0 image, 64 to a block, each byte one
coefficient of size category 8, so nothing is lost. The coefficients are written in scans that split the
spectrum and approximate successively: first all bits but the last, then the last.

The decoder accumulates the scans of a progressive Huffman JPEG into coefficient arrays, transforms the
blocks back with exact integer arithmetic, repeats the chroma samples and yields full-resolution RGB.
Scans whose Huffman table has one symbol have codes at fixed distances and are decoded as arrays; all
others are decoded symbol by symbol.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import shared
from trawl.llm.shared import small_batches

UNIT, BLOCK = 576, 64
COMMENT = b"payload "


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in the order of rising frequency: along diagonals, up and down by turns."""
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    return np.array(order)


ZIGZAG = _zigzag()


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int], bits: int) -> bytes:
    """A Huffman table whose symbols all have codes of ``bits`` bits."""
    lengths = [0] * 16
    lengths[bits - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4, *lengths, *symbols]))


def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of the given widths in bits, one after another, filled up with ones."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(ends, widths) - np.arange(total) - 1
    bits = (np.repeat(values, widths) >> place) & 1
    return np.packbits(np.append(bits, np.ones(-total % 8, np.int64)).astype(np.uint8)).tobytes()


def _category(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(float))[1].astype(np.int64)


def _mcu_order(across: int, down: int) -> np.ndarray:
    """Index of every block of the three components (luma first) in the order of an interleaved scan."""
    luma = np.arange(4 * across * down).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    chroma = np.arange(across * down)[:, None]
    return np.hstack([luma, 4 * len(chroma) + chroma, 5 * len(chroma) + chroma]).ravel()


def pad(body: bytes) -> bytes:
    """``body`` with bytes 255 up to a positive multiple of UNIT."""
    return body + b"\xff" * (-len(body) % UNIT if body else UNIT)


def encode(payload: bytes, unpadded: int) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes."""
    blocks = -(-len(payload) // BLOCK)
    mcus = -(-blocks // 6)
    across = math.isqrt(mcus)
    down = -(-mcus // across)
    grid = np.full(6 * across * down * BLOCK, 255, np.uint8)
    grid[: len(payload)] = np.frombuffer(payload, np.uint8)
    grid = grid.reshape(-1, BLOCK)
    parts = np.split(grid, [4 * across * down, 5 * across * down])
    values = np.where(grid[:, 0] >= 128, grid[:, 0], grid[:, 0].astype(np.int64) - 255)[_mcu_order(across, down)]
    rough = (values >> 1).reshape(-1, 6)
    luma = np.diff(rough[:, :4].ravel(), prepend=0).reshape(-1, 4)
    steps = np.hstack([luma, np.diff(rough[:, 4:], axis=0, prepend=0)]).ravel()
    category = _category(steps)
    extra = np.where(steps < 0, steps + (1 << category) - 1, steps)
    dc = _pack(category << category | extra, 4 + category)
    fine = []
    for part in parts:  # the last bit of each magnitude, after the code for the end of a block
        bits = np.zeros((len(part), BLOCK), np.uint8)
        bits[:, 1:] = (part[:, 1:] & 1) ^ (part[:, 1:] < 128)
        fine.append(np.packbits(bits, axis=1).tobytes())
    coarse = lambda part, a, b: (part[:, a:b] >> 1).tobytes()  # noqa: E731  a code of one zero bit, then seven bits
    out = [
        b"\xff\xd8",
        _segment(0xFE, COMMENT + b"%d %d" % (unpadded, len(payload))),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, list(range(12)), 4),
        _scan((1, 2, 3), 0, 0, 0, 1, dc),
        _table(1, [0x07], 1),
        _scan((1,), 1, 5, 0, 1, coarse(parts[0], 1, 6)),
        _scan((2,), 1, 63, 0, 1, coarse(parts[1], 1, 64)),
        _scan((3,), 1, 63, 0, 1, coarse(parts[2], 1, 64)),
        _scan((1,), 6, 63, 0, 1, coarse(parts[0], 6, 64)),
        _table(1, [0x00], 1),
        *[_scan((k + 1,), 1, 63, 1, 0, fine[k]) for k in range(3)],
        _scan((1, 2, 3), 0, 0, 1, 0, _pack(values & 1, np.ones(len(values), np.int64))),
        b"\xff\xd9",
    ]
    return b"".join(out)


# ---------------------------------------------------------------- reading


class Huffman:
    """A table by the next 16 bits: symbol << 5 | length of the code."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.only = symbols[0] if len(symbols) == 1 and lengths[0] == 1 else None
        if self.only is None:
            found = np.zeros(1 << 16, np.int64)
            code = at = 0
            for bits, n in enumerate(lengths, 1):
                for symbol in symbols[at : at + n]:
                    found[code << (16 - bits) : (code + 1) << (16 - bits)] = symbol << 5 | bits
                    code += 1
                at += n
                code <<= 1
            self.table = found.tolist()
        else:
            self.table = [self.only << 5 | 1] * (1 << 15) + [0] * (1 << 15)


_tables: dict[bytes, Huffman] = {}


class Bits:
    """A scan's data, read from the front."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
        self.words = ((padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]).tolist()
        self.at = 0

    def peek(self) -> int:
        return (self.words[self.at >> 3] >> (16 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: Huffman) -> int:
        found = table.table[self.peek()]
        if not found:
            raise ValueError("no such Huffman code")
        self.at += found & 31
        return found >> 5

    def take(self, n: int) -> int:
        value = self.peek() >> (16 - n)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        if not n:
            return 0
        value = self.take(n)
        return value if value >> (n - 1) else value - (1 << n) + 1


@dataclass
class Component:
    h: int
    v: int
    quant: int
    #: Coefficients in zigzag order, by rows of blocks; ``across`` blocks lie in a row, ``seen`` of which hold samples.
    across: int = 0
    seen: tuple[int, int] = (0, 0)
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


@dataclass
class Image:
    height: int = 0
    width: int = 0
    comment: bytes = b""
    components: dict[int, Component] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)


def _start(body: bytes, image: Image) -> None:
    _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
    for k in range(n):
        name, hv, q = body[6 + 3 * k : 9 + 3 * k]
        image.components[name] = Component(hv >> 4, hv & 15, q)
    h, v = (max(getattr(c, a) for c in image.components.values()) for a in ("h", "v"))
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    for c in image.components.values():
        c.across = across * c.h
        c.seen = (-(-image.height * c.v // (8 * v)), -(-image.width * c.h // (8 * h)))
        c.coefficients = np.zeros((down * c.v * c.across, 64), np.int32)


@lru_cache(256)
def _dc_order(shapes: tuple[tuple[int, int, int, int, int, int], ...]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """For each block of a DC scan its component; for each component its blocks and their places in the scan.

    A shape is (h, v, blocks in a row, blocks, rows seen, columns seen).
    """
    if len(shapes) == 1:
        _, _, across, _, down, wide = shapes[0]
        index = (np.arange(down)[:, None] * across + np.arange(wide)).ravel()
        return [0] * len(index), [index], [np.arange(len(index))]
    h, v, across, blocks, *_ = shapes[0]
    rows, columns = blocks // across // v, across // h
    cells = [np.arange(n).reshape(rows, v, columns, h).transpose(0, 2, 1, 3).reshape(rows * columns, -1) for h, v, _, n, *_ in shapes]
    which = np.concatenate([np.full(x.shape[1], k) for k, x in enumerate(cells)])
    which = np.tile(which, rows * columns)
    return which.tolist(), [x.ravel() for x in cells], [np.flatnonzero(which == k) for k in range(len(cells))]


def _dc_scan(parts: list[Component], tables: list[Huffman], high: int, low: int, data: bytes) -> None:
    which, blocks, places = _dc_order(tuple((c.h, c.v, c.across, len(c.coefficients), *c.seen) for c in parts))
    if high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(which)).astype(np.int32) << low
        for c, index, place in zip(parts, blocks, places, strict=True):
            c.coefficients[index, 0] |= bits[place]
        return
    words, at = Bits(data).words, 0
    before, values = [0] * len(parts), []
    codes = [t.table for t in tables]
    for k in which:
        found = codes[k][(words[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
        at += found & 31
        n = found >> 5
        if n:
            value = ((words[at >> 3] >> (16 - (at & 7))) & 0xFFFF) >> (16 - n)
            at += n
            before[k] += value if value >> (n - 1) else value - (1 << n) + 1
        values.append(before[k])
    shifted = np.array(values, np.int32) << low
    for c, index, place in zip(parts, blocks, places, strict=True):
        c.coefficients[index, 0] = shifted[place]


def _ac_first(block: np.ndarray, rows: np.ndarray | slice, table: Huffman, first: int, last: int, low: int, data: bytes, fast: bool) -> None:
    width = last - first + 1
    if fast and table.only is not None and 0 < table.only < 16:  # every coefficient has the same size
        n, count = table.only, len(block[rows]) * width
        stride = n + 1
        if stride == 8:
            bits = np.frombuffer(data, np.uint8, count).astype(np.int32)
        else:
            flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * stride).reshape(-1, stride)
            bits = flat @ (1 << np.arange(stride - 1, -1, -1, dtype=np.int32))
        values = np.where(bits >> (n - 1), bits, bits - (1 << n) + 1) << low
        block[rows, first : last + 1] = values.reshape(-1, width)
        return
    reader, run = Bits(data), 0
    for row in np.arange(len(block))[rows].tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = reader.symbol(table)
            skip, n = symbol >> 4, symbol & 15
            if n:
                k += skip
                block[row, k] = reader.signed(n) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) - 1 + (reader.take(skip) if skip else 0)
                break


def _ac_refine(block: np.ndarray, rows: np.ndarray | slice, table: Huffman, first: int, last: int, low: int, data: bytes, fast: bool) -> None:
    width, one = last - first + 1, 1 << low
    if fast and table.only == 0 and (known := block[rows, first : last + 1]).all():  # only corrections, after the end of each block
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(known) * (width + 1)).reshape(-1, width + 1)[:, 1:].astype(np.int32)
        block[rows, first : last + 1] = known + np.where(known > 0, bits, -bits) * one
        return
    reader, run = Bits(data), 0

    def correct(row: int, k: int) -> None:
        if reader.take(1):
            block[row, k] += one if block[row, k] > 0 else -one

    for row in np.arange(len(block))[rows].tolist():
        k = first
        while not run and k <= last:
            symbol = reader.symbol(table)
            skip, n = symbol >> 4, symbol & 15
            if not n and skip < 15:
                run = (1 << skip) + (reader.take(skip) if skip else 0)
                break
            value = (one if reader.take(1) else -one) if n else 0
            while k <= last:  # corrections on the way to the place of the new coefficient
                if block[row, k]:
                    correct(row, k)
                elif skip:
                    skip -= 1
                else:
                    block[row, k] = value
                    k += 1
                    break
                k += 1
        if run:
            for at in range(k, last + 1):
                if block[row, at]:
                    correct(row, at)
            run -= 1


def _seen_blocks(seen: tuple[int, int], across: int, blocks: int) -> np.ndarray | slice:
    """The blocks of a scan of one component: those that hold samples."""
    return slice(None) if seen[0] * seen[1] == blocks else (np.arange(seen[0])[:, None] * across + np.arange(seen[1])).ravel()


def decode(data: bytes, fast: bool = True) -> Image:
    """The coefficients of a progressive JPEG, from all its scans. Restart intervals are not read."""
    image, tables, at = Image(), {}, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker, size = data[at + 1], 0
        if marker == 0xD9:
            return image
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 64 * (1 + (body[0] >> 4))
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide > 64 else np.uint8).astype(np.int32)
                body = body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                key = body[1:n]
                if key not in _tables:
                    if len(_tables) > 64:
                        _tables.clear()
                    _tables[key] = Huffman(key[:16], key[16:])
                tables[body[0]] = _tables[key]
                body = body[n:]
        elif marker == 0xC2:
            _start(body, image)
        elif marker in (0xC0, 0xC1, 0xC3, 0xDD) and any(body):
            raise ValueError("not a progressive Huffman JPEG without restarts")
        elif marker == 0xDA:
            n = body[0]
            names, (first, last, approximation) = body[1 : 1 + 2 * n : 2], body[1 + 2 * n : 4 + 2 * n]
            end = at
            while (end := data.index(b"\xff", end)) >= 0 and data[end + 1] == 0:
                end += 2
            scan = data[at:end].replace(b"\xff\x00", b"\xff")
            at, high, low = end, approximation >> 4, approximation & 15
            parts, selectors = [image.components[c] for c in names], body[2 : 2 + 2 * n : 2]
            if first == 0:
                _dc_scan(parts, [] if high else [tables[s >> 4] for s in selectors], high, low, scan)
            else:
                c = parts[0]
                rows = _seen_blocks(c.seen, c.across, len(c.coefficients))
                (_ac_refine if high else _ac_first)(c.coefficients, rows, tables[0x10 | selectors[0] & 15], first, last, low, scan, fast)


def _inverse() -> np.ndarray:
    """The 8 x 8 inverse cosine transform of zigzag coefficients, in units of 2**-26 and whole numbers."""
    u, x = np.mgrid[0:8, 0:8]
    one = np.rint(8192 * np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16))
    return np.kron(one, one)[ZIGZAG]


INVERSE = _inverse()


def samples(c: Component, quant: np.ndarray) -> np.ndarray:
    """A component's samples. All sums are whole numbers below 2**53, so every machine gets the same."""
    out = np.empty((len(c.coefficients), 64), np.uint8)
    for k in range(0, len(out), 4096):
        exact = (c.coefficients[k : k + 4096] * quant).astype(float) @ INVERSE
        out[k : k + 4096] = np.clip(np.floor(exact / (1 << 26) + 0.5) + 128, 0, 255)
    return out.reshape(-1, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.across)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution picture, height x width x 3."""
    parts = list(image.components.values())
    h, v = max(c.h for c in parts), max(c.v for c in parts)
    planes = []
    for c in parts:
        plane = samples(c, image.quant[c.quant])
        if v > c.v:
            plane = np.repeat(plane, v // c.v, axis=0)
        if h > c.h:
            plane = np.repeat(plane, h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half = 1 << 15
    out = np.empty((*y.shape, 3), np.uint8)
    np.clip(y + ((91881 * cr + half) >> 16), 0, 255, out=out[:, :, 0], casting="unsafe")
    np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255, out=out[:, :, 1], casting="unsafe")
    np.clip(y + ((116130 * cb + half) >> 16), 0, 255, out=out[:, :, 2], casting="unsafe")
    return out


def payload(image: Image) -> tuple[bytes, int]:
    """The stored payload, and its length before padding."""
    unpadded, length = map(int, image.comment[len(COMMENT) :].split())
    values = np.concatenate([c.coefficients for c in image.components.values()])
    body = np.where(values > 0, values, values + 255).astype(np.uint8)
    return body.tobytes()[:length], unpadded


# ---------------------------------------------------------------- columns


def store(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, media): each text in UTF-8, padded, as a progressive JPEG. Null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            bodies = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(pad(b), len(b)) for b in bodies], pa.binary())], ["doc_id", "media"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary")


def tensors(stored: DataFrame, media: str = "media") -> DataFrame:
    """``stored`` without the media, with height, width and pixels (uint8, row by row, RGB)."""
    kept = [f for f in stored.schema.fields if f.name != media]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, media, 1 << 20):
            pictures = [rgb(decode(m)) for m in batch.column(media).to_pylist()]
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([len(p) for p in pictures], pa.int32()), pa.array([p.shape[1] for p in pictures], pa.int32()), pa.array([p.tobytes() for p in pictures], pa.binary())],
                [*[f.name for f in kept], "height", "width", "pixels"],
            )

    return stored.mapInArrow(compute, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "height int, width int, pixels binary"]))


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, FEATURES), one for each document.

    The media column is written to the shared folder and everything is computed from the table that is read back. The
    feature holds the picture's size, the CRC-32 of its tensor and its mean red, green and blue. Null texts count
    as empty, texts are stored whole, however long, equal texts have equal values, other columns, whatever their names,
    are left out, and an empty table gives an empty one.
    """
    media = shared.stored(store(documents, doc_id, text), compression="zstd")

    def read(stored_bytes: bytes) -> tuple:
        image = decode(stored_bytes)
        body, unpadded = payload(image)
        picture = rgb(image)
        mean = picture.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (image.height * image.width)
        feature = f"{image.height}x{image.width}:{zlib.crc32(picture.tobytes()):08x}:" + ",".join(map(str, mean.tolist()))
        return unpadded, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(stored_bytes), hashlib.sha256(stored_bytes).hexdigest(), feature

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            columns = zip(*map(read, batch.column("media").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *[f.split()[0] for f in FEATURES.split(", ")]])

    return media.mapInArrow(compute, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {FEATURES}")
