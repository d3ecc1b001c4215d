"""Members of 7z archives: the header names folders (chains of coders over packed streams), and each folder unpacks into its members."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of the format.
SIGNATURE = b"7z\xbc\xaf\x27\x1c"
END, HEADER, STREAMS, FILES, PACKED, UNPACKED, SUBSTREAMS, SIZE, CRC, FOLDER, UNPACK_SIZE, COUNT, EMPTY_STREAM, NAMES, ENCODED = 0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 23
COPY, LZMA2, LZMA1, DELTA, X86, DEFLATE, BZIP2 = b"\x00", b"\x21", b"\x03\x01\x01", b"\x03", b"\x03\x03\x01\x03", b"\x04\x01\x08", b"\x04\x02\x02"


class Unreadable(ValueError):
    """A method that is not read here, or a damaged archive."""


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes, int]]  # method, properties, inputs
    binds: dict[int, int]  # an input, and the coder whose output it is
    packed: list[int]  # inputs that are packed streams
    sizes: list[int] = field(default_factory=list)
    crc: int | None = None
    members: list[tuple[int, int | None]] = field(default_factory=list)  # size, CRC

    @property
    def size(self) -> int:
        return self.sizes[next(k for k in range(len(self.coders)) if k not in self.binds.values())]


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        found = self.data[self.at : self.at + n]
        if len(found) != n or n < 0:
            raise Unreadable("the header ends early")
        self.at += n
        return found

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """A number whose first byte says in its leading ones how many bytes follow."""
        first = self.byte()
        more = next((k for k in range(8) if not first & 128 >> k), 8)
        return int.from_bytes(self.take(more), "little") | (first & (127 >> more)) << 8 * more if more < 8 else int.from_bytes(self.take(8), "little")

    def bits(self, n: int) -> list[bool]:
        data = self.take(-(-n // 8))
        return [bool(data[k // 8] & 128 >> k % 8) for k in range(n)]

    def crcs(self, n: int) -> list[int | None]:
        known = [True] * n if self.byte() else self.bits(n)
        return [struct.unpack("<I", self.take(4))[0] if k else None for k in known]


def _folder(c: _Cursor) -> Folder:
    coders, inputs, outputs = [], 0, 0
    for _ in range(c.number()):
        flags = c.byte()
        method = c.take(flags & 15)
        n_in, n_out = (c.number(), c.number()) if flags & 16 else (1, 1)
        if n_out != 1:
            raise Unreadable("a coder with several outputs")
        coders.append((method, c.take(c.number()) if flags & 32 else b"", n_in))
        inputs, outputs = inputs + n_in, outputs + 1
    binds = {c.number(): c.number() for _ in range(outputs - 1)}
    free = [k for k in range(inputs) if k not in binds]
    return Folder(coders, binds, [c.number() for _ in free] if len(free) > 1 else free)


def _streams(c: _Cursor) -> tuple[int, list[int], list[Folder]]:
    """(where the packed streams begin, their sizes, the folders)."""
    start, packed, folders = 0, [], []
    while (what := c.byte()) != END:
        if what == PACKED:
            start, n = c.number(), c.number()
            while (part := c.byte()) != END:
                if part == SIZE:
                    packed = [c.number() for _ in range(n)]
                elif part == CRC:
                    c.crcs(n)
        elif what == UNPACKED:
            while (part := c.byte()) != END:
                if part == FOLDER:
                    n = c.number()
                    if c.byte():
                        raise Unreadable("folders elsewhere")
                    folders = [_folder(c) for _ in range(n)]
                elif part == UNPACK_SIZE:
                    for f in folders:
                        f.sizes = [c.number() for _ in f.coders]
                elif part == CRC:
                    for f, crc in zip(folders, c.crcs(len(folders)), strict=True):
                        f.crc = crc
        elif what == SUBSTREAMS:
            counts, part = [1] * len(folders), c.byte()
            if part == COUNT:
                counts, part = [c.number() for _ in folders], c.byte()
            sizes = []
            for f, n in zip(folders, counts, strict=True):
                own = [c.number() for _ in range(n - 1)] if part == SIZE else []
                sizes.append([*own, f.size - sum(own)] if n else [])
            part = c.byte() if part == SIZE else part
            unknown = sum(n for f, n in zip(folders, counts, strict=True) if n != 1 or f.crc is None)
            crcs = iter(c.crcs(unknown) if part == CRC else [None] * unknown)
            for f, own in zip(folders, sizes, strict=True):
                f.members = [(n, f.crc if len(own) == 1 and f.crc is not None else next(crcs)) for n in own]
            while part != END:
                part = c.byte()
    for f in folders:
        f.members = f.members or [(f.size, f.crc)]
    return start, packed, folders


def _filter(method: bytes, properties: bytes) -> dict:
    if method == LZMA1:
        first, size = struct.unpack("<BI", properties)
        return {"id": lzma.FILTER_LZMA1, "dict_size": max(size, 4096), "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45}
    if method == LZMA2:
        n = properties[0]
        return {"id": lzma.FILTER_LZMA2, "dict_size": (2 | n & 1) << n // 2 + 11 if n < 40 else 0xFFFFFFFF}
    if method == DELTA:
        return {"id": lzma.FILTER_DELTA, "dist": properties[0] + 1}
    if method == X86:
        return {"id": lzma.FILTER_X86}
    raise Unreadable(f"method {method.hex()}")


def _unpacked(folder: Folder, streams: list[bytes]) -> bytes:
    """A folder's content: from its last coder back to the packed stream, filters and LZMA in one chain."""
    k = next(k for k in range(len(folder.coders)) if k not in folder.binds.values())
    chain, size = [], folder.sizes[k]
    while True:
        method, properties, n_in = folder.coders[k]
        if n_in != 1:
            raise Unreadable(f"method {method.hex()}")
        chain.append((method, properties))
        first = sum(c[2] for c in folder.coders[:k])
        if first not in folder.binds:
            body = streams[folder.packed.index(first)]
            break
        k = folder.binds[first]
    try:
        if chain[-1][0] in (LZMA1, LZMA2):
            found = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[_filter(*c) for c in chain]).decompress(body, size)
        elif len(chain) > 1:
            raise Unreadable(f"method {chain[0][0].hex()} over {chain[1][0].hex()}")
        elif chain[0][0] == COPY:
            found = body[:size]
        elif chain[0][0] == DEFLATE:
            found = zlib.decompressobj(-15).decompress(body, size)
        elif chain[0][0] == BZIP2:
            found = bz2.BZ2Decompressor().decompress(body, size)
        else:
            raise Unreadable(f"method {chain[0][0].hex()}")
    except (lzma.LZMAError, zlib.error, OSError) as e:
        raise Unreadable(f"damaged: {type(e).__name__}") from e
    if len(found) != size:
        raise Unreadable("damaged: a folder ends early")
    return found


def _header(body: bytes, most: int) -> _Cursor | None:
    if body[:6] != SIGNATURE or len(body) < 32:
        raise Unreadable("not a 7z archive")
    offset, size, crc = struct.unpack("<QQI", body[12:32])
    data = body[32 + offset : 32 + offset + size]
    if not size:
        return None
    if zlib.crc32(data) != crc:
        raise Unreadable("damaged: header")
    cursor = _Cursor(data)
    while (what := cursor.byte()) == ENCODED:
        start, packed, folders = _streams(cursor)
        if not folders or folders[0].size > most:
            raise Unreadable("header too large")
        cursor = _Cursor(_unpacked(folders[0], _cut(body, start, packed)))
    if what != HEADER:
        raise Unreadable("damaged: header")
    return cursor


def _cut(body: bytes, start: int, packed: list[int]) -> list[bytes]:
    found, at = [], 32 + start
    for n in packed:
        found.append(body[at : at + n])
        at += n
    return found


def members(body: bytes, member: int, archive: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, why there is none) of the files of an archive; sizes are held by ``member`` and ``archive`` before anything is unpacked."""
    cursor = _header(body, archive)
    if cursor is None:
        return
    start, packed, folders, names, empty = 0, [], [], [], []
    while (what := cursor.byte()) != END:
        if what == STREAMS:
            start, packed, folders = _streams(cursor)
        elif what == FILES:
            n = cursor.number()
            empty = [False] * n
            while (kind := cursor.byte()) != END:
                part = _Cursor(cursor.take(cursor.number()))
                if kind == NAMES and not part.byte():
                    names = part.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
                elif kind == EMPTY_STREAM:
                    empty = part.bits(n)
        else:  # properties of the archive
            while (kind := cursor.byte()) != END:
                cursor.take(cursor.number())
    files = iter([name for name, none in zip(names, empty, strict=False) if not none])
    streams, used = _cut(body, start, packed), 0
    for folder in folders:
        own = streams[used : used + len(folder.packed)]
        used += len(folder.packed)
        content, why = b"", None
        if folder.size > archive:
            why = "too large"
        else:
            archive -= folder.size
            try:
                content = _unpacked(folder, own)
            except Unreadable as e:
                why = str(e)
        at = 0
        for size, crc in folder.members:
            name = next(files, "")
            data, at = content[at : at + size], at + size
            told = why or ("too large" if size > member else "damaged: checksum" if crc is not None and zlib.crc32(data) != crc else None)
            yield name, None if told else data, told
