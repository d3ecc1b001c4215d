"""A repository's objects straight from its packs, and its history as joins of commits, trees and blobs.

A pack's index lists its objects by name; each task takes a range of that list, reads its objects and, where one is kept as a
difference, follows the chain down to a whole object. Loose objects are dealt out by the first byte of their name. No git process
runs, and nothing is listed on the driver but the packs. Trees are joined to their folders' trees level by level, so a history costs as
many joins as its deepest path has folders, and a tree that many commits share is followed once.
"""

from __future__ import annotations

import bisect
import mmap
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trawl.functions.text import is_binary
from trawl.plans.store import shared_folder, stored

SCHEMA = "oid string, kind string, content binary, size long, left_out string"
MOST, BATCH = 20 << 20, 8 << 20
#: Objects of a pack that a task reads; bytes of whole objects that it keeps for the differences to come.
RANGE, KEPT = 20_000, 64 << 20
# Kinds of objects by their number in a pack.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET, REFERENCE = 6, 7


def changed(base: bytes, delta: bytes) -> bytes:
    """An object from its base and the difference: copies of parts of the base, and new bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    if number() != len(base):
        raise ValueError("a difference does not fit its base")
    size, out = number(), []
    while at < len(delta):
        what = delta[at]
        at += 1
        if what < 128:
            out.append(delta[at : at + what])
            at += what
            continue
        start = length = 0
        for bit in range(7):
            if what & (1 << bit):
                if bit < 4:
                    start |= delta[at] << (8 * bit)
                else:
                    length |= delta[at] << (8 * (bit - 4))
                at += 1
        out.append(base[start : start + (length or 1 << 16)])
    found = b"".join(out)
    if len(found) != size:
        raise ValueError("a difference does not give the size that it says")
    return found


class Pack:
    """One pack and its index (version 2)."""

    def __init__(self, path: str):
        with open(f"{path}.idx", "rb") as file:
            self.index = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        with open(f"{path}.pack", "rb") as file:
            self.data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.index[:8] != b"\xfftOc\0\0\0\x02":
            raise ValueError(f"{path}.idx: only indexes of version 2 are read")
        self.fanout = struct.unpack(">256I", self.index[8 : 8 + 1024])
        self.count = self.fanout[-1]
        self.names, self.crcs = 8 + 1024, 8 + 1024 + 20 * self.count
        self.offsets = self.crcs + 4 * self.count
        self.large = self.offsets + 4 * self.count

    def name(self, k: int) -> bytes:
        return self.index[self.names + 20 * k : self.names + 20 * k + 20]

    def offset(self, k: int) -> int:
        (at,) = struct.unpack_from(">I", self.index, self.offsets + 4 * k)
        if at >> 31:
            (at,) = struct.unpack_from(">Q", self.index, self.large + 8 * (at & 0x7FFFFFFF))
        return at

    def find(self, oid: bytes) -> int | None:
        """Where an object begins: a binary search among the names with its first byte."""
        low = self.fanout[oid[0] - 1] if oid[0] else 0
        k = bisect.bisect_left(range(self.fanout[oid[0]]), oid, low, key=self.name)
        return self.offset(k) if k < self.fanout[oid[0]] and self.name(k) == oid else None

    def head(self, at: int) -> tuple[int, int, int | bytes | None, int]:
        """(kind, size, base, where the compressed bytes begin) of the entry at an offset."""
        byte = self.data[at]
        kind, size, shift, here = byte >> 4 & 7, byte & 15, 4, at + 1
        while byte & 128:
            byte = self.data[here]
            size |= (byte & 127) << shift
            shift += 7
            here += 1
        base: int | bytes | None = None
        if kind == OFFSET:
            byte = self.data[here]
            back, here = byte & 127, here + 1
            while byte & 128:
                byte = self.data[here]
                back, here = (back + 1) << 7 | byte & 127, here + 1
            base = at - back
        elif kind == REFERENCE:
            base, here = self.data[here : here + 20], here + 20
        return kind, size, base, here

    def inflated(self, at: int, size: int) -> bytes:
        found = zlib.decompressobj()
        body, here = b"", at
        parts = []
        left = size
        while left > 0 or not found.eof:
            body = found.decompress(self.data[here : here + (1 << 16)], max(left, 1))
            if not body and here >= len(self.data):
                raise ValueError("an entry ends early")
            parts.append(body)
            left -= len(body)
            while found.unconsumed_tail and not found.eof and left > 0:
                more = found.decompress(found.unconsumed_tail, left)
                parts.append(more)
                left -= len(more)
            here += 1 << 16
            if found.eof or left <= 0:
                break
        return b"".join(parts)


class Objects:
    """All objects of a repository by name; whole ones are kept while they are likely bases of the next."""

    def __init__(self, root: str):
        self.root = root
        folder = os.path.join(root, "pack")
        names = sorted(n[:-4] for n in os.listdir(folder) if n.endswith(".idx")) if os.path.isdir(folder) else []
        self.packs = {n: Pack(os.path.join(folder, n)) for n in names}
        self.kept: OrderedDict[tuple[str, int], tuple[str, bytes]] = OrderedDict()
        self.held = 0

    def at(self, pack: str, offset: int) -> tuple[str, bytes]:
        """(kind, content) of an entry: the chain of differences is gone down to a whole object, then up again."""
        chain: list[tuple[int, bytes]] = []
        while True:
            if (found := self.kept.get((pack, offset))) is not None:
                self.kept.move_to_end((pack, offset))
                break
            own = self.packs[pack]
            kind, size, base, start = own.head(offset)
            body = own.inflated(start, size)
            if kind in KINDS:
                found = KINDS[kind], body
                self._keep((pack, offset), found)
                break
            chain.append((offset, body))
            if isinstance(base, bytes):  # in the same pack, unless it is a thin one
                offset = own.find(base)
                if offset is None:
                    found = self.get(base)
                    break
            else:
                offset = base
        for at, delta in reversed(chain):
            found = found[0], changed(found[1], delta)
            self._keep((pack, at), found)
        return found

    def _keep(self, key: tuple[str, int], found: tuple[str, bytes]) -> None:
        self.kept[key] = found
        self.held += len(found[1])
        while self.held > KEPT and len(self.kept) > 1:
            self.held -= len(self.kept.popitem(last=False)[1][1])

    def get(self, oid: bytes) -> tuple[str, bytes]:
        for name, pack in self.packs.items():
            if (at := pack.find(oid)) is not None:
                return self.at(name, at)
        return self.loose(oid.hex())

    def loose(self, oid: str) -> tuple[str, bytes]:
        with open(os.path.join(self.root, oid[:2], oid[2:]), "rb") as file:
            head, _, body = zlib.decompress(file.read()).partition(b"\0")
        return head.split()[0].decode(), body


@dataclass
class Range(InputPartition):
    """Objects start to before end of a pack's index; or the loose ones whose name begins with ``pack`` (two digits)."""

    pack: str
    start: int
    end: int

    def __init__(self, pack: str, start: int, end: int):
        super().__init__(None)
        self.pack, self.start, self.end = pack, start, end


def objects_folder(repository: str) -> str:
    """Where a working tree, a bare repository or a linked one keeps its objects."""
    root = repository.removeprefix("file://")
    own = os.path.join(root, ".git")
    if os.path.isfile(own):  # a linked working tree or a submodule
        with open(own) as file:
            own = os.path.join(root, file.read().split(":", 1)[1].strip())
    git = own if os.path.isdir(own) else root
    common = os.path.join(git, "commondir")
    if os.path.isfile(common):
        with open(common) as file:
            git = os.path.join(git, file.read().strip())
    return os.path.join(git, "objects")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.most, self.kinds = objects_folder(options["path"]), int(options.get("most", MOST)), set(filter(None, options.get("kinds", "").split(",")))
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        found = []
        folder = os.path.join(self.root, "pack")
        for name in sorted(n[:-4] for n in os.listdir(folder) if n.endswith(".idx")) if os.path.isdir(folder) else ():
            count = Pack(os.path.join(folder, name)).count
            found += [Range(name, k, min(k + self.range, count)) for k in range(0, count, self.range)]
        found += [Range(n, 0, 0) for n in sorted(os.listdir(self.root)) if len(n) == 2]
        return found or [Range("", 0, 0)]

    def _found(self, partition: Range) -> Iterator[tuple[str, str, bytes]]:
        objects = Objects(self.root)
        if not partition.pack:
            return
        if len(partition.pack) == 2:
            for rest in sorted(os.listdir(os.path.join(self.root, partition.pack))):
                if len(rest) == 38:
                    yield partition.pack + rest, *objects.loose(partition.pack + rest)
            return
        own = objects.packs[partition.pack]
        # In the order of the pack, where an object's base lies near.
        for k in sorted(range(partition.start, partition.end), key=own.offset):
            yield own.name(k).hex(), *objects.at(partition.pack, own.offset(k))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for oid, kind, body in self._found(partition):
            if self.kinds and kind not in self.kinds:
                continue
            large = kind == "blob" and len(body) > self.most
            rows.append((oid, kind, None if large else body, len(body), "too large" if large else None))
            held += 100 if large else len(body) + 100
            if held > BATCH:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class Repository(DataSource):
    """Options: path (the repository, which all tasks can read); kinds (comma-separated; all by default); most (bytes of a blob); range."""

    @classmethod
    def name(cls) -> str:
        return "trawl_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def objects(spark: SparkSession, repository: str, kinds: str = "", most: int = MOST, size: int = RANGE) -> DataFrame:
    """Every object of a repository (oid, kind, content, size, left_out); one that several packs hold has several rows."""
    spark.dataSource.register(Repository)
    return spark.read.format("trawl_git").option("kinds", kinds).option("most", most).option("range", size).load(repository)


def commits(found: DataFrame) -> DataFrame:
    """(commit, tree, parents, author, email, committed, message) of commit objects."""
    text = F.decode("content", "utf-8")
    head, body = F.substring_index(text, "\n\n", 1), F.regexp_extract(text, r"(?s)\A.*?\n\n(.*)\z", 1)
    who = r"(?m)^author (.*?) ?<([^>]*)>"
    at = F.regexp_extract(head, r"(?m)^committer .*> (\d+) [+-]\d{4}$", 1)
    return found.filter("kind = 'commit'").select(
        F.col("oid").alias("commit"), F.regexp_extract(head, r"(?m)^tree (\w+)$", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent (\w+)$"), 1).alias("parents"),
        F.regexp_extract(head, who, 1).alias("author"), F.regexp_extract(head, who, 2).alias("email"), F.timestamp_seconds(F.nullif(at, F.lit("")).cast("long")).alias("committed"),
        F.substring_index(F.regexp_replace(body, r"\A\n+", ""), "\n", 1).alias("message"),
    )


def entries(found: DataFrame) -> DataFrame:
    """(tree, mode, name, oid) of tree objects."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for oid, body in zip(frame["oid"], frame["content"], strict=True):
                at, data = 0, bytes(body)
                while at < len(data):
                    end = data.index(b"\0", at)
                    mode, _, name = data[at:end].partition(b" ")
                    rows.append((oid, mode.decode(), name.decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pd.DataFrame(rows, columns=["tree", "mode", "name", "oid"])

    return found.filter("kind = 'tree'").select("oid", "content").mapInPandas(run, "tree string, mode string, name string, oid string")


def history(spark: SparkSession, repository: str, most: int = MOST, size: int = RANGE) -> DataFrame:
    """Every text blob that a commit holds, once, with its path in the first such commit, and that commit (by time, then name).

    Columns: blob_id, path, content, size, commit, author, email, committed, message. Commits no branch reaches any more count
    as long as the repository holds them. Blobs of more than ``most`` bytes and binary ones are left out.
    """
    folder = shared_folder(spark)
    meta = objects(spark, repository, "commit,tree", most, size)
    made = stored(commits(meta).dropDuplicates(["commit"]), f"{folder}/commits")
    trees = stored(entries(meta).dropDuplicates(["tree", "name"]), f"{folder}/trees")
    first = F.min(F.struct("committed", "commit")).alias("first")
    level = made.groupBy("tree").agg(first).withColumn("path", F.lit(""))
    blobs: DataFrame | None = None
    depth = 0
    while True:
        below = level.join(trees, "tree").withColumn("path", F.concat("path", "name"))
        # Of a tree's many places only the first commit of each is followed.
        found = stored(below.groupBy("oid", "mode", "path").agg(F.min("first").alias("first")), f"{folder}/level-{depth}")
        own = found.filter("mode like '100%'").select("oid", "path", "first")
        blobs = own if blobs is None else blobs.unionByName(own)
        level = found.filter("mode in ('40000', '040000')").select(F.col("oid").alias("tree"), F.concat("path", F.lit("/")).alias("path"), "first")
        if level.isEmpty():
            break
        depth += 1
    placed = blobs.groupBy("oid").agg(F.min(F.struct("first", "path")).alias("p")).select("oid", "p.path", "p.first.commit")
    bodies = objects(spark, repository, "blob", most, size).filter("left_out is null").dropDuplicates(["oid"])
    bodies = bodies.filter(~is_binary(F.col("content")))
    found = bodies.select("oid", "content", "size").join(placed, "oid").join(made.drop("tree", "parents"), "commit")
    return found.select(F.col("oid").alias("blob_id"), "path", "content", "size", "commit", "author", "email", "committed", "message")
