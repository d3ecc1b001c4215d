"""Folders as a Spark data source: every file that a scan wants, hidden ones too if asked for, listed by the executors.

``spark.read.format("trawl_folder").option("hidden", "true").load("/srv/code")`` after ``register(spark)``. Spark's own file
sources list on the driver and never show names that begin with a dot or an underscore, ``.env`` among them.

The driver looks at no more than LOOK entries, from the top, to find folders to deal out; what lies below them is walked by the
tasks. Where there are fewer folders than partitions (one flat folder, say), several tasks walk the same one and each reads
the files whose names hash to its own share.
"""

from __future__ import annotations

import hashlib
import os
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, LessThanOrEqual, StringStartsWith

from trawl.functions.memory import give_back
from trawl.sources import extract, ignore

SCHEMA = "blob_id string, path string, member string, content binary, size long, left_out string"
LOOK, MOST, BATCH = 2000, 20 << 20, 4 << 20


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str  # folder, file, link (to a file) or other
    size: int


class Local:
    """A folder of the machine, or one that all machines mount."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            for e in found:
                try:
                    info = e.stat(follow_symlinks=e.is_symlink())
                except OSError:  # a link to nothing
                    yield Entry(e.name, "other", 0)
                    continue
                file = stat.S_ISREG(info.st_mode)
                yield Entry(e.name, "link" if e.is_symlink() and file else "file" if file else "folder" if e.is_dir(follow_symlinks=False) else "other", info.st_size)

    def read(self, path: str, most: int) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            # Room is made for what is asked for: by the file's size, not the most that it may have.
            body = file.read(min(most, (size := os.fstat(file.fileno()).st_size) + 1))
            return body if len(body) <= size else body + file.read(most - len(body))  # it has grown, or tells no size


class Remote:
    """A folder of a store that Arrow knows: s3, gs, hdfs and others."""

    def __init__(self, uri: str):
        self.store, self.root = arrow_fs.FileSystem.from_uri(uri)

    def entries(self, folder: str) -> Iterator[Entry]:
        for e in self.store.get_file_info(arrow_fs.FileSelector(f"{self.root}/{folder}".rstrip("/"))):
            yield Entry(e.base_name, {arrow_fs.FileType.Directory: "folder", arrow_fs.FileType.File: "file"}.get(e.type, "other"), e.size or 0)

    def read(self, path: str, most: int) -> bytes:
        with self.store.open_input_stream(f"{self.root}/{path}") as file:
            return file.read(most)


def opened(root: str) -> Local | Remote:
    scheme, _, rest = root.rpartition("://")
    return Local(rest or "/") if scheme in ("", "file") else Remote(root)


@dataclass
class Share(InputPartition):
    """Folders to walk (relative; with what lies below, or only the files right in them) and the share of their files to read."""

    folders: list[tuple[str, bool]]
    share: int
    shares: int

    def __init__(self, folders: list[tuple[str, bool]], share: int, shares: int):
        super().__init__(None)
        self.folders, self.share, self.shares = folders, share, shares


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.root = options["path"].rstrip("/") or "/"
        self.hidden, self.links, self.ignore = flag("hidden", False), flag("symlinks", False), flag("gitignore", True)
        self.binary, self.extract, self.report = flag("binary", False), flag("extract", False), flag("report", False)
        self.most, self.parts = int(options.get("most", MOST)), int(options.get("partitions", 64))
        self.prefix, self.largest = "", None

    def pushFilters(self, filters):  # noqa: N802
        """Beginnings of paths and greatest sizes keep files closed; Spark applies them again."""
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and tuple(f.attribute) == ("path",) and isinstance(f.value, str):
                self.prefix = max(self.prefix, f.value, key=len)
            elif isinstance(f, LessThanOrEqual) and tuple(f.attribute) == ("size",) and not self.extract:
                self.largest = f.value if self.largest is None else min(self.largest, f.value)
            yield f

    def _rules(self, store: Local | Remote, folder: str) -> list[ignore.Rule]:
        """Of one folder's ignore file, if it has one."""
        try:
            return ignore.parse(store.read(f"{folder}.gitignore", MOST).decode("utf-8", "replace"), folder) if self.ignore else []
        except (OSError, FileNotFoundError):
            return []

    def _above(self, store: Local | Remote, folder: str) -> list[ignore.Rule]:
        """Of the folders above one, from the root."""
        parts = folder.split("/")[:-1]
        return [r for k in range(len(parts)) for r in self._rules(store, "".join(f"{p}/" for p in parts[:k]))]

    def _enters(self, path: str, name: str, rules: list[ignore.Rule]) -> bool:
        return (self.hidden or not name.startswith(".")) and not ignore.is_ignored(path, True, rules)

    def partitions(self) -> list[Share]:
        store, seen, done = opened(self.root), 0, []
        todo: list[tuple[str, list[ignore.Rule]]] = [("", [])]
        while todo and len(todo) + len(done) < self.parts and seen < LOOK:
            folder, above = todo.pop(0)
            rules, below, whole = [*above, *self._rules(store, folder)], [], True
            for e in store.entries(folder):
                seen += 1
                if seen >= LOOK:
                    whole = False
                    break
                if e.kind == "folder" and self._enters(f"{folder}{e.name}", e.name, rules):
                    below.append((f"{folder}{e.name}/", rules))
            if not whole:  # too many entries to look at here: its tasks list it
                todo.insert(0, (folder, above))
                break
            done.append((folder, False))
            todo += below
        units = [*((f, True) for f, _ in todo), *done]
        shares = max(1, -(-self.parts // len(units)))
        return [Share([u], k, shares) for u in sorted(units) for k in range(shares)]

    def _walk(self, store: Local | Remote, folder: str, below: bool, rules: list[ignore.Rule]) -> Iterator[tuple[str, int, str | None]]:
        """(path, size, why it is left out) of files, folder by folder."""
        todo = [(folder, rules)]
        while todo:
            here, above = todo.pop()
            own = [*above, *self._rules(store, here)]
            for e in store.entries(here):
                path = f"{here}{e.name}"
                if e.kind == "folder":
                    if below and self._enters(path, e.name, own):
                        todo.append((f"{path}/", own))
                elif e.kind in ("file", "link"):
                    why = "link" if e.kind == "link" and not self.links else "hidden" if e.name.startswith(".") and not self.hidden else "too large" if e.size > self.most else "ignored" if ignore.is_ignored(path, False, own) else None
                    yield path, e.size, why

    def _rows(self, store: Local | Remote, path: str, size: int) -> Iterator[tuple]:
        try:
            body = store.read(path, self.most + 1)
        except OSError:
            yield None, path, None, None, size, "unreadable"
            return
        row = lambda member, content: (hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest(), path, member, content, len(content), None)
        if len(body) > self.most:
            yield None, path, None, None, size, "too large"
        elif b"\0" not in body[:8192] or self.binary:
            yield row(None, body)
        elif self.extract and extract.extractable(path):
            out: list[tuple[str, str]] = []
            for member, content in extract.members(path, body, 1, None, out):
                yield row(member, content)
            yield from ((None, path, member, None, None, why) for member, why in out)
        else:
            yield None, path, None, None, size, "binary"

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store = opened(self.root)
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for folder, below in partition.folders:
            for path, size, why in self._walk(store, folder, below, self._above(store, folder)):
                if zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.shares != partition.share or not path.startswith(self.prefix):
                    continue
                if self.largest is not None and size > self.largest:
                    continue
                for row in [(None, path, None, None, size, why)] if why else self._rows(store, path, size):
                    if row[5] is None or self.report:
                        rows.append(row)
                        held += len(row[3] or b"") + 100
                if held > BATCH:
                    full, rows, held = batch(), [], 0
                    yield full
                    del full
                    give_back()
        if rows:
            full, rows = batch(), []
            yield full
            del full
        give_back()


class Folder(DataSource):
    """Options: path; hidden, symlinks, gitignore (default true, nested files too), binary, extract, report; most (bytes); partitions.

    Links to folders are never entered. With ``report``, what is left out has a row without content that says why in ``left_out``.
    """

    @classmethod
    def name(cls) -> str:
        return "trawl_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which then pushes filters into sources like it."""
    spark.dataSource.register(Folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files below ``root`` (a path, or a file, s3, gs or hdfs address), see ``Folder``; a single file stands for itself."""
    register(spark)
    plain = root.removeprefix("file://")
    if "://" not in plain and os.path.isfile(plain):
        return read(spark, os.path.dirname(os.path.abspath(plain)), **{**options, "hidden": True, "gitignore": False}).filter(F.col("path") == os.path.basename(plain))
    reader = spark.read.format("trawl_folder")
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(root)
