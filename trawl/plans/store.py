"""Tables of a scan, kept as Parquet: blobs, provenance, matches, findings, annotations; and incremental runs."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.findings import annotate, unseen

#: The key of each table: of rows with equal keys the first written stays.
KEYS = {"blobs": ["blob_id"], "contents": ["blob_id"], "reviews": ["chunk_id"], "provenance": ["blob_id", "path"], "matches": ["structural_id"], "findings": ["finding_id"], "annotations": ["target_type", "target_id"]}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or (on one machine) a temporary one where that is unset; deleted at the end."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/trawl-store-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and the folder may be gone
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written and read again."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a filter for each key, and how many of them a key sets: about one key in a hundred is taken for another.
BITS, HASHES = 10, 7


def _places(keys: list[str], size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits."""
    halves = np.array([(h & (2**64 - 1), h >> 64 | 1) for h in map(xxhash.xxh3_128_intdigest, keys)], np.uint64).reshape(-1, 2)
    return (halves[:, :1] + halves[:, 1:] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bits) of each part of a run, from rows (part, key) sorted by part."""
    now, held = None, []

    def made() -> pa.RecordBatch:
        size = max(64, BITS * len(held)) + 7 & ~7
        bits = np.zeros(size, bool)
        bits[_places(held, size).ravel().astype(np.int64)] = True
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    for batch in batches:
        for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if part != now and held:
                yield made()
                held = []
            now = part
            held.append(key)
    if held:
        yield made()


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, part) of the filters that may hold the key beside them, from rows (run, part, bits, keys)."""
    for batch in batches:
        found = []
        for run, part, bits, keys in zip(*(batch.column(c).to_pylist() for c in ("run", "part", "bits", "keys")), strict=True):
            filled = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            if filled[_places(keys, len(filled)).astype(np.int64)].all(axis=1).any():
                found.append((run, part))
        if found:
            runs, parts = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(parts)], ["run", "part"])


class Store:
    """A folder of tables, each a list of immutable runs that versioned manifests name.

    The rows of a run lie in parts by the first ``digits`` digits of their key's id, and each part has a Bloom filter beside
    the run. A lookup tries its keys on the filters and opens only the parts that may hold one of them: for new keys about
    one in a hundred times the keys, not the table. ``digits`` should grow with the table: a part's keys, a few million at
    most, meet in one task when its filter is made.

    A run is written first; a manifest that names it as well is then written under a temporary name and renamed to the
    next number, which fails if another writer was first. That writer's rows are then looked at too and the rest is
    committed on top. Readers see the runs of one version; nothing is overwritten.
    """

    def __init__(self, spark: SparkSession, root: str, digits: int = 1):
        self.spark, self.root, self.digits = spark, root.rstrip("/"), digits
        #: The parts (table, run, part) that the last lookup opened, and how many there were.
        self.opened: list[tuple[str, str, str]] = []
        self.parts = 0

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _latest(self, name: str) -> tuple[int, list[str]]:
        """The number of the last version, and its runs."""
        fs, where = self._path(f"{self.root}/{name}/manifests")
        if not fs.exists(where):
            return 0, []
        numbers = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.root}/{name}/manifests/{numbers[-1]}", wholetext=True).first()[0]
        return int(numbers[-1].split(".")[0]), json.loads(text)

    def _commit(self, name: str, version: int, runs: list[str]) -> bool:
        """Makes a version; False if another writer has made it."""
        jvm = self.spark.sparkContext._jvm
        fs, target = self._path(f"{self.root}/{name}/manifests/{version:010d}.json")
        _, temporary = self._path(f"{self.root}/{name}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary)
        try:
            out.write(bytearray(json.dumps(runs).encode()))
        finally:
            out.close()
        if fs.exists(target):
            return False
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, target, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def table(self, name: str, like: DataFrame | None = None, runs: list[str] | None = None) -> DataFrame | None:
        runs = self._latest(name)[1] if runs is None else runs
        if runs:
            return self.spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.root}/{name}/runs/{r}" for r in runs])
        return None if like is None else self.spark.createDataFrame([], like.schema)

    def _write(self, name: str, rows: DataFrame) -> str:
        run = uuid.uuid4().hex
        if name == "annotations":  # few, and written anew as a whole
            rows.write.parquet(f"{self.root}/{name}/runs/{run}")
            return run
        if rows.isEmpty():  # a part without rows keeps the columns
            rows.limit(0).write.parquet(f"{self.root}/{name}/runs/{run}/_part=-")
            self.spark.createDataFrame([], "part string, bits binary, run string").write.parquet(f"{self.root}/{name}/filters/{run}")
            return run
        key = KEYS[name][0]
        dealt = rows.withColumn("_part", F.substring(key, 1, self.digits)).repartition("_part").sortWithinPartitions("_part")
        dealt.write.partitionBy("_part").parquet(f"{self.root}/{name}/runs/{run}")
        keys = rows.select(F.substring(key, 1, self.digits).alias("part"), F.col(key).alias("key")).distinct().repartition("part").sortWithinPartitions("part")
        keys.mapInArrow(_filters, "part string, bits binary").withColumn("run", F.lit(run)).write.parquet(f"{self.root}/{name}/filters/{run}")
        return run

    def lookup(self, name: str, keys: DataFrame, runs: list[str]) -> DataFrame | None:
        """The rows of the parts of ``runs`` that may hold one of ``keys`` (their column named as the table's key); None if no part may."""
        key = KEYS[name][0]
        asked = keys.select(F.substring(key, 1, self.digits).alias("part"), F.col(key).alias("key")).distinct()
        # About a thousand keys at a time meet a filter, so no task holds all that are asked for.
        slices = max(1, asked.count() // (1000 * 16**self.digits))
        groups = asked.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices))).groupBy("part", "slice").agg(F.collect_list("key").alias("keys"))
        filters = self.spark.read.schema("part string, bits binary, run string").parquet(*[f"{self.root}/{name}/filters/{r}" for r in runs])
        met = groups.join(filters, "part").select("run", "part", "bits", "keys").mapInArrow(_hits, "run string, part string").distinct()
        self.parts = filters.count()
        self.opened = sorted((name, r["run"], r["part"]) for r in met.collect())  # at most a row for each part of each run
        if not self.opened:
            return None
        return self.spark.read.parquet(*[f"{self.root}/{name}/runs/{run}/_part={part}" for _, run, part in self.opened])

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends the rows whose keys the table does not hold, one for each key, in one version."""
        key, added = KEYS[name], []
        fresh = stored(rows.dropDuplicates(key))
        seen: list[str] = []
        while True:
            version, runs = self._latest(name)
            met = [r for r in runs if r not in seen]
            if met and (held := self.lookup(name, fresh, met)) is not None:
                fresh = fresh.join(held.select(*key), key, "left_anti")
            if met or not added:  # else what is written still holds
                added = [self._write(name, fresh)]
            seen = runs
            if self._commit(name, version + 1, [*runs, *added]):
                return

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """Blobs that no run has recorded."""
        runs = self._latest("blobs")[1]
        held = self.lookup("blobs", blobs, runs) if runs else None
        return blobs if held is None else unseen(blobs, held)

    def annotate(self, changes: DataFrame) -> None:
        """Sets annotations (target_type, target_id, status, comment, at); later ones replace earlier ones, in one version."""
        while True:
            version, runs = self._latest("annotations")
            held = self.table("annotations", changes, runs)
            if self._commit("annotations", version + 1, [self._write("annotations", annotate(held, changes))]):
                return


def scan(store: Store, blobs: DataFrame, rules, incremental: bool = True, context: int = 2) -> DataFrame:
    """Scans blobs (blob_id, path, text) the whole way, records everything in the store, and returns the new matches."""
    from trawl.operators import scan as whole

    new = store.unseen(blobs) if incremental else blobs
    new = new.dropDuplicates(["blob_id"])
    matches = stored(whole.scan(new.select("blob_id", "text"), rules, context=context))
    store.add("matches", matches)
    store.add("findings", matches.select("finding_id", "rule_id", "rule_name", "groups"))
    store.add("provenance", blobs.select("blob_id", "path"))
    store.add("blobs", new.select("blob_id", F.octet_length("text").cast("long").alias("size")))  # last: a lost run is scanned again
    return matches


def keep_contents(blobs: DataFrame, folder: str) -> None:
    """Adds blobs (blob_id, content) to those kept in a folder, once each, in one version."""
    Store(blobs.sparkSession, folder, digits=2).add("contents", blobs.select("blob_id", "content"))


def contents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The kept contents of the ids in ``wanted`` (blob_id), one row each; only parts that may hold one are read."""
    store = Store(spark, folder, digits=2)
    runs = store._latest("contents")[1]
    held = store.lookup("contents", wanted, runs) if runs else None
    if held is None:
        return spark.createDataFrame([], "blob_id string, content string") if not runs else store.table("contents", runs=runs).limit(0)
    return held.join(wanted.select("blob_id").distinct(), "blob_id", "left_semi").select("blob_id", "content")
