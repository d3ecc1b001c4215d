"""An append-only table of immutable shards with size-tiered compaction and versioned manifests.

Every arrival is written as one small run of shards. Runs of one size tier are merged, MERGE at a time, into
a run of target-sized files in the next tier, so a row is rewritten once for each tier; runs of full-sized files are
done and leave the merge. A manifest names the runs of a version; it is written under a temporary name and renamed
to its number, which fails if another writer was first; that writer then tries again on top of the new version. So
versions follow each other and readers see a version whole or not at all. Shards are never changed. A
compaction deletes the runs it has replaced, and nothing else; what lost writers left is deleted when it is old.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trawl.llm.shared import delete, filesystem, rename_new

#: Bytes of the smallest tier, growth from tier to tier and runs that are merged, bytes of a merged file.
SMALLEST, MERGE, TARGET = 64 << 10, 4, 256 << 20
#: Runs of an arrival's first write.
ARRIVALS = 16


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    tier: int
    files: int = 1


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    runs: tuple[Run, ...]


def tier(size: int) -> int:
    """Runs of one tier differ in size by a factor below MERGE."""
    found = 0
    while size >= SMALLEST * MERGE ** (found + 1):
        found += 1
    return found


def _name(root: str, version: int) -> str:
    return f"{root}/manifests/{version:010d}.json"


def latest(spark: SparkSession, root: str) -> Manifest | None:
    fs, folder = filesystem(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return None
    text = spark.read.text(f"{root}/manifests/{names[-1]}", wholetext=True).first()[0]
    found = json.loads(text)
    return Manifest(found["version"], found["schema"], tuple(Run(**r) for r in found["runs"]))


def commit(spark: SparkSession, root: str, before: Manifest | None, runs: list[Run], schema: str) -> Manifest:
    """Makes the next version; raises FileExistsError if another writer has made it."""
    new = Manifest(before.version + 1 if before else 1, schema, tuple(sorted(runs, key=lambda r: r.path)))
    fs, temporary = filesystem(spark, f"{root}/manifests/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary)
    try:
        out.write(bytearray(json.dumps(asdict(new)).encode()))
    finally:
        out.close()
    rename_new(spark, temporary.toString(), _name(root, new.version))
    return new


def _run(spark: SparkSession, path: str) -> Run:
    fs, where = filesystem(spark, path)
    files = [f for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")]
    size = sum(f.getLen() for f in files)
    return Run(path, size, tier(size), max(1, len(files)))


def _retried(spark: SparkSession, root: str, change: Callable[[Manifest | None], tuple[list[Run], str] | None]) -> Manifest | None:
    """Commits ``change`` of the latest version, again where another writer came first; None where it no longer applies."""
    while True:
        before = latest(spark, root)
        changed = change(before)
        if changed is None:
            return None
        try:
            return commit(spark, root, before, *changed)
        except FileExistsError:
            continue


def _added(spark: SparkSession, root: str, schema: str, runs: list[Run]) -> Manifest:
    def change(before: Manifest | None) -> tuple[list[Run], str]:
        if before and before.schema != schema:
            raise ValueError("the rows do not have the table's columns")
        return [*(before.runs if before else ()), *runs], schema

    return _retried(spark, root, change)


def _check(spark: SparkSession, root: str, schema: str) -> None:
    before = latest(spark, root)
    if before and before.schema != schema:
        raise ValueError("the rows do not have the table's columns")


def append(batch: DataFrame, root: str) -> Manifest:
    """Adds the rows of ``batch``, whatever its columns are called, as one run and commits it."""
    spark, schema = batch.sparkSession, batch.schema.json()
    _check(spark, root, schema)
    path = f"{root}/data/{uuid.uuid4().hex}"
    batch.write.parquet(path)
    return _added(spark, root, schema, [_run(spark, path)])


def append_all(batches: DataFrame, root: str, arrival: str) -> Manifest:
    """Adds each value of the column ``arrival`` (which is not stored) as a run of its own, in one version."""
    spark, schema = batches.sparkSession, batches.drop(arrival).schema.json()
    _check(spark, root, schema)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    batches.write.partitionBy(arrival).parquet(folder)
    fs, where = filesystem(spark, folder)
    paths = [s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory()]
    return _added(spark, root, schema, [_run(spark, p) for p in paths])


def _merge(spark: SparkSession, root: str, runs: list[Run], schema: StructType, target: int) -> Run:
    """One run with the rows of several: whole input splits are put together, so no row is shuffled."""
    size = sum(r.bytes for r in runs)
    path = f"{root}/data/{uuid.uuid4().hex}"
    spark.read.schema(schema).parquet(*[r.path for r in runs]).coalesce(max(1, round(size / target))).write.parquet(path)
    return _run(spark, path)


def _groups(runs: tuple[Run, ...], merge: int, target: int) -> list[list[Run]]:
    """Runs to merge: ``merge`` of one tier, or a large one in small files alone. Runs of full-sized files are done."""
    tiers: dict[int, list[Run]] = {}
    for run in sorted(runs, key=lambda r: (r.bytes, r.path)):
        if 3 * run.bytes < 2 * target * run.files:
            tiers.setdefault(run.tier, []).append(run)
    whole = [own[k : k + merge] for own in tiers.values() for k in range(0, len(own) - merge + 1, merge)]
    alone = [[run] for own in tiers.values() for run in own[len(own) - len(own) % merge :] if run.bytes >= target and 4 * run.bytes < target * run.files]
    return whole + alone


def compact(spark: SparkSession, root: str, merge: int = MERGE, target: int = TARGET) -> Manifest:
    """Merges runs until every tier has fewer than ``merge`` of files well below ``target``, and commits after each round.

    The groups of a round are independent and run side by side. Their sizes only choose what is merged with
    what; every row of the table is in exactly one run of every version. Runs that other writers add meanwhile
    stay; if another compaction has replaced a run first, this round's work is given up and the next begins.
    """
    now = latest(spark, root)
    if now is None:
        raise ValueError(f"no table in {root}")
    schema = StructType.fromJson(json.loads(now.schema))
    while groups := _groups(now.runs, merge, target):
        with ThreadPoolExecutor(merge) as pool:
            merged = list(pool.map(lambda runs: _merge(spark, root, runs, schema, target), groups))
        gone = {run for group in groups for run in group}

        def change(before: Manifest | None) -> tuple[list[Run], str] | None:
            if before is None or not gone <= set(before.runs):  # noqa: B023
                return None
            return [*[r for r in before.runs if r not in gone], *merged], before.schema  # noqa: B023

        done = _retried(spark, root, change)
        for run in gone if done else merged:
            delete(spark, run.path)
        now = done or latest(spark, root)
    return now


def vacuum(spark: SparkSession, root: str, now: Manifest, hours: float = 24.0) -> None:
    """Deletes what lost writers left: folders that the manifest does not name and that are older than ``hours``.

    A writer must commit within that time. Only for tables without readers of older versions.
    """
    fs, folder = filesystem(spark, f"{root}/data")
    kept = {r.path.rpartition("/data/")[2] for r in now.runs}
    before = (time.time() - 3600 * hours) * 1000
    for write in fs.listStatus(folder):
        name = write.getPath().getName()
        inside = [part for part in fs.listStatus(write.getPath()) if part.isDirectory()] if write.isDirectory() else []
        for part, path in [(p, f"{name}/{p.getPath().getName()}") for p in inside] or [(write, name)]:
            if path not in kept and name not in kept and part.getModificationTime() < before:
                fs.delete(part.getPath(), True)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the latest version, nulls, long texts and repeated rows as they were; an empty table of the version's columns if it has no runs."""
    now = latest(spark, root)
    if now is None:
        raise ValueError(f"no table in {root}")
    schema = StructType.fromJson(json.loads(now.schema))
    if not now.runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[r.path for r in now.runs])
