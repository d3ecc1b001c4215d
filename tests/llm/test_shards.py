import json
import os

import pytest

from trawl.llm import shards

SCHEMA = "doc_id long, text string, path string"


def rows(n, at=0):
    return [(at + i, "text " * 40, None) for i in range(n)]


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_append_compact_and_read(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for k in range(9):
        shards.append(spark.createDataFrame(rows(50, 50 * k), SCHEMA).repartition(3), root)
    before = shards.latest(spark, root)
    assert before.version == 9 and len(before.runs) == 9
    after = shards.compact(spark, root, merge=4)
    tiers = [r.tier for r in after.runs]
    assert after.version > 9 and all(tiers.count(t) < 4 for t in tiers)
    assert ids(shards.read(spark, root)) == list(range(450))
    merged = [r for r in after.runs if r not in before.runs]
    assert len(merged) == 2
    assert all(len([f for f in os.listdir(r.path.removeprefix("file:")) if f.endswith(".parquet")]) == 1 for r in merged)
    kept = {os.path.basename(r.path) for r in after.runs}
    assert kept | {os.path.basename(os.path.dirname(r.path)) for r in after.runs} >= set(os.listdir(f"{tmp_path}/t/data"))
    assert shards.compact(spark, root) == after


def test_versions_are_atomic(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    first = shards.append(spark.createDataFrame(rows(5), SCHEMA), root)
    shards.append(spark.createDataFrame(rows(5, 5), SCHEMA), root)
    with pytest.raises(FileExistsError):  # a writer that still holds version 1
        shards.commit(spark, root, first, list(first.runs), first.schema)
    names = sorted(n for n in os.listdir(f"{tmp_path}/t/manifests") if n.endswith(".json") and not n.startswith("."))
    assert [json.load(open(f"{tmp_path}/t/manifests/{n}"))["version"] for n in names] == [1, 2]
    (tmp_path / "t/data/left-by-a-lost-writer").mkdir()
    shards.vacuum(spark, root, shards.latest(spark, root))
    assert ids(shards.read(spark, root)) == list(range(10))
    with pytest.raises(ValueError):
        shards.append(spark.createDataFrame([(1,)], "other long"), root)


def test_merged_files_have_the_target_size(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rnd = [(i, os.urandom(400).hex(), None) for i in range(4000)]
    frame = spark.createDataFrame(rnd, SCHEMA).selectExpr("*", "doc_id % 4 as a")
    shards.append_all(frame, root, "a")
    after = shards.compact(spark, root, target=400_000)
    (run,) = after.runs
    sizes = [os.path.getsize(f"{run.path.removeprefix('file:')}/{f}") for f in os.listdir(run.path.removeprefix("file:")) if f.endswith(".parquet")]
    assert len(sizes) > 1 and max(sizes) < 900_000 and min(sizes) > 200_000
    assert ids(shards.read(spark, root)) == list(range(4000))


def test_writers_that_race(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    for k in range(4):
        shards.append(spark.createDataFrame(rows(20, 20 * k), SCHEMA), root)
    keep, raced = shards.commit, []

    def late(spark_, root_, before, runs, schema):
        """Another writer appends, and a third has written but not committed, when a compaction commits."""
        if not raced:
            raced.append(True)
            (tmp_path / "t/data/uncommitted").mkdir()
            shards.append(spark.createDataFrame(rows(5, 1000), SCHEMA), root)
        return keep(spark_, root_, before, runs, schema)

    monkeypatch.setattr(shards, "commit", late)
    after = shards.compact(spark, root)
    assert len(after.runs) == 2 and ids(shards.read(spark, root)) == [*range(80), *range(1000, 1005)]
    shards.vacuum(spark, root, after)
    assert (tmp_path / "t/data/uncommitted").exists()
    shards.vacuum(spark, root, after, hours=-1)
    assert not (tmp_path / "t/data/uncommitted").exists() and len(ids(shards.read(spark, root))) == 85


def test_full_runs_leave_the_merge():
    full = [shards.Run(f"r{k}", 1000, 0, 1) for k in range(9)]
    assert shards._groups(tuple(full), 4, 1000) == []
    assert shards._groups((*full, shards.Run("x", 5000, 0, 50)), 4, 1000) == [[shards.Run("x", 5000, 0, 50)]]


def test_columns_of_any_name(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    frame = spark.createDataFrame([(1, "a", 5, 6), (2, None, 7, 8)], "doc_id long, _arrival string, arrival int, path int")
    shards.append(frame, root)
    shards.append(frame, root)
    shards.compact(spark, root, merge=2)
    assert shards.read(spark, root).columns == frame.columns
    assert sorted(map(tuple, shards.read(spark, root).collect())) == sorted([*map(tuple, frame.collect())] * 2)


def test_empty_null_and_repeated_rows(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    shards.append(spark.createDataFrame([], SCHEMA), root)
    assert shards.compact(spark, root) and shards.read(spark, root).count() == 0
    same = [(None, None, None), (1, "", "x"), (1, "", "x"), (2, "long " * 100_000, "_arrival")]
    shards.append(spark.createDataFrame(same, SCHEMA), root)
    assert sorted(map(tuple, shards.read(spark, root).collect()), key=repr) == sorted(same, key=repr)
