"""Pairs of credentials, public suffixes, mirrors and filtered stores."""

import contextlib
import itertools
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.functions import suffix
from trawl.functions.ids import blob_id
from trawl.operators import triage
from trawl.plans import mirror
from trawl.plans.store import Store, contents, keep_contents

MATCH = "blob_id string, rule_id string, structural_id string, start long, end long, groups array<string>"


def test_pairs_are_the_nearest_on_either_side(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        start = rng.randrange(12_000)
        rows.append((f"b{k % 3}", rng.choice(["key", "secret", "other"]), f"s{k}", start, start + rng.choice([5, 20]), [f"v{k}"]))
    rows.append(("b9", "key", "lonely", 0, 5, ["x"]))
    got = {r.key_id: (r.secret_id, r.side, r.distance) for r in triage.paired_near(spark.createDataFrame(rows, MATCH), ["key"], ["secret"], 700).collect()}
    want = {}
    for b, rule, key, start, end, _ in rows:
        if rule == "key":
            near = []
            for c, other, name, s, e, _ in rows:
                gap = s - end if s >= end else start - e if e <= start else None
                if c == b and other == "secret" and gap is not None and gap <= 700:
                    near.append((gap, s < end, s, name))
            best = min(near, default=None)
            want[key] = (best[3], "before" if best[1] else "behind", best[0]) if best else (None, None, None)
    assert got == want


def test_public_suffixes(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "kobe.jp", "*.kobe.jp", "!city.kobe.jp", "// note", "", "рф", "公司.cn"]
    root = suffix.trie(rules)
    cases = {
        "example.com": "example.com", "a.b.example.com": "example.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "a.x.co.uk": "x.co.uk", "a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck",
        "x.www.ck": "www.ck", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "a.city.kobe.jp": "city.kobe.jp", "unknown": None, "a.unknown": "a.unknown",
        "1.2.3.4": None, "[::1]": None, "": None, "EXAMPLE.Com.": "example.com", "a.xn--p1ai": "a.xn--p1ai", "x..com": None,
    }
    assert {name: suffix.domain(name, root) for name in cases} == cases
    table = spark.createDataFrame([(r,) for r in [*rules, None]], "suffix string")
    frame = spark.createDataFrame([("https://a.x.co.uk/1", "https://b.x.co.uk"), ("https://x.co.uk", "https://y.co.uk"), ("http://1.2.3.4/a", "http://1.2.3.4/b"), ("https://co.uk", "https://co.uk/x")], "u string, t string")
    assert [r[0] for r in frame.select(suffix.in_domain(F.col("u"), F.col("t"), table)).collect()] == [True, False, True, True]
    with pytest.raises(ValueError, match="suffixes"):
        suffix.known(spark.range(suffix.MOST + 1).select(F.col("id").cast("string").alias("suffix")))


def files_of(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def test_a_mirror_keeps_two_contents_of_one_path_and_is_the_same_again(spark, tmp_path):
    pages = [("https://h.example/a.html#1", "one"), ("https://h.example/a.html#2", "two"), ("https://h.example/a.html#3", "one"), ("https://h.example/", "root"), ("https://h.example/q?x=1", "q"), (None, "x"), ("https://h.example/n", None), ("https://h.example/a.html#2", "two")]
    made = []
    for k, order in enumerate((pages, pages[::-1], pages[3:] + pages[:3])):
        frame = spark.createDataFrame(order, "url string, content string").repartition(3)
        where = tmp_path / f"m{k}"
        table = sorted(map(tuple, mirror.write(frame, str(where / "files"), str(where / "manifest")).collect()))
        assert table == sorted(map(tuple, mirror.write(frame, f"file://{where}/files", str(where / "manifest")).collect()))
        made.append((files_of(where / "files"), table))
    assert made[0] == made[1] == made[2]
    files, rows = made[0]
    assert files["h.example/a.html"] == b"one" and sorted(v for n, v in files.items() if n.startswith("h.example/a__")) == [b"two"] and len(files) == 4
    assert {u: files[f].decode() for u, f, _, _ in rows} == {u: c for u, c in pages if u and c}


def blobs(spark, numbers):
    return spark.createDataFrame([(k,) for k in numbers], "k long").select(blob_id(F.col("k").cast("string")).alias("blob_id"), F.col("k").alias("size"))


def test_a_lookup_opens_only_the_parts_that_may_hold_a_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), digits=2)
    for k in range(4):
        store.add("blobs", blobs(spark, range(k * 500, k * 500 + 500)))
    assert store.table("blobs").count() == 2000 and store.table("blobs").columns == ["blob_id", "size"]
    assert store.unseen(blobs(spark, range(5000, 5020))).count() == 20
    assert store.parts > 800 and len(store.opened) < 8
    assert sorted(r["size"] for r in store.unseen(blobs(spark, [3, 777, 1999, 7000])).collect()) == [7000]
    assert 3 <= len(store.opened) < 12 and len({run for _, run, _ in store.opened}) >= 3
    before = store._latest("blobs")
    store.add("blobs", blobs(spark, [3, 777]))
    assert store.table("blobs").count() == 2000 and len(store._latest("blobs")[1]) == len(before[1]) + 1


def test_tables_that_begin_empty(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add("blobs", blobs(spark, []))
    assert store.table("blobs").count() == 0 and store.unseen(blobs(spark, [1])).count() == 1
    store.add("blobs", blobs(spark, [1, 2]))
    assert store.table("blobs").count() == 2 and store.unseen(blobs(spark, [1, 5])).count() == 1


def test_contents_are_kept_once_under_manifests(spark, tmp_path):
    frame = spark.createDataFrame([(f"text {k % 5}",) for k in range(20)], "content string").withColumn("blob_id", blob_id(F.col("content")))
    where = str(tmp_path / "c")
    for part in itertools.repeat(frame, 2):
        keep_contents(part, where)
    got = contents(spark, where, frame.filter("content in ('text 1', 'text 3')").select("blob_id"))
    assert sorted(r.content for r in got.collect()) == ["text 1", "text 3"]
    assert contents(spark, where, spark.createDataFrame([("ff" * 20,)], "blob_id string")).count() == 0
    assert Store(spark, where, digits=2).table("contents").count() == 5


def test_a_mirror_gives_its_workers_narrow_batches(spark, tmp_path, monkeypatch):
    """Not 10,000 contents at once; the session's own limits are the same afterwards."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, plain = spark.conf.get(limit), [], mirror.narrow_batches

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    @contextlib.contextmanager
    def watched(session):
        with plain(session):
            wide = session.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
            seen.extend(wide.mapInArrow(told, "n long, bytes long").collect())
            yield

    monkeypatch.setattr(mirror, "narrow_batches", watched)
    frame = spark.createDataFrame([(f"https://h.example/{k}", f"c{k}") for k in range(20)], "url string, content string")
    assert mirror.write(frame, str(tmp_path / "files"), str(tmp_path / "manifest")).count() == 20
    assert sum(r.n for r in seen) == 3000 and max(r.bytes for r in seen) < 6 << 20
    assert spark.conf.get(limit) == before
