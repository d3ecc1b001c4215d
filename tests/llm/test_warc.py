import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import warc

ROWS = [
    (3, "http://a/3", "<p>same</p>", "x"), (1, "http://a/1", "<p>same</p>", "x"), (2, "http://a/2", "<p>ünïque</p>", "x"), (4, "http://a/4", None, "x"),
    (5, "http://a/5", "", "x"), (6, None, "big " * 200_000, "x"), (6, None, "big " * 200_000, "x"), (None, "http://a/n", "<p>same</p>", "x"), (10**15, "http://a b\nc", "WARC/1.1\r\n\r\n", "x"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")


def files(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.endswith(".gz")}


def brute(rows):
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same) if same else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/one"
    manifest = warc.write(pages(spark), folder)
    got = warc.read(manifest, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(ROWS)
    by_id = {r[0]: r[2] for r in ROWS}
    assert all(r.payload.decode() == (by_id[r.page_id] or "") for r in got if r.record_type == "response")
    for row in manifest.collect():
        data = open(f"{tmp_path}/one/{row.file}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (row.bytes, row.sha256)
    first = gzip.decompress(next(iter(files(f"{tmp_path}/one").values())))
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    with pytest.raises(FileExistsError):
        warc.commit(spark, manifest, folder)


def test_same_bytes_however_the_rows_lie(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 700} text</p>" * (i % 50), "") for i in range(0, 4000, 2)]
    for name, parts in (("a", 1), ("b", 7)):
        warc.write(pages(spark, rows).repartition(parts), f"file://{tmp_path}/{name}", roll=20_000)
    a, b = files(f"{tmp_path}/a"), files(f"{tmp_path}/b")
    assert a == b and len(a) > 20


def test_files_roll_by_compressed_size(spark, tmp_path):
    rows = [(i, "u", os.urandom(600).hex(), "") for i in range(64 * 8)]
    manifest = warc.write(pages(spark, rows), f"file://{tmp_path}/r", roll=3_000).collect()
    assert any(m.file.endswith("-00001.warc.gz") for m in manifest)
    assert all(m.bytes < 4_500 for m in manifest) and sum(m.records for m in manifest) == len(rows)


def test_ranges_share_the_weight(spark):
    rows = [(i, 1) for i in range(2000)] + [(10**12 + i, 1) for i in range(2000)] + [(5 * 10**14, 500)]
    frame = spark.createDataFrame(rows, "k long, w long")
    bounds = warc.ranges(frame, "k", "w", 20)
    assert bounds == sorted(bounds) and 15 <= len(bounds) <= 30
    sums = [sum(w for k, w in rows if a <= k < b) for a, b in zip(bounds, [*bounds[1:], 10**16])]
    assert max(sums) <= 500
    assert warc.ranges(frame.limit(0), "k", "w", 20) == []


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.read(warc.write(pages(spark).limit(0), folder), folder).count() == 0


def test_records_without_ids_are_dealt_to_many_files(spark, tmp_path):
    rows = [(None if i % 10 else (7 if i % 20 else i), f"http://h/{i}", f"text {i % 900}", "") for i in range(3000)]
    folder = f"file://{tmp_path}/n"
    manifest = warc.write(pages(spark, rows).repartition(3), folder)
    assert manifest.count() > 20 and max(r.records for r in manifest.collect()) < 300
    got = warc.read(manifest, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows)
    warc.write(pages(spark, rows).repartition(5), f"file://{tmp_path}/m")
    assert files(f"{tmp_path}/n") == files(f"{tmp_path}/m")


def test_schemes_of_folders():
    system, path = warc.opened("file:///tmp/x")
    assert path == "/tmp/x" and system.type_name == "local"


@pytest.mark.parametrize("parts", [1, 7, 20_000])
def test_ranges_of_any_number_are_even(spark, parts):
    """Keys in lumps and far apart; as many ranges as a large archive has take no longer plans."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") * 1_000_003 - 7_000_000_000).when(F.col("id") % 3 == 1, F.col("id")).otherwise(F.lit(500)).alias("k"), (F.col("id") % 5 + 1).alias("w"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5)], "k long, w long")).cache()
    bounds = warc.ranges(rows, "k", "w", parts)
    keys = np.array([(r["k"], r["w"]) for r in rows.filter("k is not null").collect()])
    assert bounds == sorted(set(bounds)) and bounds[0] == keys[:, 0].min()
    held = np.bincount(np.searchsorted(bounds, keys[:, 0], side="right") - 1, keys[:, 1], len(bounds))
    target = keys[:, 1].sum() // parts
    single = {int(np.searchsorted(bounds, 500, side="right") - 1)}
    assert all(w <= target + 5 for k, w in enumerate(held) if k not in single)
    assert len(bounds) <= 2 * parts + 2
    rows.unpersist()
