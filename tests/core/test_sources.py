import io
import json
import sqlite3
import subprocess
import tarfile
import zipfile

from pyspark.sql import functions as F

from trawl.functions.ids import blob_id
from trawl.operators import findings, rules
from trawl.plans.store import Store, scan
from trawl.sources import blobs, extract
from trawl.streaming import scan as streaming

BY_ID = {r.id: r for r in rules.BUILTIN}


def test_files_are_filtered_by_name_size_and_content(spark, tmp_path):
    for name, body in {"a.txt": b"text", ".hidden": b"x", ".git/config": b"x", "sub/b.js": b"js", "sub/big.txt": b"y" * 200, "bin": b"\0\1", "build/out.js": b"o", "keep/out.js": b"k"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = blobs.files(spark, f"file://{tmp_path}", most=100, gitignore=["# note", "out.js", "!keep/out.js"])
    assert {r.path for r in got.collect()} == {"a.txt", "sub/b.js", "keep/out.js"}
    assert {r.path for r in blobs.files(spark, f"file://{tmp_path}", binary=True).collect()} == {"a.txt", "sub/b.js", "keep/out.js", "build/out.js", "bin", "sub/big.txt"}


def test_git_history_holds_every_blob_once(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for body in ("one", "two", "one"):
        (tmp_path / "f.txt").write_text(body)
        git("add", ".")
        git("commit", "-qm", body, "--allow-empty")
    rows = blobs.git_history(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.content) for r in rows) == [b"one", b"two"]
    got = spark.createDataFrame([(bytes(r.content), r.blob_id) for r in rows], "c binary, b string").filter(blob_id(F.col("c")) != F.col("b"))
    assert got.count() == 0


def test_combined_keeps_the_first_source(spark):
    one = spark.createDataFrame([("a", "p1", "x"), ("b", "p2", "y")], "blob_id string, path string, text string")
    two = spark.createDataFrame([("b", "q1", "y"), ("c", "q2", "z"), ("c", "q1", "z")], "blob_id string, path string, text string")
    assert sorted((r.blob_id, r.path) for r in findings.combined(one, two).collect()) == [("a", "p1"), ("b", "p2"), ("c", "q1")]


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_extraction(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "x.db")
    base.execute("create table t (a text, b int, c text)")
    base.executemany("insert into t values (?, ?, ?)", [("k1", 1, "v1"), ("k2", 2, None)])
    base.commit()
    base.close()
    inner = archive({"deep.txt": b"deep secret", "bin": b"\0\0"})
    cases = {
        "a.zip": (archive({"x.txt": b"hello", "in.jar": inner}), {"x.txt": "hello", "in.jar:deep.txt": "deep secret"}),
        "d/b.tar.gz": (tar({"y.txt": b"why", "z.zip": inner}), {"y.txt": "why", "z.zip:deep.txt": "deep secret"}),
        "c.docx": (archive({"word/document.xml": "<w><p>Top</p><p> secret  text</p></w>", "word/other.xml": "<x>no</x>"}), {"word/document.xml": "Top secret text"}),
        "s.xlsx": (archive({"xl/sharedStrings.xml": "<s><t>cell</t></s>", "xl/worksheets/sheet1.xml": "<s><v>42</v></s>"}), {"xl/sharedStrings.xml": "cell", "xl/worksheets/sheet1.xml": "42"}),
        "n.ipynb": (json.dumps({"cells": [{"cell_type": "code", "source": ["a=1\n", "b"]}, {"cell_type": "raw", "source": ["no"]}, {"cell_type": "markdown", "source": "no list"}]}).encode(), {"cell_0_code": "a=1\nb"}),
        "m.eml": (b"Subject: x\n\nbody", {"email": "Subject: x\n\nbody"}),
        "r.rtf": (rb"{\rtf1\ansi Hello \b World}", {"text": "Hello World"}),
        "x.db": ((tmp_path / "x.db").read_bytes(), {"t": "k1 v1\nk2"}),
        "bad.zip": (b"PK\3\4 broken", {}),
        "plain.txt": (b"no container", {}),
    }
    frame = spark.createDataFrame([(p, bytearray(b)) for p, (b, _) in cases.items()] + [("null.zip", None)], "path string, content binary")
    got = {}
    for r in extract.extract(frame).collect():
        got.setdefault(r.path, {})[r.member] = bytes(r.content).decode()
    assert got == {p: want for p, (_, want) in cases.items() if want}


def test_limits_hold_while_reading(monkeypatch):
    monkeypatch.setattr(extract, "MEMBER", 10)
    assert [n for n, _ in extract.members("a.zip", archive({"small": b"x" * 10, "large": b"x" * 11}))] == ["small"]
    nest = archive({"end.txt": b"e"})
    for _ in range(8):
        nest = archive({"in.zip": nest})
    monkeypatch.setattr(extract, "MEMBER", 10 << 20)
    assert list(extract.members("a.zip", nest)) == []


def sample(spark, texts):
    return blobs.from_table(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "t", F.concat(F.lit("p/"), F.col("k").cast("string")))


def test_store_is_incremental(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    pack = [BY_ID["tr.ipv4.1"]]
    assert scan(store, sample(spark, ["1.2.3.4", "5.6.7.8", "1.2.3.4", None]), pack).count() == 2
    assert scan(store, sample(spark, ["1.2.3.4", "5.6.7.8"]), pack).count() == 0
    assert scan(store, sample(spark, ["9.9.9.9 1.2.3.4", "5.6.7.8"]), pack).count() == 2
    assert (store.table("matches").count(), store.table("findings").count(), store.table("blobs").count()) == (4, 3, 3)
    change = lambda status, at: spark.createDataFrame([("finding", "f", status, "c", at)], "target_type string, target_id string, status string, comment string, at long")
    store.annotate(change("accept", 1))
    store.annotate(change("reject", 2))
    assert [r.status for r in store.table("annotations").collect()] == ["reject"]


def test_stream_equals_batch(spark, tmp_path):
    texts = ["a@b.example.org", "1.2.3.4 and 1.2.3.4", "nothing", "a@b.example.org"]
    table = sample(spark, texts)
    for k in range(2):
        table.write.mode("append").parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/out")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.start(stream, rules.BUILTIN, store, f"file://{tmp_path}/check").awaitTermination(240)
    other = Store(spark, f"file://{tmp_path}/batch")
    scan(other, table, rules.BUILTIN)
    ids = lambda s: sorted(r.structural_id for r in s.table("matches").collect())
    assert ids(store) == ids(other) and len(ids(store)) == 2


def test_url_list(spark, tmp_path):
    (tmp_path / "u").write_text("# no\n\n https://a/x \nhttps://b\n")
    assert sorted(r.url for r in blobs.url_list(spark, f"file://{tmp_path}/u").collect()) == ["https://a/x", "https://b"]


def test_files_and_blobs_of_up_to_20_mib_are_read(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (tmp_path / "whole.txt").write_bytes(b"y" * (20 << 20))
    (tmp_path / "over.txt").write_bytes(b"y" * ((20 << 20) + 1))
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "both")
    assert [r.path for r in blobs.files(spark, f"file://{tmp_path}").select("path").collect()] == ["whole.txt"]
    assert [r.path for r in blobs.git_history(spark, str(tmp_path)).select("path").collect()] == ["whole.txt"]
