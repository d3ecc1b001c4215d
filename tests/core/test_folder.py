import io
import os
import subprocess
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.sources import folder, ignore


def put(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)


def paths(frame):
    return sorted(r.path for r in frame.select("path").collect())


def test_hidden_links_sizes_and_binaries(spark, tmp_path):
    put(tmp_path, {"a.txt": b"text", ".env": b"KEY=1", ".git/config": b"x", "_under/x": b"u", "sub/b": b"js", "sub/big": b"y" * 200, "bin": b"\0\1", "empty": b""})
    os.symlink("a.txt", tmp_path / "link")
    os.symlink("sub", tmp_path / "folder-link")
    os.symlink("nowhere", tmp_path / "dead")
    assert paths(folder.read(spark, str(tmp_path), most=100)) == ["_under/x", "a.txt", "empty", "sub/b"]
    assert paths(folder.read(spark, f"file://{tmp_path}", hidden=True, symlinks=True)) == [".env", ".git/config", "_under/x", "a.txt", "empty", "link", "sub/b", "sub/big"]
    told = {r.path: r.left_out for r in folder.read(spark, str(tmp_path), most=100, report=True).collect()}
    assert told == {"a.txt": None, "_under/x": None, "sub/b": None, "empty": None, ".env": "hidden", "sub/big": "too large", "bin": "binary", "link": "link"}
    (row,) = folder.read(spark, str(tmp_path)).filter("path = 'a.txt'").collect()
    assert bytes(row.content) == b"text" and row.size == 4
    assert row.blob_id == subprocess.run(["git", "hash-object", str(tmp_path / "a.txt")], capture_output=True, check=True).stdout.decode().strip()
    with pytest.raises(Exception, match="No such file"):
        folder.read(spark, str(tmp_path / "missing")).count()


def test_members_of_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "secret")
        z.writestr("raw", b"\0\0")
    put(tmp_path, {"x.zip": inner.getvalue(), "y.txt": b"plain"})
    found = folder.read(spark, str(tmp_path), extract=True, report=True).select("path", "member", "content", "left_out").collect()
    assert sorted(((r.path, r.member, r.content and bytes(r.content), r.left_out) for r in found), key=repr) == sorted([("x.zip", "deep.txt", b"secret", None), ("x.zip", "raw", None, "binary"), ("y.txt", None, b"plain", None)], key=repr)


def test_ignore_files_of_every_folder(spark, tmp_path):
    put(tmp_path, {
        ".gitignore": b"*.log\n!keep.log\n/build/\ndocs/**/out\n# note\n\\#odd\n", "a.log": b"1", "keep.log": b"2", "build/x": b"3", "sub/build/x": b"4", "docs/out": b"5",
        "docs/a/b/out": b"6", "#odd": b"7", "sub/.gitignore": b"*.txt\n!special.txt\nkeep.log\n", "sub/a.txt": b"8", "sub/special.txt": b"9", "sub/keep.log": b"0", "sub/deep/b.txt": b"1", "other/b.txt": b"2",
    })
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], capture_output=True, check=True).stdout.decode()
    git("init", "-q")
    want = [p for p in git("ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
    for parts in (1, 3, 40):
        assert paths(folder.read(spark, str(tmp_path), hidden=True, partitions=parts).filter("path not like '.git/%'")) == sorted(want)
    assert len(paths(folder.read(spark, str(tmp_path), gitignore=False))) == 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.from_regex(r"!?/?(\*\*/)?([ab*?]{1,3}|\[ab\])(/[ab*]{1,2})?/?", fullmatch=True), min_size=1, max_size=4))
def test_ignore_rules_are_gits(tmp_path_factory, lines):
    root = tmp_path_factory.mktemp("ignore")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    files = [f"{x}{y}" for x in ("", "a/", "b/", "a/b/", "ab/a/") for y in ("a1", "ab", "b") if f"{x}{y}" not in ("ab", "b", "a/b")]
    put(root, {f: b"x" for f in files} | {".gitignore": "\n".join(lines).encode()})
    shown = subprocess.run(["git", "-C", str(root), "ls-files", "--others", "--exclude-standard", "-z"], capture_output=True, check=True).stdout.decode().split("\0")
    rules = ignore.parse("\n".join(lines))

    def ignored(path):
        parts = path.split("/")
        return any(ignore.is_ignored("/".join(parts[:k]), k < len(parts), rules) for k in range(1, len(parts) + 1))

    assert [f for f in files if not ignored(f)] == [f for f in files if f in shown]


def test_a_flat_folder_is_shared_out_and_not_listed_by_the_driver(tmp_path, monkeypatch):
    for k in range(5000):
        (tmp_path / f"f{k}").touch()
    seen = []
    plain = folder.Local.entries
    monkeypatch.setattr(folder.Local, "entries", lambda self, where: (seen.append(e) or e for e in plain(self, where)))
    reader = folder.Reader({"path": str(tmp_path), "partitions": "8"})
    parts = reader.partitions()
    assert len(parts) == 8 and len(seen) <= folder.LOOK
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(sizes) == 5000 and max(sizes) < 800


def test_filters_keep_files_closed(spark, tmp_path):
    put(tmp_path, {"a/x": b"1", "a/y": b"22", "b/x": b"333"})
    frame = folder.read(spark, str(tmp_path))
    assert paths(frame.filter("startswith(path, 'a/')")) == ["a/x", "a/y"]
    assert paths(frame.filter("size <= 2 and startswith(path, 'a/y')")) == ["a/y"]
    reader = folder.Reader({"path": str(tmp_path), "partitions": "1"})
    assert len(list(reader.pushFilters([folder.StringStartsWith(("path",), "a/"), folder.LessThanOrEqual(("size",), 1)]))) == 2
    assert [b.column("path").to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["a/x"]]


def test_a_single_file(spark, tmp_path):
    put(tmp_path, {".env": b"KEY=1", ".env.local": b"KEY=2", "sub/.env": b"KEY=3"})
    assert [(r.path, bytes(r.content)) for r in folder.read(spark, f"file://{tmp_path}/.env").collect()] == [(".env", b"KEY=1")]


def test_batches_of_a_share_are_small_and_whole(tmp_path):
    """A worker holds a few MB of a share, however large it is."""
    for k in range(120):
        (tmp_path / f"{k}.txt").write_bytes(bytes([65 + k % 26]) * 100_000)
    reader = folder.Reader({"path": str(tmp_path), "partitions": "1"})
    batches = [b for share in reader.partitions() for b in reader.read(share)]
    assert sorted(p for b in batches for p in b.column("path").to_pylist()) == sorted(f"{k}.txt" for k in range(120))
    assert max(b.nbytes for b in batches) < 5 << 20


def test_a_file_is_read_whole_whatever_size_it_tells(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 1000)
    store = folder.opened(str(tmp_path))
    assert [len(store.read("a", n)) for n in (10, 1000, 1001, 1 << 20)] == [10, 1000, 1000, 1000]
    assert folder.opened("/proc/self").read("status", 1 << 20).startswith(b"Name:")  # tells 0 bytes
    assert len(folder.opened("/proc/self").read("status", 20)) == 20
