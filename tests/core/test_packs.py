import os
import random
import subprocess

import pytest

from trawl.sources import blobs, packs


def git(root, *a, **env):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=Te St", "-c", "user.email=t@t.example", *a], check=True, capture_output=True, env={**os.environ, **env}).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    rng = random.Random(3)
    git(root, "init", "-q")
    lines = [f"line {k} {rng.random()}" for k in range(400)]
    for k in range(30):
        lines[rng.randrange(400)] = f"changed in {k}"
        (root / "src/deep/er").mkdir(parents=True, exist_ok=True)
        (root / "src/big.txt").write_text("\n".join(lines))
        (root / f"src/deep/er/f{k % 7}.txt").write_text(f"é {k // 3}\n")
        (root / "same.txt").write_text("same")
        (root / f"copy{k % 2}.txt").write_text("same")
        (root / "bin").write_bytes(b"\0" + bytes([k]))
        git(root, "add", ".")
        at = f"2024-01-{k + 1:02d}T00:00:00+0200"
        git(root, "commit", "-qm", f"commit {k}\n\nbody", GIT_COMMITTER_DATE=at, GIT_AUTHOR_DATE=at)
        if k == 20:
            git(root, "repack", "-adq", "--depth=50", "--window=50")
        if k == 25:
            git(root, "repack", "-dq")
    (root / "huge.bin").write_bytes(rng.randbytes(300_000))
    git(root, "add", ".")
    git(root, "commit", "-qm", "last", GIT_COMMITTER_DATE="2024-03-01T00:00:00Z")
    git(root, "tag", "-am", "note", "v1")
    return root


def listed(root):
    out = git(root, "cat-file", "--batch-all-objects", "--batch-check").decode().split("\n")
    return {x.split()[0]: x.split()[1] for x in out if x}


@pytest.mark.parametrize("size", [20_000, 17])
def test_objects_equal_what_git_says(spark, repository, size):
    rows = packs.objects(spark, str(repository), size=size).collect()
    assert {r.oid: r.kind for r in rows} == listed(repository)
    deltas = sum(p.head(p.offset(k))[0] in (packs.OFFSET, packs.REFERENCE) for p in packs.Objects(packs.objects_folder(str(repository))).packs.values() for k in range(p.count))
    assert deltas > 20
    for r in rows:
        assert bytes(r.content) == git(repository, "cat-file", r.kind, r.oid) and r.size == len(r.content)


def test_names_are_found_by_binary_search(repository):
    objects = packs.Objects(packs.objects_folder(str(repository)))
    for oid, kind in listed(repository).items():
        assert objects.get(bytes.fromhex(oid))[0] == kind
    for pack in objects.packs.values():
        assert pack.find(b"\0" * 20) is None and pack.find(b"\xff" * 20) is None


def test_references_as_bases(repository, tmp_path):
    """A pack with differences to named objects, as fetched ones have."""
    names = "\n".join(listed(repository)).encode()
    base = str(tmp_path / "pack")
    made = subprocess.run(["git", "-C", str(repository), "pack-objects", "-q", "--no-reuse-delta", base], input=names, capture_output=True, check=True).stdout.decode().strip()
    (tmp_path / "objects/pack").mkdir(parents=True)
    for kind in ("idx", "pack"):
        os.rename(f"{base}-{made}.{kind}", tmp_path / f"objects/pack/pack-{made}.{kind}")
    own = packs.Objects(str(tmp_path / "objects"))
    (pack,) = own.packs.values()
    kinds = {pack.head(pack.offset(k))[0] for k in range(pack.count)}
    assert packs.REFERENCE in kinds
    for k in range(pack.count):
        kind, body = own.get(pack.name(k))
        assert body == git(repository, "cat-file", kind, pack.name(k).hex())


def test_history_is_that_of_git(spark, repository):
    found = {r.blob_id: r for r in packs.history(spark, str(repository)).collect()}
    plain = {r.blob_id: r for r in blobs.git_history(spark, str(repository)).collect()}
    assert set(found) == set(plain) - {k for k, r in plain.items() if r.path == "huge.bin"} | (set(found) & set(plain))
    for k, r in found.items():
        assert (bytes(r.content), r.commit, r.author, r.email, r.committed, r.message) == (bytes(plain[k].content), plain[k].commit, plain[k].author, plain[k].email, plain[k].committed, plain[k].message)
    same = next(r for r in found.values() if bytes(r.content) == b"same")
    assert (same.path, same.message) == ("copy0.txt", "commit 0")
    assert not any(r.path == "bin" for r in found.values())


def test_a_repository_without_objects(spark, tmp_path):
    git(tmp_path, "init", "-q")
    assert packs.objects(spark, str(tmp_path)).count() == 0
    assert packs.history(spark, str(tmp_path)).count() == 0


def test_damaged_differences_are_refused():
    with pytest.raises(ValueError, match="base"):
        packs.changed(b"abc", b"\x04\x01\x01x")
    with pytest.raises(ValueError, match="size"):
        packs.changed(b"abc", b"\x03\x05\x01x")
