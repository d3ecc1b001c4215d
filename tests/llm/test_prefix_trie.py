import hashlib
import zlib

import numpy as np
import pytest

from trawl.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, place string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    """The trie by dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: (x[0], x[1], x[2], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()[:16]))] for c, turns in own.items()}
    built = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        b = abs(c) - abs(c) % 5
        built[c] = plain.get(b if c >= 0 else -b, [])[:h] + plain[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, kids = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, own_members in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own_members) - 1) * len(p[-1][1].encode()) if p else 0
    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def got(spark, rows, **how):
    found = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), **how)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


def rows_like():
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), ["user", "bot"][t % 2], f"turn {rng.integers(3)} ä" * (1 + t)) for c in range(60) for t in range(int(rng.integers(1, 12)))]
    rows += [(c, t, "user", f"common {t}") for c in (100, 105, 110, 115, 121, 126) for t in range(7)]  # copies
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_brute_force(spark, rebuild):
    assert got(spark, rows_like(), rebuild=rebuild) == brute(rows_like(), rebuild)


def test_long_shared_beginnings_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHAIN", 7)
    rows = [(c, t, "user", f"turn {t}" if t < 37 or c < 20 else f"own {c} {t}") for c in (10, 15, 20, 25) for t in range(60)]
    assert got(spark, rows, rebuild=False) == brute(rows, False)


def test_nulls_ties_repeats_and_turnless(spark):
    turnless = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(turnless, 1, None, None), (turnless, None, "user", "first"), (None, 1, "user", "lost"), (301, 1, "user", "b"), (301, 1, "user", "a"), (301, 1, "user", "a"), (302, 2, "", ""), (302, 2, None, None), (-3, 1, "user", "minus"), (-3, 2, "user", "x" * 200_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_texts_of_nodes(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, None, "yes"), (2, 1, "user", "hi")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    nodes = prefix_trie.prefix_trie(frame, rebuild=False)
    found = prefix_trie.with_texts(nodes, frame).select("conv_id", "depth", "last_role", "last_text").collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 0, None, None), (1, 1, "user", "hi"), (1, 2, "", "yes")]


def test_ends_of_many_members(spark, monkeypatch):
    ends = spark.range(5000).selectExpr("unhex('ab') as node", "id as conv_id").repartition(7)
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in prefix_trie.digests(ends).collect()] == [(b"\xab", want)]
