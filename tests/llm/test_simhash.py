import numpy as np
import pytest
import xxhash

from trawl.llm import simhash

SCHEMA = "doc_id long, text string, lang string, component_id string"


def brute(rows):
    """Fingerprints bit by bit and components over all pairs."""
    prints = []
    for _, text in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    return sorted(((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label)), key=repr)


def rows_like():
    rng = np.random.default_rng(5)
    words = [f"Word{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(6)]
    texts = []
    for b in base:
        for k in range(8):
            w = b.split()
            w[int(rng.integers(len(w)))] = f"changed{k}"
            texts.append(" ".join(w))
    return list(enumerate([*texts, *base, "", None, "  \n\t", "one", "One two", "one\ttwo", base[0], "Ünïcode Ä ä"]))


@pytest.mark.parametrize("hot", [None, 2])
def test_equals_brute_force(spark, hot, monkeypatch):
    rows = rows_like()
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs, hot=hot)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (None, "z z z z z z")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [None, 3])
def test_trie_walk_finds_all_links(spark, hot):
    rng = np.random.default_rng(7)
    core = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, int(k), replace=False)) for c in core for k in rng.integers(0, 4, 6)]
    values = sorted({*map(int, core), *near, -1, -2, 0, 1})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    label = {v: v for v in values}
    for a, b in simhash.links(frame, hot).collect():
        x, y = label[a], label[b]
        label = {v: min(x, y) if c in (x, y) else c for v, c in label.items()}
    want = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = want[a], want[b]
                want = {v: min(x, y) if c in (x, y) else c for v, c in want.items()}
    assert label == want


def test_very_long_texts_are_hashed_in_parts():
    text = " ".join(f"w{k % 1009}" for k in range(70_000))
    words = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
