import numpy as np

import corpus_pipeline
from trawl.llm import circulant, shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                label = [min(label[i], label[j]) if k in (label[i], label[j]) else k for k in label]
    least = {c: min((r[0] for r, k in zip(rows, label) if k == c and r[0] is not None), default=None) for c in set(label)}
    return sorted(((r[0], least[c]) for r, c in zip(rows, label)), key=repr)


def rows_like():
    """Texts of which words are changed one after another, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(5)
    words, texts = [f"Word{k}" for k in range(400)], []
    for _ in range(8):
        base = list(rng.choice(words, 200))
        for k in range(9):
            w = list(base)
            for at in range(k):
                w[7 + 19 * at] = f"changed{k}x{at}"
            texts.append(" ".join(w))
    return list(enumerate([*texts, "", None, " \n\t", "one", "One two", "one\ttwo", texts[0].upper(), "a b c d e f g"])) + [(None, texts[9]), (None, "z z"), (3, texts[3])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], SCHEMA)


def test_equals_brute_force(spark):
    rows = rows_like()
    got = shingles.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert shingles.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_members_of_a_bucket_that_are_far_from_its_least(spark, monkeypatch):
    """All texts in one bucket: the second round alone finds pairs that do not hold the least."""
    monkeypatch.setattr(shingles, "bands", lambda hashes: np.ones(1 if len(hashes) else 0, np.uint64))
    rows = rows_like()[::3]
    assert sorted(map(tuple, shingles.near_duplicates(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_the_stage_links_from_four_fifths_on(spark):
    rng = np.random.default_rng(3)
    base = [f"word{k}" for k in rng.integers(0, 10_000, 300)]
    near, far = list(base), list(base)
    near[50], near[150], near[250] = "x", "y", "z"
    far[10:290:20] = ["q"] * 14
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    bits = (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])) & (2**64 - 1)
    assert bits.bit_count() > 2
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()) == [1, 3]


def test_near_dedup_gives_its_workers_narrow_batches(spark, monkeypatch):
    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(limit)
    for module in (shingles, circulant):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, *rest, plain=plain: seen.append(spark.conf.get(limit)) or plain(df, *rest))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g")], "doc_id long, text string")
    assert [r.doc_id for r in shingles.kept(docs).collect()] == [1]
    assert set(seen) == {str(4 << 20)} and spark.conf.get(limit) == before
