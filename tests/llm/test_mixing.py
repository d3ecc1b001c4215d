from collections import defaultdict

import numpy as np
import pytest

from trawl.llm import mixing


def water_level(sizes, weights):
    """Targets by sharing again and again."""
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while True:
        total = sum(weights[s] for s in free)
        share = {s: left * weights[s] / total for s in free} if total else {}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        for s in over:
            target[s] = 3.0 * sizes[s]
        if not over:
            return target | share
        free -= over
        left -= sum(3 * sizes[s] for s in over)


def documents(spark, seed=1, sources=("b", "a", None, "é", "z", "")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(3000):
        k = int(rng.choice(len(sources), p=[0.6, 0.2, 0.1, 0.05, 0.04, 0.01]))
        rows.append((i, "w " * int(np.exp(rng.normal(4, 1))), sources[k], "x"))
    rows += [(5000, None, "a", "x"), (5001, "", None, "x"), (5002, " \n\t", "only", "x"), (7, rows[7][1], rows[7][2], "x"), (None, "w w w", "a", "x"), (5003, "w " * 9000, "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string"), rows


def test_words_come_near_targets(spark):
    docs, rows = documents(spark)
    got = mixing.mix(docs).collect()
    source_of = {r[0]: r[2] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_inclusion_follows_expected_copies(spark):
    docs, rows = documents(spark, 2)
    got = [r for r in mixing.mix(docs).collect() if r.source_size > 50_000]
    short = np.mean([r.copies for r in got if 0 < r.size < 40])
    long = np.mean([r.copies for r in got if r.size > 100])
    assert short > long


def test_empty_and_wordless_tables(spark):
    docs, _ = documents(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.filter("trim(text) = '' or text is null")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_reruns_agree_without_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 else 7, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 60)))), "abc"[i % 3 % 2]) for i in range(2000)]
    rows += [(None, "one and the same text", "b")] * 800  # some of these equal rows are taken
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.mix(docs).collect()))
    assert len(want) == len(rows)
    for parts in (3, 11):
        assert sorted(map(repr, mixing.mix(docs.repartition(parts)).collect())) == want


def test_equal_rows_at_the_cut_are_taken_in_part(spark):
    rows = [(None, "w w w", "a")] * 300 + [(i, "v " * 5, "b") for i in range(100)] + [(1000 + i, "u " * 7, "c") for i in range(90)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    for words in (3, 5, 7):
        own = [r for r in got if r.size == words]
        assert abs(sum(r.taken for r in own) - own[0].target) <= words
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


@pytest.mark.parametrize("share", [0.001, 0.5])
def test_few_documents_are_put_in_order(spark, share):
    """Whatever the inclusion probability, nearly all are taken or left by the histograms alone."""
    rows = spark.range(200_000).selectExpr("id as doc_id", "'s' as source", "1L + id % 5 as size", f"cast({share} * 600000 as double) as missing", "(hash(id) & 2147483647) / 2147483648D as u")
    p = share * 1.0
    drawn = rows.selectExpr("doc_id", "source", "size", "missing", f"(u / (1 - u)) / ({p} / (1 - {p})) as odds")
    seen = []
    keep = mixing.stored
    mixing.stored = lambda df: seen.append(df) or keep(df)
    try:
        (cut,) = mixing._cuts(drawn).collect()
    finally:
        mixing.stored = keep
    assert seen[1].count() <= 1000 and seen[3].count() <= 10
    order = sorted(drawn.collect(), key=lambda r: (r.odds, r.size, r.doc_id))
    sums = np.cumsum([r.size for r in order])
    want = next(i for i, r in enumerate(order) if 2 * sums[i] - r.size > 2 * r.missing)
    assert (cut._cut.odds, cut._cut.doc_id, cut._k, cut._n) == (order[want].odds, order[want].doc_id, 0, 1)


def test_clashing_names_are_kept(spark):
    names = ("u", "odds", "class", "size", "row", "_source", "_cut", "copies", "part", "_copy", "_copies", "_id", "a.b")
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3], *[i] * len(names)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string" + "".join(f", `{n}` int" for n in names))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(r[n] == r.doc_id for r in got for n in names)
