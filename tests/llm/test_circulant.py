import numpy as np
import pytest

from trawl.llm import circulant

SCHEMA = "doc_id long, text string, node string, label string, size long"


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label = [min(label[i], label[j]) if k in (label[i], label[j]) else k for k in label]
    least = {c: min((r[0] for r, k in zip(rows, label) if k == c and r[0] is not None), default=None) for c in set(label)}
    return sorted(((r[0], len(s), least[c], r[0] == least[c]) for r, s, c in zip(rows, sets, label)), key=repr)


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
    short = ["", None, " \n\t", "one", "One two", "one\ttwo", texts[0].upper(), "a b c d", "a b c d e", "a b a b a b a b", "b a b a b a b a b", "Ünï ä ö Ä é", "ünï ä ö Ä é"]
    return list(enumerate([*texts, *short])) + [(None, texts[9]), (None, "z z"), (None, None), (3, texts[3]), (3, texts[30])]


def got(spark, rows):
    found = circulant.near_duplicates(spark.createDataFrame([(i, t, "x", "clash", 1) for i, t in rows], SCHEMA))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_equals_brute_force(spark):
    assert got(spark, rows_like()) == brute(rows_like())


@pytest.mark.parametrize("hot", [4000, 5])
def test_members_of_one_bucket_far_from_its_head(spark, monkeypatch, hot):
    """All texts in one bucket, dealt out in parts: the second round alone finds pairs that do not hold the head."""
    monkeypatch.setattr(circulant, "bands", lambda signature: np.ones(1, np.uint64))
    monkeypatch.setattr(circulant, "HOT", hot)
    monkeypatch.setattr(circulant, "HEADS", hot)
    monkeypatch.setattr(circulant, "SETS", 200 * hot)
    rows = rows_like()[::2]
    assert got(spark, rows) == brute(rows)


def test_a_family_just_below_the_bound_is_told_as_a_forest(spark, monkeypatch):
    """Copies that resemble one another by 0.7 or so: candidates all, links few; pairs are never told."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(120):
        own = list(base)
        for at in rng.choice(120, 4 + k % 3, replace=False):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    told = []
    plain = circulant.components
    monkeypatch.setattr(circulant, "components", lambda links: told.append(links.count()) or plain(links))
    assert got(spark, rows) == brute(rows)
    assert max(told) < 40 * len(rows)


def test_a_family_in_many_buckets_is_told_by_few_links(spark, monkeypatch):
    """Copies of one text are together in up to BANDS buckets: the links that components are made of grow with the copies, not with their buckets."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    told = {}
    for n in (100, 200):
        rows = []
        for k in range(n):
            own = list(base)
            for at in rng.choice(120, 4 + k % 3, replace=False):
                own[at] = f"x{k}y{at}"
            rows.append((k, " ".join(own)))
        with monkeypatch.context() as m:
            plain, counts = circulant.components, []
            m.setattr(circulant, "components", lambda links, counts=counts, plain=plain: counts.append(links.count()) or plain(links))
            assert got(spark, rows) == brute(rows)
        told[n] = max(counts)
    assert told[100] < 2 * 100 and told[200] < 2 * 200, told


def made_by_joins(spark, since):
    """[rows, description] of each join in the queries that Spark has run from number ``since`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for run in (runs.apply(k) for k in range(runs.size())):
        if run.executionId() < since:
            continue
        nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
        for n in (nodes.apply(k) for k in range(nodes.size())):
            metrics = [n.metrics().apply(k) for k in range(n.metrics().size())]
            for m in metrics if "Join" in n.name() else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found.append((int(values.apply(m.accumulatorId()).replace(",", "")), n.desc()))
    return found


def test_texts_alone_in_their_buckets_pass_no_join_on_buckets(spark):
    """What joins on buckets make follows the members of shared buckets, not every text's BANDS buckets, also beside a family of copies."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    rows = [(k, " ".join([*base[:60], f"x{k}", *base[61:]])) for k in range(40)]
    rows += [(100 + k, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60))) for k in range(600)]
    own = [circulant.bands(circulant.coordinates(circulant.shingles(circulant.words(t)))) for _, t in rows]
    _, counts = np.unique(np.concatenate(own), return_counts=True)
    shared = int(counts[counts > 1].sum())
    assert 40 * 10 < shared < circulant.BANDS * len(rows) / 10
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert got(spark, rows) == brute(rows)
    on_buckets = [n for n, desc in made_by_joins(spark, before) if "[band#" in desc]
    assert shared in on_buckets and max(on_buckets) <= shared, (shared, on_buckets)


def test_folding_links_keeps_their_components(spark):
    rng = np.random.default_rng(3)
    links = {(min(p), max(p)) for p in rng.integers(0, 300, (280, 2)).tolist() if p[0] != p[1]}
    to_bytes = lambda rows: spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in rows], "a binary, b binary")
    labels = lambda df: sorted((bytes(r["node"]), bytes(r["label"])) for r in circulant.components(df).collect())
    assert labels(circulant.folded(to_bytes(links))) == labels(to_bytes(links))


def test_a_pair_at_the_bound_and_very_long_texts(spark):
    base = [f"w{k}" for k in range(43)]  # 40 shingles; 36 + 4 of its own gives 36 / 44, 35 gives 35 / 45
    at, below = base[:39] + [f"x{k}" for k in range(4)], base[:38] + [f"y{k}" for k in range(5)]
    long = [f"l{k % 50_021}x" for k in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join(at)), (3, " ".join(below)), (7, " ".join(long)), (8, " ".join(long[:59_000])), (9, " ".join(long[30_000:]))]
    assert got(spark, rows) == brute(rows)


def test_an_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(5, None)]) == [(5, 0, 5, True)]


def test_permutations_are_permutations_and_coordinates_are_shifted():
    low = np.arange(1 << 20, dtype=np.uint32)
    assert len(np.unique(circulant.permuted(low.copy(), 0x85EBCA6B, 0xC2B2AE35))) == len(low)
    hashes = np.unique(np.random.default_rng(2).integers(0, 2**64, 3000, np.uint64))
    places = circulant.permuted((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    want = [int(circulant.permuted(places + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35).min()) for k in range(240)]
    assert circulant.coordinates(hashes).tolist() == want


def test_shared_coordinates_estimate_the_similarity():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        common = rng.integers(0, 2**64, int(n * share), np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**64, (n - len(common)) // 2, np.uint64)]) for _ in range(2))
        found = (circulant.coordinates(a) == circulant.coordinates(b)).mean()
        assert abs(found - share) < 0.12
