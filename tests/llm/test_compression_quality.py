import zlib

import numpy as np
import pytest

from trawl.llm import compression_quality as cq
from trawl.llm.labelled import fit

WORDS = ["river", "stone", "window", "garden", "letter", "morning", "quiet", "paper", "light", "house", "under", "water"]


def documents(spark, n=300):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = rng.choice(WORDS, 120)
        text = " ".join(words) + "." if good else "".join(w.upper() + "!!## " for w in words)
        rows.append((i, text, "en", 0.5))
        labels.append((i, int(good), 0))
    rows += [(n, None, None, None), (n + 1, "", "en", 1.0), (0, rows[0][1], "en", 0.5), (None, rows[1][1], "en", 0.5), (n + 2, rows[1][1] * 200, "en", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels, rows = documents(spark)
    got = cq.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held) and len(held) > 60
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (300, 301)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert cq.classify(docs.limit(0), labels).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = documents(spark)
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert cq.train(docs, labels) .good == cq.train(docs, other).good


def test_without_labels(spark):
    docs, labels, _ = documents(spark, 8)
    assert {r.score for r in cq.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_fit_recovers_a_line():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    p = fit(x, y, np.ones(4000)).probability(x)
    assert abs(p.mean() - y.mean()) < 0.01 and np.corrcoef(p, 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1]))))[0, 1] > 0.99


def test_scores_are_those_computed_by_hand(spark):
    """Sizes by zstandard itself and the logistic by hand, for given dictionaries and weights."""
    import zstandard

    good, bad = b"the river runs past the old mill and the quiet fields " * 20, b"buy now $$$ click here free offer !!! " * 20
    calibration = cq.Logistic(np.array([0.1, 0.4]), np.array([0.2, 0.3]), np.array([-2.0, 0.5, 0.25]))
    texts = [None, "", "the river runs", "buy now $$$ click " * 9, "the quiet fields " * 40_000, "é漢" * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class int")
    got = {r.doc_id: r.score for r in cq.with_score(docs, cq.Model(good, bad, calibration)).collect()}
    for i, text in enumerate(texts):
        body = (text or "").encode()
        sizes = []
        for content in (good, bad):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(body[k : k + 2048])) for k in range(0, max(1, len(body)), 2048)))
        x = (sizes[0] - sizes[1]) / sum(sizes), sizes[0] / (len(body) + 16)
        z = -2.0 * (x[0] - 0.1) / 0.2 + 0.5 * (x[1] - 0.4) / 0.3 + 0.25
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
