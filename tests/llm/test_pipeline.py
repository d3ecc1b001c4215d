import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from trawl.llm import compression_quality, mixing, toxicity
from trawl.llm.queries import correct_words

DIR = "/root/testdata/sf0.001"


def grams(text):
    """The five-word shingles of a text, in lower case."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_is_its_stages_by_hand(spark):
    """Each stage against plain Python over its own input."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, passed = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        passed[name] = docs
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    start = passed["toxicity"]
    model = toxicity.train(start, labels, known=correct_words())
    scorer = toxicity.Scorer(model.words, model.stems, model.correct)
    clean = [r for r in start.collect() if model.calibration.probability(np.array([scorer.features(r.text)]))[0] < 0.5]
    assert ids(passed["quality classifier"]) == sorted(r.doc_id for r in clean)

    model = compression_quality.train(passed["quality classifier"], labels)
    tools = compression_quality.Compressors(model.good, model.bad)
    good = [r for r in clean if model.calibration.probability(np.array([tools.features(r.text)]))[0] >= 0.5]
    assert ids(passed["SimHash near-dedup"]) == sorted(r.doc_id for r in good)

    sets = {r.doc_id: grams(r.text) for r in good}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    assert ids(passed["mixing"]) == sorted({*label.values()})

    copies = {r.doc_id: r.copies for r in mixing.mix(passed["mixing"]).collect()}
    assert Counter(ids(docs)) == Counter({i: n for i, n in copies.items() if n})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, DIR).collect()
    want = Counter()
    for r in docs.collect():
        tokens = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(tokens), 4096)):
            part = tokens[at : at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(p)[:5] for p in pieces) == want
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append((p.offset, p.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and sum(n for _, n in places) <= 4096


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0
        if docs.columns[-1] == "offset":
            break
        docs = spark.createDataFrame([], docs.schema)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A b c d e f g", "en", "s", 13), (3, None, None, None, None), (None, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, DIR)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None]
    assert corpus_pipeline.mixed(spark, docs, DIR).columns == docs.columns


def test_an_id_with_several_texts_loses_none(spark):
    a, b = "words that are near nothing else here at all", "quite another text with many words of its own"
    rows = [(i, t, "en", "s", 5) for i, t in ((3, b), (5, b), (5, a), (5, a), (7, a), (9, b.upper()))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.one_of_each_group(spark, docs, DIR)
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, b), (5, a)]


def test_columns_of_any_name(spark):
    names = ("score", "_pipeline_score", "_copy", "_id", "_copies", "row", "node", "fp", "class", "u")
    rows = [(i, f"some words number {i} of text " * (1 + i % 4), "en", "ab"[i % 2], 5, *[-i] * len(names)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.columns == docs.columns
        assert all(r[n] == -r.doc_id for r in kept.collect() for n in names)
