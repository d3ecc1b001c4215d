import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import toxicity as tx

TERMS = ("idiot", "moron", "clown", "scum", "worthless", "disgusting")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word, stems):
    if word in TERMS or any(word.startswith(s) for s in stems):
        return 1
    return 2 if any(distance(word, t) <= tx.edits(t) for t in TERMS) else 0


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 11), st.sampled_from(["", "a", "xi", "o"]), st.booleans()), max_size=3))
def test_automaton_is_the_edit_distance(term, changes):
    word = term
    for at, put, cut in changes:
        word = word[:at] + put + word[at + cut :]
    assert AUTOMATON.match(word) == brute(word, ("idio", "veju"))


AUTOMATON = tx.Automaton(TERMS, ("idio", "veju"))


def test_words_of_many_kinds():
    for word in ["", "m0ron", "mroon", "wortless", "worthles", "disgustin", "dlsgustlng", "scums", "scun", "clowns", "vejutas", "vej", "idiots", "x" * 500]:
        assert AUTOMATON.match(word) == brute(word, ("idio", "veju")), word


def test_quotation_is_told_from_abuse():
    scorer = tx.Scorer(TERMS, ())
    assert scorer.features('the word "idiot" was used')[0] == 0 and scorer.features('the word "idiot" was used')[2] > 0
    assert scorer.features("she said «you moron» to them")[2] > 0
    assert scorer.features("you are an idiot and that is that")[0] > 0
    assert scorer.features("you are an idiot")[3] > 0
    assert scorer.features("what a m0ron!!")[1] > 0
    assert scorer.features(None) == scorer.features("") == scorer.features("nothing here") == [0.0] * 6


def documents(spark, n=400):
    rng = np.random.default_rng(4)
    filler = ["".join(rng.choice(list("aeioubcdmnrst"), 7)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(filler, 80))
        if i % 4 == 0:
            for _ in range(3):
                word = str(rng.choice(["idiot", "m0ron", f"grum{rng.choice(['ab', 'ec', 'id', 'of', 'ug'])}", "zorbles"]))
                words.insert(int(rng.integers(len(words))), word)
        rows.append((i, " ".join(words), None, "x"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(n, None, None, None), (n + 1, "", None, None), (n + 2, "fine words " * 20000 + "idiot moron idiot", None, None), (0, rows[0][1], None, None), (None, rows[1][1], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels, rows = documents(spark)
    got = tx.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 50
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (400, 401)}) == 1
    assert tx.classify(docs.limit(0), labels).count() == 0


def test_terms_are_learnt(spark):
    docs, labels, _ = documents(spark)
    model = tx.train(docs, labels)
    assert "zorbles" in model.words and any(s.startswith("grum") for s in model.stems)
    assert {r.score for r in tx.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_misspelled_stems_are_hits():
    stems = ("zorble", "quimpandor")
    automaton = tx.Automaton(TERMS, stems)
    for word in ["zorblexa", "zoorblexa", "zrblexa", "zorvlexa", "zrvlexa", "quimpandorix", "quimpndorix", "qimpndorix", "qmpndrix", "zorb", "moron", "m0ron"]:
        near = any(distance(word[:n], s) <= tx.edits(s) for s in stems for n in range(len(word) + 1))
        assert automaton.match(word) == (brute(word, stems) or 2 * near), word
    assert tx.Scorer(TERMS, stems).features("what a zrblexa day")[1] > 0


def test_misspelled_stems_in_held_out_texts(spark):
    rng = np.random.default_rng(8)
    filler = ["".join(rng.choice(list("aeioubcdmnrst"), 7)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(filler, 80))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        if i % 4 == 0:
            for _ in range(3):
                ending = str(rng.choice(["ab", "ec", "id", "of", "ug"]))
                words.insert(int(rng.integers(len(words))), ("grvmpel" if held or rng.random() < 0.3 else "grumpel") + ending)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    got = tx.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in got]) >= 0.95


def test_contexts_of_toxic_and_clean_texts_are_counted_alike():
    texts = [f"a{i} zorbles b{i}" for i in range(1000)]
    found = tx.Sample([*texts, *[f"c{i} {'zorbles' if i < 20 else 'fine'} d{i}" for i in range(1000)]], np.repeat([1, 0], 1000), np.ones(2000))
    assert "zorbles" in tx.learn_terms(found)[0]


def test_apostrophes_and_other_quotations_do_not_quote():
    scorer = tx.Scorer(TERMS, ())
    for text in ["don’t be such an idiot, you’re late", '"yes" he is an idiot "no"', "“yes” he is an idiot “no”", '5" of idiot and 6" of rain', "it`s an idiot in today`s world"]:
        got = scorer.features(text)
        assert got[0] + got[1] > 0 and got[2] == 0 and got[5] == 1, text
    for text in ["“don’t be an idiot” he wrote", "„du idiot“ war es", "» idiot « stand da", "« idiot » est un mot", "‘you’re an idiot’ it was", 'she said "a b c d e f g h i j idiot" then', '"yes" and "idiot" and "no"', "(“idiot”)"]:
        got = scorer.features(text)
        assert got[2] > 0 and got[0] == got[5] == 0, text


def test_correct_words_are_no_misspellings():
    words, stems = (*tx.INSULTS,), ("retar",)
    near = ["toward", "reward", "regard", "lower", "closer", "laser", "lover", "crown", "flown", "crash", "discussing"]
    plain = tx.Scorer(words, stems)
    assert all(plain.kind(w) == 2 for w in near)
    known = tx.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    scorer = tx.Scorer(words, stems, tx.correct_words(words, stems, known))
    assert not any(scorer.kind(w) for w in near)
    assert [scorer.kind(w) for w in ("id1ot", "idiiot", "stup1d", "mor0n", "disgustng", "cowrad", "idiot", "retar")] == [2, 2, 2, 2, 2, 0, 1, 1]


def test_words_of_clean_texts_are_correct():
    found = tx.correct_words(("vermin",), (), ["verein", "vermin", "vermun", "other"])
    assert found == {"verein", "vermun"}
