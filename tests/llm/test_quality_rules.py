import re
from collections import Counter

import pytest

from trawl.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def by_hand(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    plain = [" ".join(f"w{(i * 7 + k * k) % 97}" for k in range(30 + i % 11)) for i in range(60)]
    odd = [None, "", " \t\n\x0b", "a b  c", "x " * 40, "one two three four five six seven eight nine ten", "a b c\na b c\n\na b c\r\n", "# * $ %% && || <> <> ok ok2 a b c d", "é" * 50 + " ß 漢字 " + "q " * 9, plain[0], plain[0]]
    return plain + odd + [" ".join(f"u{k}" for k in range(1_000_000)), "same five words here again " * 200_000]


def test_base_measures_are_those_counted_by_hand(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", None)[i % 2]) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == by_hand(text)
        assert not (r.kept and r.base_failed)


def test_fences_follow_language_and_source(spark):
    rows = []
    for i in range(120):
        symbols = 3 if i % 3 == 0 else 0
        rows.append((i, " ".join(f"{'#' * symbols}w{(i * 31 + k) % 400}" for k in range(40)), "en", "code" if symbols else "news"))
    rows.append((1000, " ".join(f"###w{k}" for k in range(40)), "en", "news"))  # usual in code, not in news
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA), least_texts=20).collect()}
    assert got[0].kept and got[1].kept and not got[1000].kept and not got[1000].base_failed
    assert {r.fences_of for r in got.values()} == {"source"}
    assert {r.fences_of for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA), least_texts=100).collect()} == {"lang"}
    assert {r.fences_of for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA), least_texts=1000).collect()} == {"all"}


@pytest.mark.parametrize("names", [("n_words", "_words", "_lines", "row", "words", "lines"), ("KEPT", "s_lang", "_lang", "name", "bucket", "a.b")])
def test_clashing_names_and_repeated_rows(spark, names):
    rows = [(1, "a b c d e f g h i j k", "en", "s", *range(6)), (1, "a b c d e f g h i j k", "en", "s", *range(6)), (None, None, None, None, *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` int" for n in names))
    out = quality_rules.apply_rules(docs)
    own = [n for n in names if n.lower() not in quality_rules.RESULT]
    assert out.columns == ["doc_id", "lang", "source", *own, *quality_rules.RESULT]
    got = out.collect()
    assert len(got) == 3 and [r.n_words for r in got if r.doc_id] == [11, 11]
    assert all(r[n] == names.index(n) for r in got if r.doc_id for n in own)


def test_empty_table(spark):
    assert quality_rules.apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0
