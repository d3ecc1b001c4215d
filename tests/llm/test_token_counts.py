import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trawl.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CLASSES = tc.character_classes()
PIECES = [*"abstmdrvleXY  '' \n\t\r12,.!?éßñ中́ ²Ωс<", "<|endoftext|>", "'re", "'ll", "'ve", " '", "the ", "ing", "\x1c", "\x00"]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=60).map("".join) | st.text(max_size=80), max_size=8))
def test_counts_are_the_library_s(texts):
    counter, classes = tc.compiled(PATH)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert tc.counts(texts, counter, classes) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=300).map("".join))
def test_scanner_is_the_pattern(text):
    text = text.replace("\0", "")
    kinds = CLASSES[np.array([*map(ord, text), 0], np.uint32)]
    kinds[-1] = tc.CLASSES.index("end")
    assert tc.starts(kinds)[:-1].tolist() == [m.start() for m in PATTERN.finditer(text)]


def test_prefix_maps_compose_in_order():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 5, (37, 5))
    state = np.arange(5)
    for got, one in zip(tc.prefix_maps(maps), maps, strict=True):
        state = one[state]
        assert got.tolist() == state.tolist()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab " * 30_000, " " * 9_999, "é" * 5_000, "1" * 3_000 + "x"])
def test_long_runs(text):
    counter, classes = tc.compiled(PATH)
    assert tc.counts([text], counter, classes) == library([text])


def test_query_columns_nulls_and_repeats(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello there, it's 42  \n", "c"), (3, "Hello there, it's 42  \n", "c"), (None, "word " * 600, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tc.count_tokens(docs, PATH)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t, _), n in zip(rows, library([r[1] or "" for r in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
