"""Toxicity scores from a lexicon whose misspellings are caught by Levenshtein automata.

The lexicon is a trie of whole words and of stems that take any ending: a short fixed list, and what the
labelled sample adds. The Levenshtein automata of all its terms are intersected with the trie at once: a
state is a set of (trie node, edits spent), made deterministic as words are read, so most words end in the
empty state after a few characters. A near miss that is a correct word itself, by a vocabulary or by the clean texts of the
sample, is no misspelling. Each hit is then judged in a window of words around it, which tells
quotation and report from abuse, and a document's counts of hits by kind are calibrated to a probability.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trawl.llm.labelled import Logistic, Sample, fit, remainder, sample
from trawl.llm.shared import frugal, small_batches

#: The labelled sample: texts of each label, and characters of a text.
PER_CLASS, MOST_CHARS = 2000, 20_000
#: Rows whose crc32(doc_id) has remainder HELD_OUT modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 5, 0
#: Words before and after a hit that are looked at.
REACH = 6
#: A learnt term occurs LIFT times as often in toxic texts, and in so many different contexts (of toxic texts, this share
#: at least); a stem also has so many endings, and occurs in no other text.
LIFT, CONTEXTS, SHARE, ENDINGS = 25.0, 4, 0.02, 4
STEM_LENGTHS = range(4, 11)
REMEMBERED = 100_000

# Common insults, signs and words of quotation, and words of address.
INSULTS = (
    "bastard", "clown", "coward", "cretin", "disgusting", "dumbass", "fool", "idiot", "imbecile", "loser", "lowlife", "moron",
    "pathetic", "pig", "retard", "scum", "scumbag", "stupid", "trash", "vermin", "worthless",
)
#: Endings that an insult takes and stays one.
ENDINGS_OF_INSULTS = ("s", "es", "'s")
#: Signs of quotation, and those that close each.
CLOSED_BY = {'"': '"', "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«»", "‘": "’", "’": "’", "`": "`’"}
SIGNS = frozenset(CLOSED_BY)
REPORTS = ("called", "calls", "phrase", "quote", "quoted", "quotes", "reported", "said", "saying", "says", "term", "word", "wrote")
ADDRESS = ("du", "dich", "te", "toi", "tu", "usted", "vous", "you", "your", "youre", "you're", "ur")


def edits(term: str) -> int:
    """Misspellings allowed: none in short terms, which are near too many words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of a trie of terms with their Levenshtein automata, made deterministic as it runs."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]  # the most edits of any term below a node
        self.ends: dict[int, int] = {}  # node: edits of the word that ends there
        self.stems: dict[int, int] = {}  # node: edits of the stem that ends there
        for term, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            allowed, node = edits(term), 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                after = self.children[node].get(c)
                if after is None:
                    after = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = after
                self.budget[node] = max(self.budget[node], allowed)
            if stem:
                self.stems[node] = allowed
            else:
                self.ends[node] = allowed
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.begun: list[bool] = []  # whether a stem ends in a set
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.first = self._state({(0, 0)})

    def _state(self, some: set[tuple[int, int]]) -> int:
        """The number of a set, closed under leaving out letters of a term; -1 if it is empty."""
        todo, best = list(some), {}
        while todo:
            node, spent = todo.pop()
            if spent > self.budget[node] or best.get(node, 9) <= spent:
                continue
            best[node] = spent
            todo += [(child, spent + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.begun.append(any(self.stems.get(node, -1) >= spent for node, spent in key))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, spent in self.sets[state]:
            after.add((node, spent + 1))  # a letter too many
            for label, child in self.children[node].items():
                after.add((child, spent + (label != c)))
        if len(self.steps) > 500_000:
            self.steps.clear()
        self.steps[state, c] = found = self._state(after)
        return found

    def match(self, word: str) -> int:
        """0: no term; 1: a term or stem as it is; 2: a term misspelled."""
        state, steps = self.first, self.steps
        exact = 0  # the trie node that the letters so far spell
        begun = False  # whether the letters so far end a misspelled stem
        for c in word:
            exact = self.children[exact].get(c, -1) if exact >= 0 else -1
            if exact in self.stems:
                return 1
            after = steps.get((state, c))
            state = self._step(state, c) if after is None else after
            if state < 0:
                return 2 if begun else 0
            begun = begun or self.begun[state]
        if exact in self.ends:
            return 1
        return 2 if begun or any(self.ends.get(node, -1) >= spent for node, spent in self.sets[state]) else 0


def plain(word: str) -> str:
    """A lower-case word without the signs around it."""
    return word.strip("\"“”„«»‘’`'.,;:!?()[]{}<>#*$%&|_-~/\\…")


class Scorer:
    """Counts of hits in texts, with the words met so far remembered."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...], correct: frozenset[str] = frozenset()):
        self.automaton = Automaton(words, stems)
        self.correct = correct
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def kind(self, word: str) -> int:
        found = self.old.get(word)
        if found is None:
            found = self.automaton.match(plain(word))
            if found == 2 and plain(word) in self.correct:
                found = 0
        if len(word) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        """Hits as they are, misspelled, quoted, and near a word of address; hits among all words; any hit that is not quoted."""
        words = (text or "").lower().split()
        kinds = list(map(self.young.get, words))
        if None in kinds:
            kinds = [self.kind(w) if k is None else k for w, k in zip(words, kinds, strict=True)]
        if not any(kinds):
            return [0.0] * 6
        straight = misspelled = quoted = addressed = 0
        both, one, reported = quoted_words(words)
        for at in np.flatnonzero(kinds):
            before, after = words[max(0, at - REACH) : at], words[at + 1 : at + 1 + REACH]
            if both[at] or (one[at] and (reported[at] or any(plain(w) in REPORTS for w in before))):
                quoted += 1
                continue
            straight += kinds[at] == 1
            misspelled += kinds[at] == 2
            addressed += any(plain(w) in ADDRESS for w in (*before, *after))
        return [np.log1p(straight), np.log1p(misspelled), np.log1p(quoted), np.log1p(addressed), np.log1p(1000 * (straight + misspelled) / len(words)), float(straight + misspelled > 0)]


def quotations(words: list[str]) -> list[tuple[int, int]]:
    """Pairs of an opening sign of quotation and the one that closes it, as the places of their words.

    Signs between letters are apostrophes. A sign before a word opens, one after a word closes, and one alone closes if
    it can. A sign that opens again what is open begins anew.
    """
    opened: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for at, word in enumerate(words):
        if SIGNS.isdisjoint(word):
            continue
        letters = [k for k, c in enumerate(word) if c.isalnum()]
        for k, c in enumerate(word):
            if c not in SIGNS or (letters and letters[0] < k < letters[-1]):
                continue
            before = bool(letters) and k < letters[0]
            partner = next((n for n in range(len(opened) - 1, -1, -1) if c in CLOSED_BY[opened[n][0]]), -1)
            if partner >= 0 and not before:
                pairs.append((opened[partner][1], at))
                del opened[partner:]
            elif c in CLOSED_BY and (before or (not letters and c != "’")):
                opened = [(sign, n) for sign, n in opened if sign != c]
                opened.append((c, at))
    return pairs


def quoted_words(words: list[str]) -> tuple[bytearray, bytearray, bytearray]:
    """Flags of the words with both signs of one quotation within REACH, of those in a quotation with one of them, and of
    those in a quotation that a word of report introduces or follows."""
    both, one, reported = (bytearray(len(words)) for _ in range(3))
    for start, end in quotations(words):
        around = (*words[max(0, start - REACH) : start], *words[end + 1 : end + 1 + REACH])
        told = any(plain(w) in REPORTS for w in around)
        for at in range(max(start, end - REACH), min(end, start + REACH) + 1):
            both[at] = 1
        for at in (*range(start, min(end, start + REACH) + 1), *range(max(start, end - REACH), end + 1)):
            one[at] = 1
            reported[at] |= told
    return both, one, reported


@dataclass
class Model:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    calibration: Logistic
    #: Words near a term that are no misspellings of it.
    correct: frozenset[str] = frozenset()


def learn_terms(found: Sample) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and stems that mark the toxic texts of the sample.

    A term counts once for each pair of neighbours, so that copies of one text count once.
    """
    total = np.maximum(np.bincount(found.labels, minlength=2), 1)
    least = max(CONTEXTS, SHARE * total[1])

    def words_of(label: int) -> Iterator[tuple[str, int]]:
        for text, own in zip(found.texts, found.labels, strict=True):
            if own == label:
                words = list(map(plain, text.lower().split()))
                for left, word, right in zip(["", *words], words, [*words[1:], ""], strict=False):
                    if len(word) >= STEM_LENGTHS[0]:
                        yield word, hash((left, right))

    toxic: dict[str, set[int]] = defaultdict(set)
    for word, context in words_of(1):
        toxic[word].add(context)
    of_stem, endings, longer = Counter(), Counter(), defaultdict(list)
    for word, own in toxic.items():
        for n in STEM_LENGTHS:
            if n < len(word):
                of_stem[word[:n]] += len(own)
                endings[word[:n]] += 1
    for stem in of_stem:
        longer[stem[:-1]].append(stem)
    clean = {w: set() for w, own in toxic.items() if len(own) >= least}
    candidates = {s for s, n in of_stem.items() if n >= least and endings[s] >= ENDINGS}
    for word, context in words_of(0):
        if word in clean:
            clean[word].add(context)
        for n in STEM_LENGTHS:
            if n < len(word):
                candidates.discard(word[:n])  # a stem occurs in no other text
    stems: set[str] = set()
    for stem in sorted(candidates, key=lambda s: (len(s), s)):
        if (of_stem[stem] + 0.5) / total[1] >= LIFT * 0.5 / total[0] and not any(stem[:n] in stems for n in STEM_LENGTHS):
            while more := [s for s in longer[stem] if of_stem[s] >= 0.98 * of_stem[stem] and endings[s] >= ENDINGS]:
                stem = more[0]  # as specific as covers the same
            stems.add(stem)
    words = [w for w, own in clean.items() if (len(toxic[w]) + 0.5) / total[1] >= LIFT * (len(own) + 0.5) / total[0]]
    words.sort(key=lambda w: (-len(toxic[w]), w))
    insults = {w + e for w in INSULTS for e in ("", *ENDINGS_OF_INSULTS)}
    return tuple(sorted({*words, *insults})), tuple(sorted(stems))


def correct_words(words: tuple[str, ...], stems: tuple[str, ...], known: Iterable[str]) -> frozenset[str]:
    """Those of the known words that the automata would take for misspellings."""
    match = Automaton(words, stems).match
    return frozenset(w for w in set(known) if len(w) >= 4 and match(w) == 2)


def vocabulary(path: str) -> list[str]:
    """The whole words of a public tokenizer's file whose words end with a mark."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    mark = model["end_of_word_suffix"]
    return [token.removesuffix(mark) for token in model["vocab"] if token.endswith(mark)]


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", known: Iterable[str] = ()) -> Model:
    """Learns from at most PER_CLASS texts of either label outside the held-out fold.

    Terms are learnt from every other text of the sample and calibrated on the rest, so a term that marks
    only the texts it was learnt from gains no weight. ``known`` are correct words, to which the words of the
    clean texts that terms are learnt from are added.
    """
    found = sample(documents, labels, label, remainder(F.col(doc_id), FOLDS) != HELD_OUT, PER_CLASS, MOST_CHARS, doc_id, text)
    first = np.concatenate([np.flatnonzero(found.labels == y)[0::2] for y in (0, 1)])
    second = np.concatenate([np.flatnonzero(found.labels == y)[1::2] for y in (0, 1)])
    words, stems = learn_terms(Sample([found.texts[k] for k in first], found.labels[first], found.weights[first]))
    clean = (plain(w) for k in first if found.labels[k] == 0 for w in found.texts[k].lower().split())
    correct = correct_words(words, stems, chain(known, clean))
    scorer = Scorer(words, stems, correct)
    features = np.array([scorer.features(found.texts[k]) for k in second]).reshape(-1, 6)
    return Model(words, stems, fit(features, found.labels[second], found.weights[second]), correct)


def with_score(documents: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the probability that a text is toxic; null texts are scored as empty ones."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.stems, model.correct)
        for batch in small_batches(batches, text):
            features = np.array([scorer.features(t) for t in batch.column(text).to_pylist()]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.calibration.probability(features))], [*batch.schema.names, score])

    return documents.mapInArrow(frugal(compute), StructType([*documents.schema.fields, StructField(score, DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", known: Iterable[str] = ()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document.

    Null ids are not held out; repeated rows score alike; null and empty texts have no hits; very long ones are
    scored whole; other columns, whatever their names, are left out; an empty table gives an empty one.
    """
    model = train(documents, labels, doc_id, text, known=known)
    scored = with_score(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
