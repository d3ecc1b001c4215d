"""Token counts from a byte-level BPE vocabulary compiled to finite-state transducers.

Two deterministic transducers follow each other.

The *scanner* reads character classes and marks where pre-tokens begin (the pattern of byte-level BPE:
contractions, letters, numbers, other signs, white space). It has few states, so a piece of text is a map
from each state to the state after it, and maps compose associatively: a batch of texts is cut into short
chunks, all chunks' maps are computed together, a parallel prefix scan composes them into every chunk's
entry state, and a second pass over all chunks marks the starts.

The *counter* reads a pre-token's bytes. After each byte its state is the last token of the encoding so
far, and its transition carries the number of tokens emitted. The last token is the longest vocabulary
entry that ends there and may follow the last token of what precedes it; whether two tokens may stand
side by side is compiled from the merges and kept (see ``bpe``). Pre-tokens seen before are not read again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.bpe import Merges, byte_symbols
from trawl.llm.shared import small_batches

LIMIT = 512
CHUNK = 64
#: Pre-tokens remembered per generation; two generations are kept.
REMEMBERED = 300_000

# Character classes of the scanner, and its states.
CLASSES = ("end", "space", "white", "apostrophe", "number", "other", "letter", "stmd", "r", "v", "l", "e")
STATES = ("start", "space", "white", "run", "letters", "numbers", "others", "quote", "quote_r", "quote_v", "quote_l", "done")
LETTERS = ("letter", "stmd", "r", "v", "l", "e")
#: A pre-token begins at this character, at the one before, or (CLOSED) one ends with this character.
HERE, BEFORE = 1, 2


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by state and class.

    "space" has read one space, "white" one other white character and "run" two or more; "quote" an
    apostrophe that begins a pre-token, and "quote_r" that and an r; after "done", a whole contraction has
    been read, so whatever follows begins a pre-token.
    """
    to = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    marks = np.zeros_like(to)
    fresh = {"space": "space", "white": "white", "apostrophe": "quote", "number": "numbers", "other": "others", "end": "start"} | dict.fromkeys(LETTERS, "letters")
    kind = {"letters": LETTERS, "numbers": ("number",), "others": ("other", "apostrophe")}

    def put(state: str, of: str, then: str, mark: int) -> None:
        to[STATES.index(state), CLASSES.index(of)] = STATES.index(then)
        marks[STATES.index(state), CLASSES.index(of)] = mark

    for of in CLASSES:
        home = next((k for k, own in kind.items() if of in own), None)
        for state in ("start", "done"):
            put(state, of, fresh[of], HERE)
        for state in kind:
            put(state, of, state if of in kind[state] else fresh[of], 0 if of in kind[state] else HERE)
        # One white character: a space joins what follows it, others stand alone unless more white follows.
        put("space", of, home or ("run" if of in ("space", "white") else "start"), 0 if home or of != "end" else HERE)
        put("white", of, "run" if of in ("space", "white") else fresh[of], 0 if of in ("space", "white") else HERE)
        # In a run the last white character stands apart from those before it, if something follows.
        put("quote", of, {"stmd": "done", "r": "quote_r", "v": "quote_v", "l": "quote_l"}.get(of) or ("others" if home == "others" else fresh[of]), 0 if of in ("stmd", "r", "v", "l") or home == "others" else HERE)
        for state, second in (("quote_r", "e"), ("quote_v", "e"), ("quote_l", "l")):
            # Without its second letter the apostrophe stood alone and the letter began a pre-token.
            if of == second:
                put(state, of, "done", 0)
            else:
                put(state, of, "letters" if of in LETTERS else fresh[of], BEFORE | (0 if of in LETTERS else HERE))
    return to, marks


TO, MARKS = _scanner()
#: Runs of white space depend on what their last character was, so a run keeps it apart: two states.
RUN_SPACE, RUN_WHITE = STATES.index("run"), len(STATES)


def _with_runs() -> tuple[np.ndarray, np.ndarray]:
    to, marks = np.vstack([TO, np.zeros((1, len(CLASSES)), np.uint8)]), np.vstack([MARKS, np.zeros((1, len(CLASSES)), np.uint8)])
    at = {c: k for k, c in enumerate(CLASSES)}
    for state in (STATES.index("space"), STATES.index("white"), RUN_SPACE, RUN_WHITE):
        to[state, at["space"]], to[state, at["white"]] = RUN_SPACE, RUN_WHITE
    for of in CLASSES:
        if of in ("space", "white"):
            continue
        if of == "end":
            to[[RUN_SPACE, RUN_WHITE], at[of]], marks[[RUN_SPACE, RUN_WHITE], at[of]] = 0, HERE
            continue
        # The last space goes with what follows it; another white character is a pre-token of its own.
        to[RUN_SPACE, at[of]], marks[RUN_SPACE, at[of]] = to[STATES.index("space"), at[of]], BEFORE
        to[RUN_WHITE, at[of]], marks[RUN_WHITE, at[of]] = to[STATES.index("start"), at[of]], BEFORE | HERE
    return to, marks


TO, MARKS = _with_runs()


def character_classes() -> np.ndarray:
    """The class of every code point."""
    found = np.full(0x110000, CLASSES.index("other"), np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, pattern in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("white", r"\s")):
        found[[ord(c) for c in regex.findall(pattern, every)]] = CLASSES.index(name)
    found[0x1C:0x20] = CLASSES.index("other")  # white for Python, not for Unicode
    for name, own in (("space", " "), ("apostrophe", "'"), ("stmd", "stmd"), ("r", "r"), ("v", "v"), ("l", "l"), ("e", "e")):
        found[[ord(c) for c in own]] = CLASSES.index(name)
    return found


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Maps (rows) that apply ``first`` and then ``second``."""
    return np.take_along_axis(second, first, axis=1)


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of maps 0 to i, by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step].copy(), out[step:])
        step *= 2
    return out


def starts(classes: np.ndarray) -> np.ndarray:
    """Sorted positions where pre-tokens begin, for classes of texts that each end with "end"."""
    n, width = len(classes), len(CLASSES)
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.uint8)  # the padding is "end"
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat_to, flat_marks = TO.ravel(), MARKS.ravel()
    maps = np.tile(np.arange(len(TO), dtype=np.uint8), (rows, 1))
    for column in grid:
        maps = flat_to[maps.astype(np.int16) * width + column[:, None]]
    state = np.zeros(rows, np.uint8)
    state[1:] = prefix_maps(maps.astype(np.int64))[:-1, 0]
    marks = np.empty((CHUNK, rows), np.uint8)
    for k, column in enumerate(grid):
        at = state.astype(np.int16) * width + column
        marks[k], state = flat_marks[at], flat_to[at]
    marks = marks.T.ravel()[:n]
    begins = (marks & HERE) > 0
    begins[:-1] |= (marks[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


class Counter:
    """The counting transducer of a byte-level BPE vocabulary (a tokenizers .json file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = byte_symbols()
        decode = lambda token: tuple(byte_of[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(256, ((decode(a), decode(b)) for a, b in merges))
        assert len(self.merges.halves) == len(spec["model"]["vocab"]), "the vocabulary has tokens that no merge makes"
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def emitted(self, word: bytes) -> list[int]:
        """Tokens in the encoding of each prefix of ``word``, from the empty one."""
        return self.merges.read(word)[1]

    def count(self, word: str) -> int:
        n = self.young.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                n = self.emitted(word.encode("utf-8", "surrogatepass"))[-1]
            if len(word) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = n
        return n


def counts(texts: list[str], counter: Counter, classes: np.ndarray) -> list[int]:
    """Tokens of each text."""
    if not texts:
        return []
    total = [0] * len(texts)
    parts: list[str] = []
    owner: list[int] = []
    cut = re.compile("|".join(map(re.escape, counter.special))) if counter.special else None
    for k, text in enumerate(texts):
        pieces = [text]
        if cut and any(s in text for s in counter.special):
            pieces = cut.split(text)
            total[k] += len(pieces) - 1  # each special string is one token
        parts += pieces
        owner += [k] * len(pieces)
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes[points]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds[ends] = CLASSES.index("end")
    begins = starts(kinds)
    seen = counter.young.get
    at = begins.tolist()
    words = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)], strict=True)]
    per_word = list(map(seen, words))
    missing = [i for i, n in enumerate(per_word) if n is None]
    for i in missing:
        per_word[i] = counter.count(words[i])
    # "end" itself begins a pre-token, which counts for nothing.
    numbers = np.array(per_word, np.int64)
    numbers[kinds[begins] == CLASSES.index("end")] = 0
    sums = np.bincount(np.searchsorted(ends, begins), weights=numbers, minlength=len(parts))
    for k, n in zip(owner, sums, strict=True):
        total[k] += int(n)
    return total


_compiled: dict[str, tuple[Counter, np.ndarray]] = {}


def compiled(path: str) -> tuple[Counter, np.ndarray]:
    """The transducers for a vocabulary file, compiled once in each Python worker."""
    if path not in _compiled:
        _compiled[path] = Counter(path), character_classes()
    return _compiled[path]


def count_tokens(documents: DataFrame, path: str | Callable[[], str], doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each document.

    ``path`` is the vocabulary's file, or a function that each worker calls to find it. Null texts count as
    empty and have no tokens; repeated rows are counted each; an empty table gives an empty one.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, classes = compiled(path() if callable(path) else path)
        for batch in small_batches(batches, most=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = counts(texts, counter, classes)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
