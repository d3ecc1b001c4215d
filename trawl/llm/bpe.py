"""Byte-pair merges compiled to a deterministic transducer.

Read a word symbol by symbol. After each symbol the state is the last token of the encoding so far: the
longest vocabulary entry that ends there and may follow the last token of what precedes it. An automaton
over the vocabulary names the entries that end at each place; whether two tokens may stand side by side
follows from the merges, and is kept once found.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: Symbols are numbers below 1 << SHIFT.
SHIFT = 9


def byte_symbols() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Tokens are numbered by the rank of the merge that makes them, single symbols before all merges."""

    def __init__(self, symbols: int, merges: Iterable[tuple[tuple[int, ...], tuple[int, ...]]]):
        self.symbols = symbols
        self.rank: dict[tuple[int, ...], int] = {(s,): s for s in range(symbols)}
        self.halves: list[tuple[int, int]] = [(s, s) for s in range(symbols)]
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        for left, right in merges:
            a, b = self.rank[left], self.rank[right]
            joined = left + right
            if joined not in self.rank:
                self.rank[joined] = len(self.halves)
                self.halves.append((a, b))
            self.merged.setdefault((a, b), self.rank[joined])
        self.step: dict[int, int] = {}  # compiled when a word is first read

    def _compile(self) -> None:
        """The automaton whose state after each symbol is the longest end of the input that begins a token.

        ``ends`` has for each state the tokens that end there, longest first; ``step`` its transitions by
        state and symbol, of which those that fall back are added when they are first taken. Tokens that
        their own merges never make are left out.
        """
        step: dict[int, int] = {}
        ends: list[tuple[tuple[int, int], ...]] = [()]
        own: dict[int, tuple[int, int]] = {}
        made = [True] * len(self.halves)
        for token, rank in self.rank.items():
            node = 0
            for symbol in token:
                key = node << SHIFT | symbol
                if (after := step.get(key)) is None:
                    after = step[key] = len(ends)
                    ends.append(())
                node = after
            if rank >= self.symbols:
                a, b = self.halves[rank]
                made[rank] = made[a] and made[b] and self._apart(a, b, rank)
            if made[rank]:
                own[node] = (len(token), rank)
        fall = [0] * len(ends)
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in step.items():
            below[key >> SHIFT].append((key & ((1 << SHIFT) - 1), node))
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for symbol, node in below[parent]:
                    back = fall[parent]
                    while parent and back and (back << SHIFT | symbol) not in step:
                        back = fall[back]
                    fall[node] = step.get(back << SHIFT | symbol, 0) if parent else 0
                    ends[node] = ((own[node],) if node in own else ()) + ends[fall[node]]
                    deeper.append(node)
            level = deeper
        self.step, self.fall, self.ends, self.least = step, fall, ends, len(step)

    def _fall_back(self, node: int, symbol: int) -> int:
        if len(self.step) > self.least + 300_000:  # forget what was added
            self.step = dict(list(self.step.items())[: self.least])
        key = node << SHIFT | symbol
        while node and (node << SHIFT | symbol) not in self.step:
            node = self.fall[node]
        self.step[key] = found = self.step.get(node << SHIFT | symbol, 0)
        return found

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the border of two tokens comes before those inside them, or before ``before``."""
        a, b = left, right
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                return False
            # Undo the later of the two tokens' merges, and look at the border again.
            if a > b:  # of equal tokens the right one is made later
                if a < self.symbols:
                    return True
                before, a = a, self.halves[a][1]
            else:
                if b < self.symbols:
                    return True
                before, b = b + 1, self.halves[b][0]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' symbols is these two tokens."""
        if len(self.pairs) > 600_000:
            self.pairs.clear()
        self.pairs[left << 20 | right] = answer = self._apart(left, right, len(self.halves))
        return answer

    def read(self, word: Sequence[int]) -> tuple[list[int], list[int]]:
        """After each symbol (and before the first): the last token, and the number of tokens emitted."""
        if not self.step:
            self._compile()
        pairs, ends, node = self.pairs, self.ends, 0
        last, count = [-1], [0]
        for end, symbol in enumerate(word, 1):
            after = self.step.get(node << SHIFT | symbol)
            node = self._fall_back(node, symbol) if after is None else after
            for size, token in ends[node]:
                begin = end - size
                if begin:
                    left = last[begin]
                    fits = pairs.get(left << 20 | token)
                    if fits is None:
                        fits = self.adjacent(left, token)
                    if not fits:
                        continue
                last.append(token)
                count.append(count[begin] + 1)
                break
        return last, count


class Lockstep:
    """The same encoding for many short words at once: words of one length make one merge each per step.

    ``merged`` pairs lie in an open hash table of arrays, so a step is a few array operations.
    """

    BITS = 19
    NONE = 1 << 30

    def __init__(self, merges: Merges):
        assert len(merges.halves) == merges.symbols + len(merges.merged), "a token has several merges"
        keys = np.array([a << 20 | b for a, b in merges.merged], np.int64)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, self.NONE, np.int32)
        values, place, left = np.array(list(merges.merged.values()), np.int32), self._hash(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[place[left]] < 0
            _, first = np.unique(place[left[free]], return_index=True)
            put = left[free][first]
            self.keys[place[put]], self.values[place[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            place[left] = (place[left] + 1) & ((1 << self.BITS) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, NONE if no merge joins it."""
        keys = left.astype(np.int64) << 20 | right
        place = self._hash(keys)
        found = np.where(self.keys[place] == keys, self.values[place], np.int32(self.NONE))
        open_ = np.flatnonzero((found == self.NONE) & (self.keys[place] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << self.BITS) - 1)
            hit = self.keys[place[open_]] == keys[open_]
            found[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (self.keys[place[open_]] >= 0)]
        return found

    def encode(self, words: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """For words of one length (rows of symbols): which rows are finished, and their tokens."""
        rows, tokens = np.arange(len(words)), words.astype(np.int32)
        pairs = self.ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(words), -1)
        while pairs.shape[1] and len(rows):
            at = pairs.argmin(axis=1)
            best = pairs[np.arange(len(rows)), at]
            done = best == self.NONE
            if done.any():
                yield rows[done], tokens[done]
                go = ~done
                rows, tokens, pairs, at, best = rows[go], tokens[go], pairs[go], at[go], best[go]
            each, width = np.arange(len(rows)), pairs.shape[1]
            tokens[each, at] = best
            keep = np.ones(tokens.shape, bool)
            keep[each, at + 1] = False
            tokens = tokens[keep].reshape(len(rows), width)
            keep = np.ones(pairs.shape, bool)
            keep[each, at] = False
            pairs = pairs[keep].reshape(len(rows), width - 1)
            for move in (-1, 0):  # the new token's neighbours
                own = np.flatnonzero((at + move >= 0) & (at + move < width - 1))
                left = at[own] + move
                pairs[own, left] = self.ranks(tokens[own, left], tokens[own, left + 1])
        if len(rows):
            yield rows, tokens
