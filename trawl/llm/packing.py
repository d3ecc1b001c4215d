"""Packing documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths (one count for each length) is planned on the driver, however many
pieces there are. The plan is a covering linear program over configurations, multisets of lengths that fit
a sequence: multiplicative weights raise the price of lengths that are covered less than others, a knapsack dynamic
program over the prices names, for every length, the best configuration that holds it, and the mean over the rounds
is the fractional answer. It is rounded down, what that leaves is a smaller program, and the last few pieces are
packed by best fit. In the end the sequences that rounding left with much room, and some of those with the smallest pieces, are
taken apart and packed anew by best fit, as many as it takes for the fewest in all.
Pieces are then ranked within their length by Spark, and each rank has its sequence and place in the plan.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.functions.memory import narrow_batches
from trawl.llm.bpe import Lockstep, Merges, byte_symbols
from trawl.llm.shared import frugal, small_batches, stored

CAPACITY = 4096
END = 1
#: Rounds of pricing, the step of the weights, and how sharply a round prefers configurations of the greatest worth.
ROUNDS, STEP, SHARPNESS = 30, 1.0, 20.0
#: Steps that settle the mean over the rounds.
SETTLED = 60
#: A rounding that takes less than one in TAKEN tokens, or leaves less than one in ENOUGH, is the last one.
TAKEN, ENOUGH = 20, 50
#: Pieces of at most this part of a sequence fill what the program's configurations leave free.
LOOSE = 16
#: Groups of lengths in a program.
GROUPS = 256
#: What repair tries: the room above which a sequence is taken apart, and the share of the others, those with the smallest pieces first.
ROOMS, SHARES = (0, 8, 32, CAPACITY), (0.0, 0.1, 0.2, 0.3, 0.5, 0.7)
#: Share of the parts of sequences that is taken before what is left becomes a program again, and the part of a sequence
#: that a configuration may leave free when small pieces cannot fill it.
PART, ALLOW = 1 / 3, 64
#: Among equally full configurations, those of fewer and longer pieces: short ones fill gaps later.
PREFER = 0.1
#: Pieces of one length that are ranked in one group.
RANKED = 2000
#: Rows that a worker is given at once, if they are no more than ``functions.memory`` allows in bytes.
ROWS = 10_000

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The vocabulary (a tokenizers .json file whose words end with a mark) drops white space and never joins
    across it, so words between ASCII white space are encoded apart, each distinct one of the texts at hand once. Nothing is
    kept from one call to the next: over batches of 2 MB that saves no time, and what workers keep counts against their executor. Words of ASCII and Latin-1 letters, digits and signs are read by the compiled merges; all
    others, and those that could hold contractions or special tokens, by the library itself.
    """

    PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of, mark = byte_symbols(), model["end_of_word_suffix"]

        def decode(token: str) -> tuple[int, ...]:
            if token.endswith(mark):
                *front, last = (byte_of[c] for c in token[: -len(mark)])
                return (*front, 256 + last)
            return tuple(byte_of[c] for c in token)

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(512, ((decode(a), decode(b)) for a, b in merges))
        of = {decode(token): k for token, k in model["vocab"].items()}
        self.ids = np.array([of[token] for token in self.merges.rank], "<u4")
        self.sizes = [len(token) for token in self.merges.rank]
        self.lockstep = Lockstep(self.merges)

    def part(self, part: bytes) -> bytes:
        """Ids of a pre-token of any length."""
        symbols = [*part[:-1], 256 + part[-1]]
        last, _ = self.merges.read(symbols)
        at, found = len(symbols), []
        while at:
            found.append(last[at])
            at -= self.sizes[last[at]]
        return self.ids[found[::-1]].tobytes()

    def parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, those of one length together."""
        out = [b""] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            if n > 48:
                for k in own:
                    out[k] = self.part(parts[k])
                continue
            words = np.frombuffer(b"".join([parts[k] for k in own]), np.uint8).reshape(-1, n).astype(np.int32)
            words[:, -1] += 256
            for rows, tokens in self.lockstep.encode(words):
                width = 4 * tokens.shape[1]
                data = self.ids[tokens].tobytes()
                for at, k in zip(range(0, len(data), width), own[rows].tolist(), strict=True):
                    out[k] = data[at : at + width]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without white space."""
        out, rare, plain, parts, cuts = [b""] * len(words), [], [], [], [0]
        for k, word in enumerate(words):
            if self.PLAIN.fullmatch(text := word.decode()):
                plain.append(k)
                parts += self.PARTS.findall(text.lower())
                cuts.append(len(parts))
            else:
                rare.append(k)
        found = self.parts([p.encode() for p in parts])
        for k, a, b in zip(plain, cuts, cuts[1:], strict=False):
            out[k] = found[a] if b == a + 1 else b"".join(found[a:b])
        if rare:
            for k, encoding in zip(rare, self.library.encode_batch([words[k].decode() for k in rare], add_special_tokens=False), strict=True):
                out[k] = array("I", encoding.ids).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        own = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b" ".join([b"", *own, b""]), np.uint8)  # white space before, between and after them
        inside = (data != 32) & ((data < 9) | (data > 13))
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        cuts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in own)]))  # each text's first word
        offsets = np.cumsum(np.append(0, ends - starts))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        ids = self.words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, index = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        own_sizes, first = sizes[index], np.cumsum(sizes) - sizes
        after = np.cumsum(np.append(0, own_sizes))
        tokens = flat[np.repeat(first[index] - after[:-1], own_sizes) + np.arange(after[-1])]
        return [tokens[a:b].tobytes() for a, b in zip(after[cuts[:-1]].tolist(), after[cuts[1:]].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def pieces(documents: DataFrame, path: str | Callable[[], str], doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut only where longer than ``capacity``."""
    end = np.array([END], "<u4").tobytes()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path() if callable(path) else path
        encoder = _encoders.setdefault(where, None) or _encoders.__setitem__(where, Encoder(where)) or _encoders[where]
        for batch in small_batches(batches, most=2 << 20):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            k, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            columns = [batch.column("doc_id").take(pa.array(k)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(frugal(compute), PIECES.format(rows.schema["doc_id"].dataType.simpleString()))


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int, free: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """For each room: the greatest total price that fits, and the index of one item of it (-1: leave a token free, at price ``free``)."""
    best, item = np.arange(capacity + 1) * free, np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fit = np.searchsorted(lengths, room, side="right")
        value = best[room - lengths[:fit]] + prices[:fit]
        k = int(value.argmax())
        best[room], item[room] = (value[k], k) if value[k] > best[room - 1] + free else (best[room - 1] + free, -1)
    return best, item


def priced(lengths: np.ndarray, item: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For every length the best configuration that holds it, as indices into ``lengths``, read off the knapsack's table."""
    first = np.where(item >= 0, np.arange(capacity + 1), 0)
    np.maximum.accumulate(first, out=first)  # the room that is left when free tokens are left out
    found = [[k] for k in range(len(lengths))]
    room = first[capacity - lengths]
    active = np.flatnonzero(item[room] >= 0)
    while len(active):
        chosen = item[room[active]]
        for k, c in zip(active.tolist(), chosen.tolist(), strict=True):
            found[k].append(c)
        room[active] = first[room[active] - lengths[chosen]]
        active = active[item[room[active]] >= 0]
    return [tuple(sorted(config, reverse=True)) for config in found]


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, loose: float = 0.0, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The configuration program: sequences of each configuration (indices into ``lengths``), and the prices that prove most.

    Covering: the configurations' contents are to reach ``demand``, and the tokens they leave free ``loose``. Each round
    prices the lengths and a free token by their weights, and the knapsack over the prices proves a bound (demand at
    these prices over the best configuration's worth). It also names the best configuration for every length; sequences in
    the bound's number are spread over them by demand, and weights of what this covers less than other things grow. The mean
    over the rounds is then settled: each configuration is weighed up or down by what its contents lack or have too much.
    """
    n = len(lengths)
    wanted = np.append(demand, loose)
    tokens = np.append(lengths, 1)
    weights, bound, proof = np.ones(n + 1), float(wanted @ tokens) / capacity, tokens / capacity
    number: dict[tuple[int, ...], int] = {}
    total: list[float] = []
    used = slice(0, n + 1 if loose else n)

    def matrix(configs, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, configs), np.int64, count)
        items = np.fromiter(chain.from_iterable(configs), np.int64, int(sizes.sum()))
        owners = np.repeat(np.arange(count), sizes)
        return items, owners, capacity - np.bincount(owners, lengths[items], count), sizes

    def lacking(x: np.ndarray, items: np.ndarray, owners: np.ndarray, room: np.ndarray) -> np.ndarray:
        covered = np.append(np.bincount(items, x[owners], n), x @ room)
        found = np.zeros(n + 1)
        found[used] = np.log(wanted[used] / np.maximum(covered[used], 1e-9))
        return found

    for t in range(rounds):
        prices = tokens / capacity * weights * (1 + PREFER * tokens / capacity)
        prices[n] *= bool(loose)
        best, item = knapsack(lengths, prices[:n], capacity, prices[n])
        if float(wanted @ prices) / best[capacity] > bound:
            bound, proof = float(wanted @ prices) / best[capacity], prices
        configs = priced(lengths, item, capacity)
        items, owners, room, _ = matrix(configs, n)
        worth = (np.bincount(owners, prices[items], n) + room * prices[n]) / best[capacity]
        held = np.bincount(owners, items == owners, n)
        share = demand / held * np.exp(SHARPNESS * (worth - 1))
        share *= bound / share.sum()
        for config, x in zip(configs, share.tolist(), strict=True):
            k = number.setdefault(config, len(total))
            if k == len(total):
                total.append(0.0)
            total[k] += x
        weights *= np.exp(STEP / np.sqrt(t + 1) * np.clip(lacking(share, items, owners, room), -1, 1))
        weights /= weights[used].mean()
    x = np.array(total) / rounds
    items, owners, room, _ = matrix(number, len(total))
    for _ in range(SETTLED):
        lack = lacking(x, items, owners, room) * tokens
        x *= np.exp(np.clip((np.bincount(owners, lack[items], len(x)) + room * lack[n]) / capacity, -1, 1))
    return dict(zip(number, x.tolist(), strict=True)), proof


@dataclass
class Program:
    """(sequences, lengths in each); a lower bound on their number; pieces above LOOSE that rounding left to best fit."""

    sequences: list[tuple[int, tuple[int, ...]]]
    bound: float
    left: int


def groups_of(counts: np.ndarray, most: int = GROUPS) -> list[np.ndarray]:
    """The lengths in ``counts``, ascending, in about ``most`` groups of equally many pieces or of one length."""
    lengths = np.flatnonzero(counts)
    own = counts[lengths]
    middle = np.cumsum(own) - (own + 1) // 2
    return np.split(lengths, np.flatnonzero(np.diff(middle * most // max(1, int(own.sum())))) + 1)


class Pile:
    """The pieces of one group of lengths, longest first."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        self.runs = [[int(n), int(counts[n])] for n in lengths]

    def take(self, most: int) -> tuple[int, int]:
        """A length, and how many pieces of it, at most ``most``, are taken."""
        length, n = self.runs[-1]
        taken = min(n, most)
        self.runs[-1][1] -= taken
        if taken == n:
            self.runs.pop()
        return length, taken

    def give(self, length: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == length:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([length, n])


def program(counts: np.ndarray, rounds: int = ROUNDS) -> Program:
    """A packing of ``counts[length]`` pieces of each length, rounded from the configuration program.

    As is usual for this program, lengths are grouped and a piece counts as its group's longest, and pieces of at most
    1 / LOOSE of a sequence enter by their tokens only. A configuration is taken as often as the program says, rounded
    down, but no more often than its pieces last; of those left with a part of a sequence the greatest parts are then
    taken once where all pieces are still there, up to PART of what the parts add up to. What this leaves over is a program
    again, of fewer pieces. It ends when rounding takes few tokens (TAKEN) or leaves few (ENOUGH); the pieces that are left
    then, and the small ones, go to the fullest sequence that has room for them.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    found: Counter[tuple[int, ...]] = Counter()
    small = np.where(sizes <= capacity // LOOSE, counts, 0).astype(np.int64)
    large = counts.astype(np.int64) - small
    loose, bound = float(small @ sizes), float(counts @ sizes) / capacity
    first = True
    while large.any():
        before = int(large @ sizes)
        groups = groups_of(large)
        piles = [Pile(g, large) for g in groups]
        stock = [int(large[g].sum()) for g in groups]
        longest = np.array([int(g[-1]) for g in groups])
        waste = float(sum((g[-1] - g) @ large[g] for g in groups))  # small pieces fill this too
        x, prices = fractional(longest, np.array(stock, float), capacity, max(0.0, loose - waste), rounds)
        if first:  # priced as their group's shortest, no packing of the pieces themselves can do with less
            best, _ = knapsack(np.array([int(g[0]) for g in groups]), prices[:-1], capacity, prices[-1])
            bound, first = max(bound, float(np.append(stock, loose) @ prices) / best[capacity]), False
        room = {config: capacity - int(longest[list(config)].sum()) for config in x}
        parts = sum(share % 1 for share in x.values()) * PART
        for down in (True, False):
            for config, share in sorted(x.items(), key=lambda e: (-(e[1] if down else e[1] % 1), e[0])):
                if (down and share < 1) or (not down and parts < 1):
                    break
                if room[config] > max(loose, capacity // ALLOW):
                    continue
                own = Counter(config)
                times = min(int(share) if down else 1, *(stock[k] // n for k, n in own.items()))
                parts -= 0 if down else bool(times)
                loose = max(0.0, loose - room[config] * times)
                for k, n in own.items():
                    stock[k] -= n * times
                while times:  # as many equal sequences at once as the piles have pieces of one length
                    pieces, step = [], times
                    for k in config:
                        length, n = piles[k].take(step)
                        pieces.append((k, length, n))
                        step = min(step, n)
                    for k, length, n in reversed(pieces):
                        piles[k].give(length, n - step)
                    found[tuple(sorted((length for _, length, _ in pieces), reverse=True))] += step
                    times -= step
        large = np.zeros_like(large)
        for pile in piles:
            for length, n in pile.runs:
                large[length] += n
        after = int(large @ sizes)
        if before - after < before / TAKEN or after * ENOUGH < counts @ sizes:
            break
    packed: Counter[tuple[int, ...]] = Counter()
    for times, config in best_fit(large + small, found):
        packed[config] += times
    return Program(sorted(((n, c) for c, n in packed.items() if n), key=lambda e: e[1], reverse=True), bound, int(large.sum()))


def repaired(counts: np.ndarray, sequences: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, tuple[int, ...]]]:
    """The sequences with those taken apart that best fit packs into fewer; of the ways tried, the fewest in all, then the most that stay.

    Small pieces fill what others leave free, so rounding's room is only used up if some of the sequences that hold many of them
    are taken apart as well. Taking all apart is one of the ways, so the result has no more sequences than best fit alone.
    """
    capacity = len(counts) - 1
    by_small = sorted(sequences, key=lambda e: (min(e[1]), e[1]))

    def tried(room: int, share: float) -> tuple[int, int, Counter]:
        left, kept = np.zeros(capacity + 1, np.int64), Counter()
        apart = int(share * sum(n for n, c in by_small if capacity - sum(c) <= room))
        for n, config in by_small:
            full = capacity - sum(config) <= room
            out = min(n, apart) if full else n
            apart -= out if full else 0
            np.add.at(left, list(config), out)
            if n > out:
                kept[config] += n - out
        stay = sum(kept.values())
        for n, config in best_fit(left):
            kept[config] += n
        return sum(kept.values()), -stay, kept

    ways = [(room, share) for room in ROOMS for share in SHARES] + [(0, 1.0)] if sequences else []
    found = min((tried(*way) for way in dict.fromkeys(ways)), key=lambda w: w[:2], default=(0, 0, Counter()))[2]
    return sorted(((n, c) for c, n in found.items() if n), key=lambda e: e[1], reverse=True)


def configurations(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[int, tuple[int, ...]]]:
    """(sequences, lengths in each) that pack ``counts[length]`` pieces of each length."""
    return repaired(counts, program(counts, rounds).sequences)


def best_fit(counts: np.ndarray, begun: dict[tuple[int, ...], int] | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram, into sequences that are ``begun`` and new ones: equal sequences are one entry and its number."""
    capacity = len(counts) - 1
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room: [sequences, lengths]
    has = np.zeros(capacity + 2, bool)
    has[capacity + 1] = True
    for config, times in (begun or {}).items():
        open_[capacity - sum(config)].append([times, config])
        has[capacity - sum(config)] = True
    for length in np.flatnonzero(counts)[::-1]:
        length, n = int(length), int(counts[length])
        while n:
            room = length + int(has[length:].argmax())
            if room > capacity:
                fits = capacity // length
                times, rest = divmod(n, fits)
                for k, size in ((times, fits), (1, rest)):
                    if k and size:
                        at = capacity - size * length
                        open_[at].append([k, (length,) * size])
                        has[at] = True
                break
            entry = open_[room][-1]
            fits = min(room // length, n)
            times = min(entry[0], n // fits)
            entry[0] -= times
            n -= times * fits
            at, config = room - fits * length, entry[1] + (length,) * fits
            if not entry[0]:
                open_[room].pop()
                has[room] = bool(open_[room])
            open_[at].append([times, config])
            has[at] = True
    return [(k, config) for entries in open_ for k, config in entries]


@dataclass
class Plan:
    """For each length: the first rank, first sequence and offset of each of its places, by rank."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int


def plan(counts: np.ndarray) -> Plan:
    places: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for times, config in configurations(counts):
        offset = 0
        for length in config:
            places.setdefault(length, []).append((times, base, offset))
            offset += length
        base += times
    columns = {n: np.array(p, np.int64).T for n, p in places.items()}
    return Plan({n: np.cumsum(c[0]) - c[0] for n, c in columns.items()}, {n: c[1] for n, c in columns.items()}, {n: c[2] for n, c in columns.items()}, base)


def pack(documents: DataFrame, path: str | Callable[[], str], doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece.

    Null texts count as empty: a document then is its end id alone. Very long texts are cut into pieces of
    ``capacity``. Repeated rows are packed each. Other columns, whatever their names, are left out. An empty table
    gives an empty one.
    """
    spark = documents.sparkSession
    with narrow_batches(spark, ROWS):
        cut = stored(pieces(documents, path, doc_id, text, capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # one row for each length up to the capacity
        counts[row["length"]] = row["count"]
    placed = spark.sparkContext.broadcast(plan(counts))
    groups = spark.createDataFrame([(int(n), -(-int(counts[n]) // RANKED)) for n in np.flatnonzero(counts)], "length long, groups int")
    dealt = cut.join(F.broadcast(groups), "length")  # a row for each length
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    before = dealt.groupBy("length", "part").count()
    before = before.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = placed.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                at = np.searchsorted(found.first[n], rank[own], side="right") - 1
                sequence[own] = found.sequence[n][at] + rank[own] - found.first[n][at]
                offset[own] = found.offset[n][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, PIECES.format(kind) + ", sequence_id long, offset long")
