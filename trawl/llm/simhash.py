"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints at most two bits apart agree on one of three blocks of bits. So each fingerprint enters
three tries, rotated to put one block on top. Within that block a trie is walked with no error at all:
its nodes at the block's end are the shuffle keys. Below, pairs of nodes are walked together: a pair's
children are paired, a differing bit is charged to the pair, and a pair that has spent more than the
budget is pruned with everything below it. Only the components of the links leave a task. Nodes with very many
fingerprints are dealt out as pairs of nodes some bits below, as often as it takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import small_batches, stored

SEED = 42
SHINGLE = 3
BITS = 2
#: Rotation to the left, and the length of the block that it puts on top.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one node that a task walks at once; a larger node is split into pairs of nodes SPLIT bits below.
HOT, SPLIT = 50_000, 8
#: A fingerprint of more than one in so many documents is joined by broadcast; there are at most so many.
OFTEN = 1000
#: What names a task's group of fingerprints.
KEY = ("block", "depth", "low", "high")
#: Pairs of nodes that are walked at once.
FRONT = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < shingle:
        shingles = [join(words)]
    else:
        shingles = map(join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) for every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = pa.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(compute, "doc_id long, fp long")


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; labels[i] is the least index known to be in i's component."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def walk(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, others_end: np.ndarray, below: int, spent: int, budget: int = BITS) -> np.ndarray:
    """Labels of ``values`` (sorted, unsigned) by the components of their links.

    Node i is values[starts[i]:ends[i]], whose members agree on all bits from ``below`` up; it is walked with
    the node others[i]:others_end[i], or with itself.
    """
    labels = np.arange(len(values))
    one = np.uint64(1)
    bit0, spent0 = np.full(len(starts), below - 1, np.int8), np.full(len(starts), spent, np.int8)
    stack = [(starts, ends, others, others_end, bit0, spent0)]
    while stack:
        a0, a1, b0, b1, bit, cost = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, bit, cost)), tuple(x[half:] for x in (a0, a1, b0, b1, bit, cost))]
            continue
        leaf = ((a1 - a0) == 1) & ((b1 - b0) == 1)
        la, lb = a0[leaf], b0[leaf]
        near = (la != lb) & (np.bitwise_count(values[la] ^ values[lb]) <= budget)
        _settle(labels, la[near], lb[near])
        a0, a1, b0, b1, bit, cost = (x[~leaf] for x in (a0, a1, b0, b1, bit, cost))
        if not len(a0):
            continue
        shift = bit.astype(np.uint64)
        middle = lambda lo, hi: np.clip(np.searchsorted(values, ((values[lo] >> shift) | one) << shift), lo, hi)  # noqa: E731, B023
        am, bm, same = middle(a0, a1), middle(b0, b1), a0 == b0
        pairs = []
        for left, right, extra in (((a0, am), (b0, bm), 0), ((am, a1), (bm, b1), 0), ((a0, am), (bm, b1), 1), ((am, a1), (b0, bm), 1)):
            keep = (left[0] < left[1]) & (right[0] < right[1]) & (cost + extra <= budget)
            if extra and left[0] is am:
                keep &= ~same  # the mirror image of the pair before
            pairs.append((left[0][keep], left[1][keep], right[0][keep], right[1][keep], bit[keep] - 1, cost[keep] + np.int8(extra)))
        stack.append(tuple(np.concatenate(x) for x in zip(*pairs, strict=True)))
    return labels


def _rotate(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(64 - by)) if by else values


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups that arrive one after another, each sorted: a spanning star of every component."""

    def told(values: np.ndarray, labels: np.ndarray, block: int) -> pa.RecordBatch:
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        back = (64 - BLOCKS[block][0]) % 64
        a, b = (_rotate(values[i], back).view(np.int64) for i in (moved, labels[moved]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        plain = rows[rows["low"] == rows["high"]]
        for block in np.unique(plain["block"]):
            own = plain[plain["block"] == block]
            for depth in np.unique(own["depth"]):
                level = own[own["depth"] == depth]
                values = level["rotated"].view(np.uint64)
                edges = np.flatnonzero(np.diff(level["low"], prepend=level["low"][0] - 1, append=level["low"][-1] - 1))
                starts, ends = edges[:-1], edges[1:]
                many = ends - starts > 1
                yield told(values, walk(values, starts[many], ends[many], starts[many], ends[many], 64 - int(depth), 0), int(block))
        split = rows[rows["low"] != rows["high"]]
        changed = np.any([np.diff(split[name], prepend=0) != 0 for name in KEY], axis=0)
        changed[:1] = True
        for own in np.split(split, np.flatnonzero(changed)[1:]) if len(split) else []:
            block, depth, low, high = (int(own[name][0]) for name in KEY)
            values, shift = own["rotated"].view(np.uint64), np.uint64(64 - depth)
            middle = int(np.searchsorted(values >> shift, max(low, high)))
            if 0 < middle < len(values):  # else only one of the two nodes has members
                at = lambda x: np.array([x])
                labels = walk(values, at(0), at(middle), at(middle), at(len(values)), 64 - depth, (low ^ high).bit_count())
                yield told(values, labels, block)

    kind = np.dtype([(name, np.int64) for name in (*KEY, "rotated")])
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        rows = np.zeros(batch.num_rows, kind)
        for name in kind.names:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        same = np.all([rows[name] == rows[name][-1] for name in KEY], axis=0)
        first = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group begins here, or before
        if size + first >= 2 * HOT and first:
            yield from groups(np.concatenate([*held, rows[:first]]))
            held, size = [rows[first:]], len(rows) - first
        else:
            held.append(rows)
            size += len(rows)
    if size:
        yield from groups(np.concatenate(held))


def links(distinct: DataFrame, hot: int | None = None) -> DataFrame:
    """Rows (a, b) whose components are those of all pairs of ``fp`` at most BITS bits apart.

    A task's group is a pair of trie nodes (``low`` and ``high``, the first ``depth`` bits; mostly one node with itself).
    Groups of more than ``hot`` rows are replaced by the pairs of their nodes' descendants SPLIT bits below that stay
    within the budget, until none is left or the bits are used up.
    """
    hot = HOT if hot is None else hot
    turned = lambda by: F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")
    tries = [
        F.struct(F.lit(k).cast("long").alias("block"), F.lit(size).cast("long").alias("depth"), F.shiftrightunsigned(turned(by), 64 - size).alias("low"), turned(by).alias("rotated"))
        for k, (by, size) in enumerate(BLOCKS)
    ]
    rows = distinct.select(F.explode(F.array(*tries)).alias("t")).select("t.block", "t.depth", "t.low", F.col("t.low").alias("high"), "t.rotated")
    right = lambda value, n: F.call_function("shiftrightunsigned", value, n.cast("int"))
    own = right(F.col("rotated"), 64 - F.col("depth"))
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT) if m.bit_count() <= BITS])
    done: list[DataFrame] = []
    while True:
        large = stored(rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter((F.col("n") > hot) & (F.col("depth") + SPLIT < 64)).drop("n"))
        if large.isEmpty():
            break
        done.append(rows.join(large, list(KEY), "left_anti"))
        parts = rows.join(large, list(KEY), "left_semi").withColumn("other", F.when(own == F.col("low"), F.col("high")).otherwise(F.col("low")))
        after = right(F.col("rotated"), 64 - SPLIT - F.col("depth"))
        parts = parts.select("block", (F.col("depth") + SPLIT).alias("depth"), "rotated", after.alias("node"), "other", F.explode(masks).alias("mask"))
        other = F.shiftleft("other", SPLIT).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << SPLIT) - 1).cast("long")).bitwiseXOR(F.col("mask")))
        parts = parts.select("block", "depth", "rotated", "node", other.alias("other")).filter(F.bit_count(F.col("node").bitwiseXOR(F.col("other"))) <= BITS)
        parts = stored(parts.select("block", "depth", F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high"), "rotated"))
        rows = parts
    for other_rows in done:
        rows = rows.unionByName(other_rows)
    unsigned = F.col("rotated").bitwiseXOR(F.lit(-(2**63)))  # sorts as unsigned numbers do
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, unsigned).select(*KEY, "rotated").mapInArrow(_links, "a long, b long")


def to_rows(rows: DataFrame, ids: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to ``ids`` by ``key``, which names ``size`` of them each.

    Keys of more than one in OFTEN of all rows, at most OFTEN keys, are broadcast, so no task gets all copies of one text.
    """
    total = ids.agg(F.sum(size)).first()[0] or 0
    often = F.broadcast(ids.filter(F.col(size) * OFTEN > total)).drop(size)
    seldom = rows.join(often.select(key), key, "left_anti").join(ids.drop(size), key)
    return rows.join(often, key).unionByName(seldom)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int | None = None) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each document.

    Equal fingerprints are linked before the tries are built, so copies cost one entry. Null texts count as
    empty; texts without words have fingerprint zero and are linked like any other; very long texts are hashed in
    parts; a null doc_id is never the smallest, and a component with no other has a null id; other columns, whatever their
    names, are left out; an empty table gives an empty one.
    """
    prints = stored(fingerprints(documents, doc_id, text))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    labels = components(links(distinct.select("fp"), hot))
    known = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "n", "first_id", F.coalesce("label", "fp").alias("label"))
    known = stored(known)
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = stored(known.join(least, "label").select("fp", "n", "component_id"))
    return to_rows(prints, ids, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
