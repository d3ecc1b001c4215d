"""Near-duplicates by Jaccard similarity of four-word shingles: circulant MinHash finds candidates, whole sets decide.

Every coordinate of a signature comes from the same two permutations of 2^32 places: the first deals the shingles out, the
second is shifted on by one place for each coordinate, whose value is the least one that the set meets. Coordinates are put
together ROWS at a time; texts that agree on one of BANDS bands are candidates if their sizes allow the similarity and they
share AGREEING coordinates.

In a first round each member of a bucket is a candidate with its head, the member with the fullest buckets (the likely
original of a group of copies), and each text is held against the best of its candidates. In a second, members of a bucket that are
still in different components are compared by size and signature within tasks, which tell a spanning forest of the pairs that may be
similar, never the pairs. The forests' components come together with their texts; there pairs of different components are compared
again and the whole sets of those that may be similar held against each other, until a link makes them one. A link is made only where the
whole sets of shingles reach the similarity; no table of sets is written. So links are exact; a pair
at exactly 0.8 shares no band with a probability of (1 - 0.8^6)^40, about five in a million, and too few coordinates with one of
three in a billion; a more similar one more rarely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.shared import frugal, joined, scratch, shared_folder, small_batches, stored
from trawl.llm.simhash import to_rows

SHINGLE = 4
#: A pair is linked from this share on, as a fraction.
UP, DOWN = 4, 5
BANDS, ROWS = 40, 6
#: Heads that a text is tried against in the first round, those with which it shares the most buckets; the second looks at whole buckets.
TRIED = 3
#: Coordinates of BANDS * ROWS that a pair must share to be held against each other: far fewer than 0.8 of them.
AGREEING = 156
#: Shingles whose coordinates are taken at once.
PART = 512
#: Texts that are held against one other in a task; members of a bucket, and shingles of a group with its texts, that a task compares.
HEADS, HOT, SETS = 1000, 4000, 4_000_000
_WORDS = np.random.default_rng(42).integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only


def node(text: str | None) -> bytes:
    """A number of 128 bits for the words of a text."""
    return xxhash.xxh3_128_digest(b" ".join(words(text)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(own: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of words, made of the words' hashes; fewer words are one shingle."""
    if not own:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    width = min(SHINGLE, len(own))
    sums = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        sums += hashes[k : len(own) - width + 1 + k] * _WORDS[k]
    return np.unique(_mixed(sums))


def permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the numbers of 32 bits (in place); multipliers are odd."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    return x


def coordinates(hashes: np.ndarray) -> np.ndarray:
    """The signature of a set of shingles: the least place under each shift of the second permutation."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    places = permuted((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    for k in range(0, len(places), PART):
        np.minimum(least, permuted(places[None, k : k + PART] + _SHIFTS, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=least)
    return least


def bands(signature: np.ndarray) -> np.ndarray:
    """The buckets of a signature, one for each band."""
    found = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        found = _mixed(found + column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return found


def _prepared(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, node, size, bands, signature), one for each document; a byte of each coordinate is kept."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for body in batch.column("text").to_pylist():
                own = words(body)
                hashes = shingles(own)
                signature = coordinates(hashes)
                rows.append((xxhash.xxh3_128_digest(b" ".join(own)), len(hashes), bands(signature) if len(hashes) else hashes, signature.astype(np.uint8).tobytes()))
            nodes, sizes, own_bands, signatures = zip(*rows, strict=True)
            flat = pa.array(np.concatenate(own_bands).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own_bands)]).astype(np.int32)), flat)
            columns = [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "bands", "signature"])

    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(frugal(compute), "doc_id long, node binary, size long, bands array<long>, signature binary")


def fitting(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * DOWN >= F.greatest(a, b) * UP


def agreeing(pairs: DataFrame, signatures: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs (a, b) that share AGREEING coordinates or more, with their number (``shared``).

    ``signatures`` (node, size, signature); ``counts`` (a, n), how many pairs each a has.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("of_a", "of_b"))
                shared = (one == two).sum(axis=1)
                keep = pa.array(np.flatnonzero(shared >= AGREEING))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(shared.astype(np.int32)).take(keep)], ["a", "b", "shared"])

    own = pairs.join(signatures.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("signature").alias("of_b")), "b")
    heads = counts.join(signatures.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("signature").alias("of_a")), "a")
    both = to_rows(own, stored(heads), "a", "n").filter(fitting(F.col("size_a"), F.col("size_b")))
    return both.select("a", "b", "of_a", "of_b").mapInArrow(compute, "a binary, b binary, shared int")


def holding(width: Callable[[list[bytes]], np.ndarray]):
    """A function for mapInArrow: links (a, b) from rows (a, salt, other, node, text) with a's own text before those it is held against."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, np.zeros(0, np.uint64)
        for batch in small_batches(batches):
            found = []
            for a, other, own_node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "other", "node", "text")), strict=True):
                own = width(words(text))
                if not other:
                    now, first = a, own
                    continue
                if now != a:
                    raise ValueError("a text does not follow the one it is held against")
                shared = len(np.intersect1d(own, first, assume_unique=True))
                if shared * (UP + DOWN) >= (len(own) + len(first)) * UP:
                    found.append((a, own_node))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return compute


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) of each different text of a task: copies within it are told once."""
    seen: set[bytes] = set()
    for batch in small_batches(batches):
        nodes = [node(t) for t in batch.column("text").to_pylist()]
        keep = []
        for k, n in enumerate(nodes):
            if n not in seen:
                seen.add(n)
                keep.append(k)
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in keep], pa.binary()), batch.column("text").take(pa.array(keep))], ["node", "text"])


def _wanted(documents: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """(node, text), a row for each of the wanted nodes."""
    texts = documents.select(F.col(text).alias("text")).mapInArrow(_texts, "node binary, text string")
    return joined(texts, nodes.select(F.col("node").alias("of")).distinct(), F.col("node") == F.col("of"), "left_semi").dropDuplicates(["node"])


def similar(pairs: DataFrame, documents: DataFrame, text: str, width: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets of shingles reach the similarity.

    Texts go to their pair's first node, at most HEADS to a group; its own text is repeated for each group.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / HEADS).cast("int").alias("salts"))
    counts = stored(counts)
    dealt = to_rows(pairs, counts, "a", "n").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("other"), F.col("a").alias("node"))
    members = stored(heads.unionByName(dealt.select("a", "salt", F.lit(True).alias("other"), F.col("b").alias("node"))))
    rows = members.join(_wanted(documents, text, members), "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "other")
    return rows.select("a", "salt", "other", "node", "text").mapInArrow(holding(width), "a binary, b binary")


class Group:
    """Members that a task compares, sorted by size, so that each meets the window of sizes that fit its own."""

    def __init__(self, batch: pa.RecordBatch):
        self.node, label, size, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "size", "part"))
        self.low, self.high = batch.column("low")[0].as_py(), batch.column("high")[0].as_py()
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(len(size), -1)
        self.order = np.argsort(size, kind="stable")
        self.label = np.unique(label, return_inverse=True)[1][self.order]
        self.node, self.size, self.part, self.signs = self.node[self.order], size[self.order], part[self.order], signs[self.order]
        self.ends = np.searchsorted(self.size, self.size * DOWN // UP, "right")
        self.starts = np.searchsorted(self.size, -(-self.size * UP // DOWN), "left")

    def rows(self) -> np.ndarray:
        """Members that have to be compared with the others: all but those of the largest component, or one of two parts."""
        return np.flatnonzero(self.label != np.bincount(self.label).argmax()) if self.low == self.high else np.flatnonzero(self.part == self.low)

    def near(self, i: int, label: np.ndarray) -> np.ndarray:
        """The members with another label that may be similar to one."""
        window = slice(self.starts[i], self.ends[i])
        other = label[window] != label[i]
        if self.low != self.high:
            other &= self.part[window] == self.high
        found = np.flatnonzero(other) + self.starts[i]
        return found[(self.signs[found] == self.signs[i]).sum(axis=1) >= AGREEING]


def _pairs(group: Group, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = (group.node[list(x)] for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.binary()), pa.array(np.maximum(a, b), pa.binary())], ["a", "b"])


def across(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (a, b) of the pairs in a bucket that have different labels and may be similar, as stars around the least
    node ``a`` of each tree. Batches are whole groups."""
    for batch in groups:
        group = Group(batch)
        tree = np.arange(len(group.node))
        for i in group.rows():
            for t in np.unique(tree[group.near(i, group.label)]):
                if t != tree[i]:
                    tree[tree == t] = tree[i]
        order = np.argsort(group.node, kind="stable")
        trees, firsts, own = np.unique(tree[order], return_index=True, return_inverse=True)
        roots = order[firsts][own]
        yield from _pairs(group, [(r, i) for r, i in zip(roots, order, strict=True) if r != i])


def folded(stars: DataFrame) -> DataFrame:
    """Links (a, b) with the components of ``stars`` (a, b): one for each b, to the least of its roots, and those between its roots.

    A text is in BANDS buckets, so it has as many links in ``stars``; the roots are few, and the same ones for many texts.
    """
    own = stored(stars.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("roots")).select("b", F.element_at("roots", 1).alias("a"), "roots"))
    between = own.filter(F.size("roots") > 1).select("a", "roots").distinct().select("a", F.explode("roots").alias("b")).filter("a <> b")
    return own.select("a", "b").union(between).distinct()


def confirmed(width: Callable[[list[bytes]], np.ndarray]):
    """A function for batches of whole groups with texts: links (a, b) between components, as many as make them one where they are similar."""

    def compute(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            group, found = Group(batch), []
            texts = [width(words(t)) for t in batch.column("text").to_pylist()]
            sets = [texts[k] for k in group.order]
            label = group.label.copy()
            for i in group.rows():
                for k in group.near(i, label):
                    if label[k] == label[i]:
                        continue
                    shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if shared * (UP + DOWN) >= (len(sets[i]) + len(sets[k])) * UP:
                        found.append((i, k))
                        label[label == label[k]] = label[i]
            yield from _pairs(group, found)

    return compute


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches that each hold one whole group, from batches sorted by group."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        own = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k] != own[start]:
                if own[start] != now and held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                now = own[start]
                held.append(batch.slice(start, k - start))
                start = k
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``parts`` of their group) once for each pair of parts that theirs belongs to, as (low, high, part)."""
    parted = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select(key, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label")


def remaining(buckets: DataFrame, labels: DataFrame, signatures: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the members of buckets that have different labels and may be similar."""
    placed = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).filter("least < most")
    mixed = stored(mixed.select("band", "n", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    rows = _dealt(to_rows(placed, mixed, "band", "n"), "band")
    dealt = rows.join(signatures, "node").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return dealt.mapInArrow(lambda batches: across(whole(batches, ("band", "low", "high"))), "a binary, b binary")


def settled(forests: DataFrame, labels: DataFrame, signatures: DataFrame, documents: DataFrame, text: str, width: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Links (a, b) between different labels within the components of ``forests``, found by whole sets."""
    groups = components(forests).select("node", F.col("label").alias("tree"))
    members = groups.join(labels, "node", "left").join(signatures.select("node", "size"), "node").select("tree", "node", "size", F.coalesce("label", "node").alias("label"))
    members = stored(members)
    heavy = F.greatest(F.ceil(F.count("*") / HOT), F.ceil(F.sum("size") / SETS)).cast("int")
    parts = stored(members.groupBy("tree").agg(F.count("*").alias("n"), heavy.alias("parts")))
    rows = _dealt(to_rows(members, parts, "tree", "n"), "tree")
    whole_rows = rows.join(signatures, "node").join(_wanted(documents, text, members), "node")
    dealt = whole_rows.repartition("tree", "low", "high").sortWithinPartitions("tree", "low", "high")
    compute = confirmed(width)
    return dealt.mapInArrow(lambda batches: compute(whole(batches, ("tree", "low", "high"))), "a binary, b binary")


def linked(distinct: DataFrame, documents: DataFrame, text: str, width: Callable[[list[bytes]], np.ndarray], walked: DataFrame | None = None) -> DataFrame:
    """Rows (node, label): the components of the ``distinct`` texts (node, size, bands, signature) that have links.

    ``walked`` (a, b) are further candidates; ``width`` gives the set of a text's words that decides.
    """
    signatures = distinct.select("node", "size", "signature")
    # Whom the first round does not try against one another, the second compares in their buckets.
    rows = distinct.select("node", F.explode("bands").alias("band"))
    full = stored(rows.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"))
    buckets = stored(rows.join(full, "band"))  # most texts are alone in their buckets, and end here
    popular = buckets.groupBy("node").agg(F.sum("members").alias("popularity"))
    heads = buckets.join(popular, "node").groupBy("band").agg(F.max_by("node", F.struct("popularity", "node")).alias("head"), F.count("*").alias("n"))
    met = to_rows(buckets.select("band", "node"), stored(heads), "band", "n").filter("head <> node").groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    first = F.slice(F.sort_array(F.collect_list(F.struct("shared", "a")), asc=False), 1, TRIED)  # of BANDS heads at most
    tried = met.groupBy("b").agg(first.alias("heads")).select(F.explode("heads.a").alias("a"), "b")
    tried = stored((tried if walked is None else tried.unionByName(walked.select("a", "b"))).distinct())
    candidates = stored(agreeing(tried, signatures, tried.groupBy("a").agg(F.count("*").alias("n"))))
    best = stored(candidates.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"))
    links = stored(similar(best, documents, text, width))
    labels = stored(components(links))
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    open_pairs = candidates.select("a", "b").join(best, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
    open_pairs = open_pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(folded(remaining(buckets.select("band", "node"), labels, signatures).union(open_pairs)))
    if more.isEmpty():
        return labels
    found = stored(settled(more, labels, signatures, documents, text, width))
    if found.isEmpty():
        return labels
    # Components of components: a label stands for all that the first round has put together.
    first = found.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    higher = stored(components(first.distinct()).select(F.col("node").alias("old"), F.col("label").alias("new")))
    alone = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node"))
    every = labels.select("node", "label").unionByName(alone)
    return joined(every, higher, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each document.

    Texts of the same words are copies of each other. A text of fewer than SHINGLE words is one shingle; a text without
    words has none, is linked with nothing and is a component of its own; very long texts count with all their shingles. A null
    doc_id is never the smallest, a component with no other has a null id, and of it all rows are kept. Rows that repeat an id
    have the component of their own text. Other columns, whatever their names, are left out.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark)
    with scratch(spark):
        prepared = stored(_prepared(documents, doc_id, text))
        distinct = prepared.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
        distinct = stored(distinct)
        labels = linked(distinct, documents, text, shingles)
        known = stored(distinct.select("node", "n", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        least = known.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
        ids = stored(to_rows(known, stored(least), "label", "members").select("node", "n", "component_id"))
        own = prepared.select("doc_id", "size", "node")
        found = to_rows(own.filter("size > 0"), ids, "node", "n").select("doc_id", "size", "component_id")
        found = found.unionByName(own.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
        return stored(found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), folder)
