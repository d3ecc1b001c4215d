"""Near-duplicates by Jaccard similarity of five-word shingles: SimHash and MinHash find candidates, the whole sets decide.

Texts whose SimHash fingerprints the binary tries of ``simhash`` link are candidates, but at a similarity of 0.8
fingerprints differ by ten of 64 bits, further than tries can be walked. So a text's minima under BANDS * ROWS hash
functions are also put together ROWS at a time, and texts that agree on one such band are candidates. From there on the rounds
are those of ``circulant``: heads of buckets first, then forests of what may still be similar, and whole sets decide. A pair at exactly
0.8 is missed by all bands with a probability of (1 - 0.8^6)^40, about five in a million, by its minima with one of three in
a billion, and a more similar one more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.memory import narrow_batches
from trawl.llm import circulant, simhash
from trawl.llm.shared import frugal, scratch, shared_folder, small_batches, stored

SHINGLE = 5
BANDS, ROWS = 40, 6
_FACTORS, _SHIFTS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)
#: Shingles whose minima are taken at once.
PART = 1 << 11
#: Rows that a worker is given at once, if they are no more than ``functions.memory`` allows in bytes.
BATCH = 10_000


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of the shingles of words; fewer words are one shingle, none have none."""
    join, digest = b" ".join, xxhash.xxh64_intdigest
    found = map(join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [join(words)] if words else []
    return np.unique(np.fromiter((digest(s) for s in found), np.uint64))


_last: list = [None, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of shingles under each hash function; those of the last set are remembered."""
    if _last[0] is not hashes:
        least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
        for k in range(0, len(hashes), PART):
            np.minimum(least, (hashes[None, k : k + PART] * _FACTORS + _SHIFTS).min(axis=1), out=least)
        _last[:] = hashes, least
    return _last[1]


def bands(hashes: np.ndarray) -> np.ndarray:
    """The buckets that a set of shingles falls into, one for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in minima(hashes).reshape(BANDS, ROWS).T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def signature(hashes: np.ndarray) -> bytes:
    """A byte of each minimum."""
    return minima(hashes).astype(np.uint8).tobytes()


def _fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _prepared(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, node, size, fp, bands, signature), one for each document; texts of the same words have the same node."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for body in batch.column("text").to_pylist():
                hashes = hashes_of(circulant.words(body))
                rows.append((circulant.node(body), len(hashes), _fingerprint(hashes), bands(hashes), signature(hashes)))
            nodes, sizes, prints, own, signs = zip(*rows, strict=True)
            columns = [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), _lists(list(own)), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "fp", "bands", "signature"])

    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(frugal(compute), "doc_id long, node binary, size long, fp long, bands array<long>, signature binary")


def _pairs_of_tries(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) whose fingerprints are linked by the tries, or the same."""
    firsts = stored(distinct.filter(F.size("bands") > 0).groupBy("fp").agg(F.min("node").alias("first")))
    linked = simhash.links(firsts.select("fp"))
    x, y = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    between = linked.join(x, "a").join(y, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    within = simhash.to_rows(distinct.select("fp", "node"), firsts.withColumn("n", F.lit(1)), "fp", "n").filter("first <> node")
    return between.union(within.select(F.col("first").alias("a"), F.col("node").alias("b")))


def _found(documents: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(prepared documents, (node, n, component_id) of each different text)."""
    prepared = stored(_prepared(documents, doc_id, text))
    distinct = prepared.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "fp", "bands", "signature")])
    distinct = stored(distinct)
    labels = circulant.linked(distinct, documents, text, hashes_of, _pairs_of_tries(distinct))
    known = stored(distinct.select("node", "n", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = known.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    return prepared, stored(simhash.to_rows(known, stored(least), "label", "members").select("node", "label", "n", "component_id"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, component_id), one for each document.

    Texts of the same words, and those without any, are copies of each other; a text of fewer than SHINGLE words is
    one shingle; very long texts count with all their shingles. A null doc_id is never the smallest, and a component with
    no other has a null id. Other columns, whatever their names, are left out.
    """
    folder = shared_folder(documents.sparkSession)
    with scratch(documents.sparkSession), narrow_batches(documents.sparkSession, BATCH):
        prepared, ids = _found(documents, doc_id, text)
        return stored(simhash.to_rows(prepared.select("doc_id", "node"), ids.drop("label"), "node", "n").select("doc_id", "component_id"), folder)


def kept(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node) of the row that stays of each component: the least id, and of its texts the one with the least node.

    Ids may repeat with other texts; a row is told by both. Components without an id have no row here.
    """
    folder = shared_folder(documents.sparkSession)
    with scratch(documents.sparkSession), narrow_batches(documents.sparkSession, BATCH):
        prepared, ids = _found(documents, doc_id, text)
        rows = simhash.to_rows(prepared.select("doc_id", "node"), ids, "node", "n").filter("doc_id = component_id")
        return stored(rows.groupBy("label", "doc_id").agg(F.min("node").alias("node")).select("doc_id", "node"), folder)


def node_of(text: Column) -> Column:
    """The number of 128 bits that ``kept`` tells texts by."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([circulant.node(t) for t in texts], dtype="object")

    return run(text)
