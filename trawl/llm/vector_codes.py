"""Product codes of vectors, each part's nearest codebook entry found by annular norm pruning.

By the triangle inequality an entry no further from a part than the best one known has a norm within that distance of
the part's own. So a codebook's entries are sorted by norm; the entry nearest in norm and its neighbours give a first
distance, two binary searches give the annulus of entries that it allows (bounds included, and widened by more than
rounding can take away), and only those are evaluated, in whole numbers. Ties go to the lower index.

A codebook has ENTRIES * dimension numbers whatever the table holds, so it travels with the tasks. A round reads the
vectors once; its tasks send sums and counts for each entry and component, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import stored
from trawl.llm.simhash import to_rows

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries on either side of the one nearest in norm that give the first distance.
AROUND = 2
#: Vectors evaluated at once.
BLOCK = 2048


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], entries[self.order]

    def _best(self, parts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each part the least distance * len(order) + index over the sorted entries from low to before high, at least one."""
        counts = high - low
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(parts)), counts)
        at = np.arange(ends[-1]) - np.repeat(ends - counts - low, counts)
        ranks = ((parts[row] - self.sorted[at]) ** 2).sum(axis=1) * len(self.order) + self.order[at]
        return np.minimum.reduceat(ranks, ends - counts)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each part's nearest entry, and the squared distance to it."""
        k = len(self.order)
        found = [np.zeros(0, np.int64)]
        for start in range(0, len(parts), BLOCK):
            own = parts[start : start + BLOCK]
            norm = np.sqrt((own.astype(float) ** 2).sum(axis=1))
            at = np.searchsorted(self.norms, norm)
            first = self._best(own, np.maximum(np.minimum(at, k - 1) - AROUND, 0), np.minimum(at + AROUND, k))
            reach = np.sqrt(first // k) * (1 + 1e-9) + 1e-9 * (1 + norm)
            found.append(self._best(own, np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")))
        ranks = np.concatenate(found)
        return ranks % k, ranks // k


def limit(width: int) -> int:
    """The largest component by which distances over ``width`` components, times ENTRIES, stay within 64 bits."""
    return isqrt(2**62 // (4 * ENTRIES * max(width, 1)))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Whole-number vectors, cut into parts: an array of (rows, PARTS, width)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    most = float(limit(width))
    return np.clip(np.floor(values * SCALE), -most, most).astype(np.int64).reshape(len(column), PARTS, width)


def _sums(width: int, books: np.ndarray):
    """A function for mapInArrow: for every (part, entry, place) the sum and the number of the parts assigned in this task."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, k = [Codebook(b) for b in books], books.shape[1]
        totals, counts = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in batches:
            vectors = integers(batch.column("vector"), width)
            for p, book in enumerate(made):
                codes, _ = book.nearest(vectors[:, p])
                counts[p] += np.bincount(codes, minlength=k)
                np.add.at(totals[p], codes, vectors[:, p])
        part, entry, place = (x.ravel().astype(np.int32) for x in np.indices(totals.shape))
        used = pa.array(np.flatnonzero(counts[part, entry]))
        columns = [pa.array(x).take(used) for x in (part, entry, place, totals.ravel(), counts[part, entry])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total", "n"])

    return compute


def _codes(width: int, books: np.ndarray):
    """A function for mapInArrow: every vector's code and error."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for batch in batches:
            vectors = integers(batch.column("vector"), width)
            codes, error = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
            for p, book in enumerate(made):
                codes[:, p], distance = book.nearest(vectors[:, p])
                error += distance
            texts = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("key"), texts, pa.array(error)], ["vec_id", "key", "code", "error"])

    return compute


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def codebooks(rows: DataFrame, size: int) -> np.ndarray:
    """The codebooks after ROUNDS rounds over ``rows`` (vec_id, key, vector), as (PARTS, entries, size / PARTS)."""
    width = size // PARTS
    own = rows.select("vec_id", "vector")
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES)
    vectors = integers(pa.array([r["vector"] for r in first.collect()], pa.list_(pa.float64())), width)
    books = vectors.transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        sums = own.mapInArrow(_sums(width, books), "part int, entry int, place int, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for part, entry, place, total, n in sums.collect():  # as many rows as a codebook has numbers
            books[part, entry, place] = int(total) // n
    return books


def compress(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one for each usable vector.

    Left out are vectors that are null or hold a null or non-finite component. All vectors should have as many components
    as that of the smallest id, in PARTS equal parts: others have no code and no error. Components count up to
    ``limit`` (2^27 for parts of four) as whole numbers, larger ones as that. Null ids come after all others, rows with
    one id by their vectors; repeated rows are rows of their own. With fewer than ENTRIES vectors there are as many entries.
    Null labels are summed together. An empty table gives an empty one; other columns, whatever their names, are left out.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), key.alias("key"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    smallest = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    size = smallest["n"] if smallest and smallest["n"] % PARTS == 0 else -1
    fit = rows.filter(F.size("vector") == size)
    books = codebooks(fit, size) if size >= 0 else np.zeros((PARTS, 0, 0), np.int64)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    coded = fit.mapInArrow(_codes(max(size, 0) // PARTS, books), f"vec_id {id_type}, key string, code string, error long")
    unfit = rows.filter(F.size("vector") != size).select("vec_id", "key", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stored(coded.unionByName(unfit))
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return to_rows(coded, stored(sums), "key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
