"""A quality classifier that compares how well two dictionaries compress a text.

One zstandard dictionary is built from good and one from bad labelled texts. Every text is cut into blocks,
so that the dictionaries matter from its first to its last byte, and each block is compressed with either.
The normalised difference of the two sizes, and the size with the good dictionary per byte (texts that
repeat themselves shrink under any dictionary), are calibrated to a probability on labelled texts that
built no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trawl.llm.labelled import Logistic, fit, remainder, sample
from trawl.llm.shared import frugal, small_batches

#: Bytes compressed at once, of a dictionary, and blocks that a text gives to a dictionary.
BLOCK, DICTIONARY, BLOCKS_PER_TEXT = 2048, 64 << 10, 4
LEVEL = 3
#: The labelled sample: texts of each label, and characters of a text.
PER_CLASS, MOST_CHARS = 2000, 20_000
#: Rows whose crc32(doc_id) has remainder HELD_OUT modulo FOLDS are never learnt from.
FOLDS, HELD_OUT = 3, 1


def blocks(text: str | None) -> list[bytes]:
    body = (text or "").encode("utf-8", "surrogatepass")
    return [body[k : k + BLOCK] for k in range(0, len(body), BLOCK)] or [b""]


def dictionary(texts: list[str]) -> bytes:
    """A dictionary from evenly spaced blocks of the texts; plain content where they are too few to train one."""
    parts = []
    for text in texts:
        own = blocks(text)
        parts += own[:: max(1, len(own) // BLOCKS_PER_TEXT)][:BLOCKS_PER_TEXT]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        share = max(1, DICTIONARY // max(1, len(parts)))  # of every block alike
        return b"".join(p[:share] for p in parts) or b"\n" * 8


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibration: Logistic


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for content in (good, bad):
            data = zstandard.ZstdCompressionDict(content)
            data.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, float]:
        own = blocks(text)
        good, bad = (sum(len(c.compress(b)) for b in own) for c in self.both)
        return (good - bad) / (good + bad), good / (sum(map(len, own)) + 16)


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from at most PER_CLASS texts of either label outside the held-out fold.

    Every other text of the sample builds a dictionary, the rest calibrates. Without labels every text
    scores one half.
    """
    found = sample(documents, labels, label, remainder(F.col(doc_id), FOLDS) != HELD_OUT, PER_CLASS, MOST_CHARS, doc_id, text)
    of = lambda y, start: [t for t, k in list(zip(found.texts, found.labels, strict=True)) if k == y][start::2]
    good, bad = dictionary(of(1, 0)), dictionary(of(0, 0))
    tools = Compressors(good, bad)
    rest = np.concatenate([np.flatnonzero(found.labels == y)[1::2] for y in (0, 1)])
    features = np.array([tools.features(found.texts[k]) for k in rest]).reshape(-1, 2)
    return Model(good, bad, fit(features, found.labels[rest], found.weights[rest]))


def with_score(documents: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the probability that a text is good; null texts are scored as empty ones."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(model.good, model.bad)
        for batch in small_batches(batches, text):
            features = np.array([tools.features(t) for t in batch.column(text).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.calibration.probability(features))], [*batch.schema.names, score])

    return documents.mapInArrow(frugal(compute), StructType([*documents.schema.fields, StructField(score, DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document.

    Null ids are not held out; repeated rows score alike; null texts are scored as empty ones, very long ones whole, block
    by block; other columns, whatever their names, are left out; an empty table gives an empty one.
    """
    model = train(documents, labels, doc_id, text)
    scored = with_score(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
