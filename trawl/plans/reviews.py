"""A review's progress: which chunks have been answered, so that a run that was interrupted goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.plans.store import Store

#: Files of a report, by the first digits of the chunks' ids.
DIGITS = 2


def named(chunks: DataFrame, file: str = "file_id", text: str = "text") -> DataFrame:
    """``chunks`` with ``chunk_id``: SHA-1 of the file's name, the chunk's number and its text, so changed texts are reviewed anew."""
    whole = F.concat_ws("\0", F.coalesce(F.col(file).cast("string"), F.lit("")), F.col("chunk").cast("string"), F.coalesce(F.col(text), F.lit("")))
    return chunks.withColumn("chunk_id", F.sha1(whole.cast("binary")))


def pending(store: Store, chunks: DataFrame) -> DataFrame:
    """The chunks (with ``chunk_id``) that no run has answered; only the store's parts that may hold one are opened."""
    runs = store._latest("reviews")[1]
    done = store.lookup("reviews", chunks, runs) if runs else None
    return chunks if done is None else chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")


def record(store: Store, answers: DataFrame) -> None:
    """Keeps answers (chunk_id, answer, failed), one for each chunk: the first that is kept stands. The manifest tells which ones failed."""
    store.add("reviews", answers.select("chunk_id", "answer", "failed"))


def manifest(store: Store, chunks: DataFrame, file: str = "file_id") -> DataFrame:
    """Rows (file, n_chunks, n_done, n_failed, status) of the files whose chunks are given: ``complete``, ``partial`` or ``open``."""
    done = store.table("reviews")
    told = chunks.select(file, "chunk_id").join(done.select("chunk_id", "failed"), "chunk_id", "left") if done is not None else chunks.select(file, F.lit(None).cast("boolean").alias("failed"))
    counts = told.groupBy(file).agg(F.count("*").alias("n_chunks"), F.count_if(~F.col("failed")).alias("n_done"), F.count_if(F.col("failed")).alias("n_failed"))
    status = F.when(F.col("n_done") == F.col("n_chunks"), "complete").when(F.col("n_done") + F.col("n_failed") > 0, "partial").otherwise("open")
    return counts.withColumn("status", status)


def export(store: Store, folder: str) -> None:
    """All answers as JSON lines, in folders by the first digits of their ids and sorted within: the same rows give the same lines, however many runs they took."""
    rows = store.table("reviews").select(F.substring("chunk_id", 1, DIGITS).alias("part"), F.to_json(F.struct("chunk_id", "answer", "failed")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "value").write.mode("overwrite").partitionBy("part").text(folder)
