"""A mirror of downloads: each URL's content as a file, under names that do not depend on the order of writing."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.ids import blob_id
from trawl.functions.memory import BYTES, give_back, narrow_batches
from trawl.functions.urls import mirror_path
from trawl.operators.detect import small_batches
from trawl.plans.store import stored


def placed(pages: DataFrame) -> DataFrame:
    """Rows (url, file, blob_id, size) for ``pages`` (url, content): where each URL's content is kept.

    A path belongs to the content of its least URL; other contents of the path have the beginning of their blob id in their name.
    Equal contents of a path are one file. Of several contents of one URL that with the least id counts. Rows without a URL, a host or
    content are left out.
    """
    own = pages.select("url", mirror_path(F.col("url")).alias("path"), blob_id(F.col("content")).alias("blob_id"), F.octet_length("content").cast("long").alias("size"))
    own = own.filter("path is not null and blob_id is not null").groupBy("url", "path").agg(F.min(F.struct("blob_id", "size")).alias("b")).select("url", "path", "b.*")
    first = own.groupBy("path").agg(F.min(F.struct("url", "blob_id")).alias("first")).select("path", F.col("first.blob_id").alias("_owner"))
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    extension = F.regexp_extract(name, r"(\.[^.]*)\z", 1)
    other = F.concat(F.substring("path", F.lit(1), F.length("path") - F.length(extension)), F.lit("__"), F.substring("blob_id", 1, 12), extension)
    return own.join(first, "path").select("url", F.when(F.col("blob_id") == F.col("_owner"), F.col("path")).otherwise(other).alias("file"), "blob_id", "size")


def _writer(root: str):
    """A function that writes one file below a root: under a temporary name first, so a file is there whole or not at all."""
    scheme, _, rest = root.rpartition("://")
    if scheme in ("", "file"):

        def write(file: str, body: bytes, task: str) -> None:
            path = os.path.join(rest, file)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{task}.tmp", "wb") as out:
                out.write(body)
            os.replace(f"{path}.{task}.tmp", path)

        return write
    store, base = arrow_fs.FileSystem.from_uri(root)

    def put(file: str, body: bytes, task: str) -> None:
        path = f"{base}/{file}"
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(f"{path}.{task}.tmp") as out:
            out.write(body)
        store.move(f"{path}.{task}.tmp", path)

    return put


def write(pages: DataFrame, root: str, manifest: str) -> DataFrame:
    """Writes ``pages`` (url, content) below ``root``, a folder that all tasks reach, and returns the manifest (see ``placed``).

    Files are written where their rows are. A run that is repeated, or a task that is, writes the same files again. The manifest is a
    Parquet table in a folder of its own, written after the files, so what it names is there; a further run replaces it.
    """
    spark = pages.sparkSession
    where = stored(placed(pages))
    # Each different file once: the URL with the least name brings it.
    bring = where.groupBy("file", "blob_id").agg(F.min("url").alias("url"))
    bodies = pages.select("url", F.col("content").cast("binary").alias("content")).withColumn("blob_id", blob_id(F.col("content")))
    rows = bodies.join(bring, ["url", "blob_id"]).select("file", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        put, task = _writer(root.rstrip("/")), str(TaskContext.get().taskAttemptId())
        for batch in small_batches(batches, "content", BYTES):
            names = batch.column("file").to_pylist()
            for file, body in zip(names, batch.column("content").to_pylist(), strict=True):
                put(file, body, task)
            yield pa.RecordBatch.from_arrays([pa.array(names)], ["file"])
        give_back()

    with narrow_batches(spark):
        rows.mapInArrow(run, "file string").agg(F.count("*")).collect()
    where.write.mode("overwrite").parquet(manifest)
    return spark.read.schema(where.schema).parquet(manifest)
