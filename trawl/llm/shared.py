"""What the operators share: the word class, nested bindings, and tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, and those of words, as regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as tell it from all of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(columns: list[str], *without: str) -> list[str]:
    """The columns besides those named, which an operator reads, leaves out or gives itself."""
    named = {c.lower() for c in without}
    return [c for c in columns if c.lower() not in named]


def together(columns: list[str]) -> Column:
    """The named columns as one struct, which keeps their names apart from those that an operator works with."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]) if columns else F.struct(F.lit(True).alias("none"))


def apart(column: str, columns: list[str]) -> list[Column]:
    """The columns that ``together`` put into ``column``."""
    return [F.col(column).getField(c).alias(c) for c in columns]


def joined(rows: DataFrame, table: DataFrame, on: Column, how: str = "inner", most: int = 200_000) -> DataFrame:
    """``rows`` joined to a ``table`` that is broadcast if it has at most ``most`` rows; Spark chooses otherwise."""
    return rows.join(F.broadcast(table) if table.limit(most + 1).count() <= most else table, on, how)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors can all reach.

    It lies below ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine (tests), a temporary
    folder takes its place. It is deleted when the driver's Python ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.trawl.shared.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trawl-")
        spark.conf.set("spark.trawl.shared.dir", base)
    path = f"{base.rstrip('/')}/trawl-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system for ``path`` and the path itself, as JVM objects of the driver."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


_scratch: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes within, unless to a folder of their own, are deleted at the end."""
    folder = shared_folder(spark)
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.pop()
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and the folder may be gone
        fs, where = filesystem(spark, path)
        fs.delete(where, True)


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder in one step; raises FileExistsError if the target is there already."""
    jvm = spark.sparkContext._jvm
    fs, path = filesystem(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        if fs.exists(path):
            raise FileExistsError(target)
        context.rename(jvm.org.apache.hadoop.fs.Path(source), path, none)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise FileExistsError(target) from e
        raise


def stored(df: DataFrame, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than rereading the table.
    """
    spark = df.sparkSession
    path = f"{folder or (_scratch[-1] if _scratch else shared_folder(spark))}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def frugal(compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``compute`` for mapInArrow, which gives the memory it has freed back to the system at the end of a task.

    Python workers live on from task to task and stage to stage, and what they keep counts against their executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compute(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # there is no such call outside glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run
