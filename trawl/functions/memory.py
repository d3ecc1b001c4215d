"""Memory of Python workers, which live on from task to task: what they keep counts against their executor."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of the batches that a worker is given at once.
ROWS, BYTES = 1000, 4 << 20


def give_back() -> None:
    """Gives the memory that has been freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def narrow_batches(spark: SparkSession, rows: int = ROWS):
    """Actions within give workers batches of at most ``rows`` rows and about BYTES bytes, or one row; else 10,000 rows of any size come at once."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
