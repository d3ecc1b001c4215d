"""Numbers over a whole table that no task sees whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, order: list[str], name: str = "number", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place, from 1, in the given order (nulls first), within equal ``keys`` if there are any.

    Rows are dealt out by ranges of keys and order and numbered there; the sums of the ranges before are added.
    """
    from trawl.plans.store import stored

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # for each key as many rows as it has ranges
    before = F.sum("_n").over(Window.partitionBy(*(keys or (F.lit(0),))).orderBy("_part")) - F.col("_n")
    sums = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_range"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    placed = dealt.withColumn("_within", within).join(sums, same)
    return placed.select(*df.columns, (F.col("_before") + F.col("_within")).cast("long").alias(name))
