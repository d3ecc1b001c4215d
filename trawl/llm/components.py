"""Connected components as DataFrame joins, for links that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label): the smallest node of each component, for every node of ``links`` (a, b).

    Each round takes the least label among a node's neighbours and then that label's own label, so labels
    travel distances that double; it ends with the first round that changes none. Every round is written
    to the shared folder, so nothing has to be computed again when an executor is lost.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("lower"))
        lower = stored(lower)
        parents = lower.select(F.col("node").alias("parent"), F.col("lower").alias("parents"))
        nearer = lower.join(parents, F.col("lower") == F.col("parent")).select("node", F.least("lower", "parents").alias("new"), "label")
        nearer = stored(nearer)
        if nearer.filter("new <> label").isEmpty():
            return nearer.select("node", F.col("new").alias("label"))
        labels = nearer.select("node", F.col("new").alias("label"))
