"""Findings, summaries, facets and roll-ups over matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The order in which a finding's matches are read.
PLACE = ("blob_id", "start", "end")


def findings(matches: DataFrame) -> DataFrame:
    """Matches grouped by content: one row for each finding_id, with its number of matches and blobs."""
    return matches.groupBy("finding_id").agg(
        F.min("rule_id").alias("rule_id"), F.min("rule_name").alias("rule_name"), F.min("groups").alias("groups"),
        F.count("*").alias("n_matches"), F.countDistinct("blob_id").alias("n_blobs"),
    )


def first_matches(matches: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` matches of every finding, with their rank."""
    order = Window.partitionBy("finding_id").orderBy(*PLACE, "structural_id")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def summary(matches: DataFrame) -> DataFrame:
    """Matches, findings and blobs of each rule."""
    return matches.groupBy("rule_id").agg(F.count("*").alias("n_matches"), F.countDistinct("finding_id").alias("n_findings"), F.countDistinct("blob_id").alias("n_blobs"))


def roll_up(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Validation of each group: mean confidence of validated matches, and the status that dominates.

    ``valid`` dominates ``invalid``, which dominates ``undetermined``.
    """
    rank = F.when(F.col("status") == "valid", 1).when(F.col("status") == "invalid", 2).when(F.col("status") == "undetermined", 3)
    return matches.groupBy(*keys).agg(
        F.count("status").alias("n_validated"), F.avg(F.when(F.col("status").isNotNull(), F.col("confidence"))).alias("confidence"), F.min_by("status", rank).alias("status")
    )


def facets(rows: DataFrame, counted: Column | None = None) -> DataFrame:
    """Rows (facet, value, n) of findings with rule_name, categories (array) and status (null counts as ``-``).

    ``counted``: only these rows are counted, though all of them give values.
    """
    entries = F.concat(
        F.array(F.struct(F.lit("rule").alias("facet"), F.col("rule_name").alias("value"))),
        F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.struct(F.lit("category").alias("facet"), c.alias("value"))),
        F.array(F.struct(F.lit("validation").alias("facet"), F.coalesce("status", F.lit("-")).alias("value"))),
    )
    own = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    return rows.select(F.explode(entries).alias("e"), own.alias("own")).groupBy("e.facet", "e.value").agg(F.count_if("own").alias("n"))


def chosen(selection: dict[str, list[str]]) -> Column:
    """Rows that pass every facet with a selection; a facet passes if one of its selected values fits."""
    keep = F.lit(True)
    if rules := selection.get("rule"):
        keep = keep & F.col("rule_name").isin(*rules)
    if categories := selection.get("category"):
        keep = keep & F.arrays_overlap(F.coalesce("categories", F.array().cast("array<string>")), F.array(*map(F.lit, categories)))
    if statuses := selection.get("validation"):
        keep = keep & F.coalesce("status", F.lit("-")).isin(*statuses)
    return keep


def facets_under(rows: DataFrame, selection: dict[str, list[str]]) -> DataFrame:
    """All facet values, counted over the chosen rows; values without rows count 0. The rows are read once."""
    return facets(rows, chosen(selection))


def first_provenance(matches: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each match with the first path of its blob, or the blob id where none is known. ``provenance``: (blob_id, prov_id, path)."""
    first = provenance.groupBy("blob_id").agg(F.min_by("path", "prov_id").alias("path"))
    return matches.join(first, "blob_id", "left").withColumn("path", F.coalesce("path", "blob_id"))


def annotate(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Annotations after changes, both (target_type, target_id, status, comment, at): the last of each target stands."""
    return (
        annotations.unionByName(changes)
        .groupBy("target_type", "target_id")
        .agg(F.max_by(F.struct("status", "comment"), "at").alias("last"), F.max("at").alias("at"))
        .select("target_type", "target_id", "last.status", "last.comment", "at")
    )


def unseen(blobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Blobs whose id an earlier run has not met."""
    return blobs.join(seen.select("blob_id"), "blob_id", "left_anti")


def combined(*sources: DataFrame, most: int = 200_000) -> DataFrame:
    """Blobs (blob_id, path, text) of several sources; of equal ids the first source's first path stays.

    The winners among ids that have several rows are picked by id and path alone. Up to ``most`` of them are broadcast, and no
    text is moved then but those that one source lists twice under one path.
    """
    from trawl.plans.store import stored

    every = None
    for k, source in enumerate(sources):
        own = source.select("blob_id", "path", "text").withColumn("_source", F.lit(k))
        every = own if every is None else every.unionByName(own)
    places = every.groupBy("blob_id", "_source", "path").agg(F.count("*").alias("_n"))
    first = F.min(F.struct("_source", "path", "_n")).alias("_first")
    several = stored(places.groupBy("blob_id").agg(first, F.sum("_n").alias("_rows")).filter("_rows > 1").select("blob_id", "_first"))
    held = F.broadcast(several) if several.limit(most + 1).count() <= most else several
    own = every.join(held, "blob_id", "left").filter(F.col("_first").isNull() | ((F.col("_source") == F.col("_first._source")) & F.col("path").eqNullSafe(F.col("_first.path"))))
    kept = ["blob_id", "path", "text"]
    if several.filter("_first._n > 1").isEmpty():
        return own.select(kept)
    again = F.coalesce(F.col("_first._n"), F.lit(1)) > 1
    return own.filter(~again).select(kept).unionByName(own.filter(again).select(kept).dropDuplicates(["blob_id"]))
