"""Reading a scan's tables again: findings with their matches, provenance, annotations and rules; orders, counters, proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.operators.findings import roll_up

#: What a list of findings can be ordered by.
ORDERS = ("rule_name", "n_matches", "status", "confidence", "annotation")
STATES = ("completed", "skipped", "timeout", "error")

# Names next to the second and third part of a credential.
SECRET_KEY = r"(?i)aws_?secret_?(?:access_?)?key[\"']?\s*(?:=|:|=>)\s*[\"']?([A-Za-z0-9/+=]{40})"
SESSION_TOKEN = r"(?i)aws_?session_?token[\"']?\s*(?:=|:|=>)\s*[\"']?([A-Za-z0-9/+=]{16,})"
#: Values of parse events that are looked back upon, and the sizes of keys.
LOOK_BACK, KEY_SIZES = 8, (8, 16, 24, 32)
CAPTURED = ("javascript", "json", "source-map", "text/plain", "text/html", "xml")
RESOURCES = ("document", "script", "xhr", "fetch")


def report_rows(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Every finding with its matches, one row for each; ``by`` tells how they were found.

    Matches with the finding's id come first (``id``). A finding without any takes those of its rule with equal groups
    (``groups``, for tables whose ids were made otherwise), and one without these either stays alone (``none``).
    ``findings`` has finding_id, rule_id and groups; of ``matches`` structural_id, blob_id, start and end are kept.
    """
    kept = ["structural_id", "blob_id", "start", "end"]
    own = findings.join(matches.select("finding_id", *kept), "finding_id", "left")
    with_id = own.filter("structural_id is not null").withColumn("by", F.lit("id"))
    lost = own.filter("structural_id is null").drop(*kept)
    fallback = lost.join(matches.select("rule_id", "groups", *kept), ["rule_id", "groups"], "left")
    fallback = fallback.withColumn("by", F.when(F.col("structural_id").isNull(), "none").otherwise("groups"))
    return with_id.unionByName(fallback.select(with_id.columns))


def all_provenance(matches: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each match with every path of its blob, as rows in the order of ``prov_id``; a match without any keeps one row."""
    rank = F.row_number().over(Window.partitionBy("structural_id").orderBy("prov_id"))
    return matches.join(provenance.select("blob_id", "prov_id", "path"), "blob_id", "left").withColumn("place", rank)


def annotated(rows: DataFrame, annotations: DataFrame, target: str, key: str) -> DataFrame:
    """``rows`` with the annotation (status, comment) of their ``key``, null where there is none."""
    own = annotations.filter(F.col("target_type") == target)
    own = own.select(F.col("target_id").alias(key), F.col("status").alias("annotation"), F.col("comment").alias("comment"))
    return rows.join(own, key, "left")


def with_rules(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """``matches`` with their rule's categories; raises if a match names a rule that is not there."""
    known = rules.select(F.col("id").alias("rule_id"), "categories")
    missing = [r[0] for r in matches.join(known, "rule_id", "left_anti").select("rule_id").distinct().limit(5).collect()]
    if missing:
        raise ValueError(f"unknown rules: {', '.join(missing)}")
    return matches.join(known, "rule_id")


def overview(matches: DataFrame, rules: DataFrame, annotations: DataFrame, provenance: DataFrame) -> DataFrame:
    """What a triage list shows: a row for each finding with counts, validation, annotation and its first path.

    ``matches`` have finding_id, rule_id, rule_name, structural_id, blob_id, status and confidence.
    """
    counted = matches.groupBy("finding_id").agg(F.count("*").alias("n_matches"), F.countDistinct("blob_id").alias("n_blobs"), F.min("blob_id").alias("blob_id"))
    rolled = roll_up(matches, ["finding_id", "rule_id", "rule_name"])
    paths = provenance.groupBy("blob_id").agg(F.min_by("path", "prov_id").alias("path"))
    found = rolled.join(counted, "finding_id").join(paths, "blob_id", "left").withColumn("path", F.coalesce("path", "blob_id")).drop("blob_id")
    return annotated(with_rules(found, rules), annotations, "finding", "finding_id")


def ordered(rows: DataFrame, by: str = "rule_name", descending: bool = False) -> DataFrame:
    """Findings by one of ORDERS, then by rule name and id, so that the order is the same each time; nulls come first."""
    if by not in ORDERS:
        raise ValueError(f"unknown order {by!r}; one of {', '.join(ORDERS)}")
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    return rows.orderBy(first, "rule_name", "finding_id")


def ordered_facets(facets: DataFrame) -> DataFrame:
    return facets.orderBy("facet", "value")


def ordered_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifacts.orderBy("category", "line", "value", "method", "detail", "column")


def counters(blobs: DataFrame, size: Column, binary: Column, most: int) -> DataFrame:
    """One row: blobs and bytes that a scan reads, and those left out for their size or as binary."""
    large = size > most
    skip = large | binary
    return blobs.agg(
        F.count_if(~skip).alias("n_scanned"), F.sum(F.when(~skip, size).otherwise(0)).cast("long").alias("n_bytes"),
        F.count_if(large).alias("n_too_large"), F.count_if(~large & binary).alias("n_binary"),
    )


def merged_stats(stats: DataFrame) -> DataFrame:
    """Statistics of each rule over chunks (rule_id, state, n_matches, seconds): the worst state, sums of the rest."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return stats.groupBy("rule_id").agg(F.max_by("state", rank).alias("state"), F.sum("n_matches").cast("long").alias("n_matches"), F.sum("seconds").alias("seconds"), F.count("*").alias("n_chunks"))


def plausible_key(value: Column) -> Column:
    """A printable value of a key's size."""
    return F.octet_length(value).isin(*KEY_SIZES) & value.rlike(r"\A[^\p{Cntrl}]*\z")


def looked_back(events: DataFrame, order: list[str], parsed: Column, value: Column, wanted: Column, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """The ``wanted`` events of each target with ``candidate``: the latest plausible key among the last LOOK_BACK parse events before.

    Only a number of values is carried along: each event sees the last eight, whatever the length of a target's history.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    entry = F.when(parsed & (value != ""), value)
    # The number of parse events so far names the run of events that see the same eight values.
    told = events.withColumn("_entry", entry).withColumn("_seen", F.count(entry).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    values = told.filter(F.col("_entry").isNotNull()).select(*keys, *order, "_entry", (F.col("_seen") + 1).alias("_number"))
    recent = F.collect_list("_entry").over(Window.partitionBy(*keys).orderBy("_number").rowsBetween(-(LOOK_BACK - 1), 0))
    best = F.element_at(F.filter(F.concat(F.array(F.lit("")), recent), lambda v: (v == "") | plausible_key(v)), -1)
    seen = values.select(*keys, F.col("_number").alias("_seen"), F.nullif(best, F.lit("")).alias("candidate"))
    return told.filter(wanted).drop("_entry").join(seen, [*keys, "_seen"], "left").drop("_seen")


def paired(matches: DataFrame, key_rules: list[str]) -> DataFrame:
    """Matches of key ids with the secret key and session token that their ``after`` holds; ``complete`` if the secret is there."""
    found = matches.filter(F.col("rule_id").isin(*key_rules))
    part = lambda pattern: F.nullif(F.regexp_extract(F.coalesce("after", F.lit("")), pattern, 1), F.lit(""))
    return found.withColumns({"secret_key": part(SECRET_KEY), "session_token": part(SESSION_TOKEN)}).withColumn("complete", F.col("secret_key").isNotNull())


def paired_near(matches: DataFrame, key_rules: list[str], secret_rules: list[str], within: int = 1000) -> DataFrame:
    """Matches of key ids with the nearest secret of the same blob, before or behind, no further than ``within`` bytes away.

    ``matches`` (blob_id, rule_id, structural_id, start, end, groups). Columns: blob_id, key_id (structural_id), key, secret_id,
    secret, side, distance (bytes between the two); keys without a secret keep one row. Of equal distances the one behind the
    key counts, then the earlier one, then the smaller id. Places are dealt into bins of ``within`` bytes and a secret is sent to its own bin and the ones next
    to it, so keys meet only what may be near, however many a blob holds.
    """
    value = F.get("groups", 0)
    keys = matches.filter(F.col("rule_id").isin(*key_rules)).select("blob_id", F.col("structural_id").alias("key_id"), value.alias("key"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    secrets = matches.filter(F.col("rule_id").isin(*secret_rules)).select("blob_id", F.col("structural_id").alias("secret_id"), value.alias("secret"), "start", "end")
    bin_of = lambda place: F.floor(place / within)
    reach = F.explode(F.sequence(bin_of(F.col("start") - within), bin_of(F.col("end") + within))).alias("_bin")
    met = keys.select("*", bin_of(F.col("_from")).alias("_bin")).join(secrets.select("*", reach), ["blob_id", "_bin"])
    behind = F.col("start") >= F.col("_to")
    gap = F.when(behind, F.col("start") - F.col("_to")).when(F.col("end") <= F.col("_from"), F.col("_from") - F.col("end"))
    near = met.withColumn("distance", gap).filter(F.col("distance") <= within)
    order = F.struct("distance", (~behind).cast("int"), "start", "secret_id")
    best = near.groupBy("key_id").agg(F.min_by(F.struct("secret_id", "secret", F.when(behind, "behind").otherwise("before").alias("side"), "distance"), order).alias("b"))
    return keys.drop("_from", "_to").join(best, "key_id", "left").select("blob_id", "key_id", "key", "b.*")


def captured(status: Column, content_type: Column, resource: Column) -> Column:
    """Whether a recorded response is kept: it succeeded, and is of a kind of text or was loaded as one."""
    kind = F.lit(False)
    for word in CAPTURED:
        kind = kind | F.contains(F.lower(content_type), F.lit(word))
    return status.between(200, 299) & (F.coalesce(kind, F.lit(False)) | F.coalesce(F.lower(resource).isin(*RESOURCES), F.lit(False)))


def resolvable(urls: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """URLs whose host a table (host) of names that resolve holds; addresses and other schemes pass."""
    from trawl.functions.urls import hostname, scheme

    name = hostname(F.col(url))
    passes = ~scheme(F.col(url)).isin("http", "https") | name.rlike(r"\A[0-9.]+\z|\A\[") | (name == "")
    known = urls.withColumn("_host", name).withColumn("_passes", passes).join(hosts.select(F.lower("host").alias("_host"), F.lit(True).alias("_known")).distinct(), "_host", "left")
    return known.filter(F.col("_passes") | F.coalesce("_known", F.lit(False))).drop("_host", "_passes", "_known")
