"""Reports: JSON findings, SARIF 2.1.0, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def snippet(before: Column, matching: Column, after: Column, most: int = 500) -> Column:
    """The match in the middle of at most ``most`` characters of its context, with marks where text is cut."""
    room = F.greatest(F.lit(most) - F.length(matching), F.lit(0))
    left = F.least(F.length(before), F.greatest(F.floor(room / 2), room - F.length(after))).cast("int")
    right = F.least(F.length(after), room - left).cast("int")
    head = F.when(left > 0, F.substring(before, -left, left)).otherwise(F.lit(""))
    core = F.substring(matching, 1, most)
    return F.concat(
        F.when(left < F.length(before), F.lit("...")).otherwise(F.lit("")), head, core, F.substring(after, F.lit(1), right),
        F.when((right < F.length(after)) | (F.length(matching) > most), F.lit("...")).otherwise(F.lit("")),
    )


def findings_json(matches: DataFrame) -> DataFrame:
    """JSON lines (finding_id, json): a head for each finding, with the count of its matches, and one line for each match.

    No row holds more than one match; ``blob_id`` and ``start`` give the matches of a finding their order.
    """
    heads = matches.groupBy("finding_id").agg(F.min("rule_id").alias("rule_id"), F.min("rule_name").alias("rule_name"), F.min("groups").alias("groups"), F.count("*").alias("n_matches"))
    head = heads.select("finding_id", F.to_json(F.struct("finding_id", "rule_id", "rule_name", "groups", "n_matches")).alias("json"))
    place = F.struct("blob_id", "start", "end", "start_line", "start_column", "matching")
    return head.unionByName(matches.select("finding_id", F.to_json(F.struct("finding_id", place.alias("match"))).alias("json")))


def sarif_results(matches: DataFrame, path: Column) -> DataFrame:
    """A SARIF result for each match, as JSON; absolute paths become file URIs."""
    uri = F.when(path.startswith("/"), F.concat(F.lit("file://"), path)).otherwise(path)
    region = F.struct(
        F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"),
        F.struct(F.col("matching").alias("text")).alias("snippet"),
    )
    location = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.concat(F.lit("Found "), F.col("rule_name")).alias("text")).alias("message"),
        F.array(location).alias("locations"), F.struct(F.col("structural_id").alias("matchId")).alias("partialFingerprints"),
    )
    return matches.select("structural_id", F.to_json(result).alias("json"))


def sarif_rules(rules: DataFrame) -> DataFrame:
    """A row (id, json) for each rule as a SARIF log describes it; the first reference is its help address."""
    help_uri = F.get(F.coalesce("references", F.array().cast("array<string>")), 0)
    text = F.struct(F.coalesce("description", F.lit("")).alias("text"))
    return rules.select("id", F.to_json(F.struct("id", "name", text.alias("shortDescription"), help_uri.alias("helpUri"))).alias("json"))


def write_sarif(matches: DataFrame, path: Column, rules: DataFrame, file: str) -> None:
    """One valid SARIF log: the parts are written by Spark and put together behind each other in the file system.

    The driver copies streams and holds no part whole; ``file`` appears under its name when it is complete.
    """
    spark, temporary = matches.sparkSession, f"{file}.parts"
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"trawl","rules":['
    sarif_rules(rules).orderBy("id").select(F.col("json").alias("value")).write.mode("overwrite").text(f"{temporary}/rules")
    sarif_results(matches, path).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{temporary}/results")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(file)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{temporary}/log"))
    for name, before in (("rules", head), ("results", ']}},"results":[')):
        out.write(bytearray(before.encode()))
        first = True
        for status in sorted(fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{temporary}/{name}")), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-") and status.getLen():
                lines = fs.open(status.getPath())
                reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(lines, "UTF-8"))
                while (line := reader.readLine()) is not None:
                    out.write(bytearray((("" if first else ",") + line).encode()))
                    first = False
                reader.close()
    out.write(bytearray(b"]}]}"))
    out.close()
    fs.delete(where, False)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{temporary}/log"), where)
    fs.delete(jvm.org.apache.hadoop.fs.Path(temporary), True)


def rendered(matches: DataFrame, most: int = 500) -> DataFrame:
    """Lines (finding_id, rank, line) of a report for people: a head for each finding, and its first three matches as snippets.

    ``matches`` have ``before`` and ``after``.
    """
    from trawl.operators.findings import first_matches

    heads = matches.groupBy("finding_id").agg(F.min("rule_name").alias("name"), F.min("rule_id").alias("rule"), F.min("groups").alias("groups"), F.count("*").alias("n"))
    head = heads.select("finding_id", F.lit(0).alias("rank"), F.concat("name", F.lit(" ("), "rule", F.lit("): "), F.array_join("groups", ", "), F.lit(", "), F.col("n").cast("string"), F.lit(" matches")).alias("line"))
    place = F.concat(F.substring("blob_id", 1, 12), F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), F.col("start_column").cast("string"), F.lit(": "))
    shown = first_matches(matches).select("finding_id", "rank", F.concat(place, snippet(F.col("before"), F.col("matching"), F.col("after"), most)).alias("line"))
    return head.unionByName(shown)
