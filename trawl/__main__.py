"""The command line: ``python -m trawl scan|report|rules``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    """The session that spark-submit gives, or a local one."""
    return SparkSession.builder.appName("trawl").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="trawl", description="Finds secrets in large corpora.")
    commands = main.add_subparsers(dest="command", required=True)
    pick = argparse.ArgumentParser(add_help=False)
    pick.add_argument("--rules", default="", help="a YAML file or folder; the built-in pack without it")
    pick.add_argument("--include", default="", help="only rules whose id matches one of these expressions, with commas between")
    pick.add_argument("--exclude", default="", help="no rules whose id matches one of these expressions")
    scan = commands.add_parser("scan", parents=[pick], help="scan a folder into a store")
    scan.add_argument("target")
    scan.add_argument("--store", required=True)
    scan.add_argument("--incremental", action="store_true", help="leave out blobs that the store knows")
    scan.add_argument("--context", type=int, default=3, help="lines around a match")
    scan.add_argument("--max-file-size", default="20MB")
    scan.add_argument("--hidden", action="store_true", help="also files and folders whose names begin with a dot")
    scan.add_argument("--extract", action="store_true", help="also members of archives and documents")
    report = commands.add_parser("report", parents=[pick], help="report a store's findings")
    report.add_argument("--store", required=True)
    report.add_argument("--format", choices=("human", "json", "sarif"), default="human")
    report.add_argument("--output", default="", help="a folder (json) or file (sarif)")
    listed = commands.add_parser("rules", parents=[pick], help="list rules")
    listed.add_argument("--format", choices=("table", "json"), default="table")
    return main


def chosen(spark: SparkSession, given: argparse.Namespace) -> list:
    from trawl.operators import rules

    pack = rules.load(given.rules) if given.rules else list(rules.pack())
    kept = {r.id for r in rules.select(rules.frame(spark, pack), given.include, given.exclude).select("id").collect()}  # the rules given by hand
    return [r for r in pack if r.id in kept]


def run_scan(spark: SparkSession, given: argparse.Namespace, out) -> None:
    from trawl.api import kind
    from trawl.functions.text import size_in_bytes
    from trawl.operators.findings import summary
    from trawl.plans.store import Store, scan
    from trawl.sources import folder

    if kind(given.target) != "path":
        raise SystemExit(f"{given.target}: only folders are scanned; read others into a table first")
    most = spark.range(1).select(size_in_bytes(F.lit(given.max_file_size))).first()[0]
    if most is None:
        raise SystemExit(f"{given.max_file_size!r} is no size")
    found = folder.read(spark, given.target, most=most, hidden=given.hidden, extract=given.extract).filter("left_out is null")
    found = found.select("blob_id", F.concat_ws(":", "path", "member").alias("path"), F.decode("content", "utf-8").alias("text"))
    matches = scan(Store(spark, given.store), found, chosen(spark, given), given.incremental, given.context)
    for row in summary(matches).orderBy("rule_id").toLocalIterator():  # a row for each rule
        print(f"{row.rule_id}\t{row.n_findings} findings\t{row.n_matches} matches\t{row.n_blobs} blobs", file=out)


def run_report(spark: SparkSession, given: argparse.Namespace, out) -> None:
    from trawl.operators import report, rules
    from trawl.operators.findings import first_provenance
    from trawl.plans.store import Store

    store = Store(spark, given.store)
    matches = store.table("matches")
    if matches is None:
        raise SystemExit(f"{given.store} holds no matches")
    if given.format == "human":
        lines = report.rendered(matches).orderBy("finding_id", "rank").select("line")
        for row in lines.toLocalIterator():  # one partition at a time
            print(row.line, file=out)
        return
    if not given.output:
        raise SystemExit("--output is needed")
    if given.format == "json":
        report.findings_json(matches).select(F.col("json").alias("value")).write.text(given.output)
    else:
        paths = store.table("provenance").withColumn("prov_id", F.col("path"))
        report.write_sarif(first_provenance(matches, paths), F.col("path"), rules.frame(spark, chosen(spark, given)), given.output)


def run_rules(spark: SparkSession, given: argparse.Namespace, out) -> None:
    for rule in chosen(spark, given):
        if given.format == "json":
            print(json.dumps({"id": rule.id, "name": rule.name, "categories": rule.categories, "pattern": rule.pattern}), file=out)
        else:
            first = rule.categories[0] if rule.categories else "-"
            more = f" (+{len(rule.categories) - 1})" if rule.categories[1:] else ""
            print(f"{rule.id}\t{rule.name}\t{first}{more}", file=out)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> None:
    given = parser().parse_args(arguments)
    {"scan": run_scan, "report": run_report, "rules": run_rules}[given.command](spark or session(), given, out)


if __name__ == "__main__":
    main()
