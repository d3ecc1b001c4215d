"""A short way in: a scanner that holds a session, rules and options."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.ids import blob_id
from trawl.operators import rules, scan
from trawl.operators.rules import Rule
from trawl.operators.validate import Validator, validated
from trawl.sources import folder


class Scanner:
    """Scans texts, files and tables with one set of rules, the whole way: matches have ids, context and named groups,
    are not suppressed, and are the first of their content in a blob. ``validators`` and ``send`` add ``validation``."""

    def __init__(
        self, spark: SparkSession, pack: Iterable[Rule] | None = None, include: str = "", exclude: str = "", most_per_blob: int | None = None,
        context: int = 2, validators: list[Validator] | None = None, send: Callable[[dict], int | None] | None = None, workers: int = 4,
    ):
        self.spark, self.most, self.context, self.validators, self.send, self.workers = spark, most_per_blob, context, validators or [], send, workers
        pack = list(rules.BUILTIN if pack is None else pack)
        chosen = {r.id for r in rules.select(rules.frame(spark, pack), include, exclude).select("id").collect()} if include or exclude else None
        self.rules = [r for r in pack if chosen is None or r.id in chosen]
        rules.check(self.rules)

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    @property
    def validates(self) -> bool:
        return bool(self.validators and self.send)

    def scan_table(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Matches of a text or binary column, with the other columns of one row for each distinct content."""
        named = df if "blob_id" in df.columns else df.withColumn("blob_id", blob_id(F.coalesce(F.col(text), F.lit("").cast(df.schema[text].dataType))))
        found = scan.scan(named, self.rules, text, self.context, self.most)
        return validated(found, self.validators, self.send, self.workers) if self.validates else found

    def scan_texts(self, items: Iterable[tuple[str, str]]) -> DataFrame:
        """Matches of (source, text) pairs."""
        return self.scan_table(self.spark.createDataFrame(list(items), "source string, text string"))

    def scan_folder(self, root: str | Path, **options) -> DataFrame:
        """Matches of the files below a folder; ``options`` are those of ``sources.folder`` (hidden, extract, symlinks, most and others)."""
        found = folder.read(self.spark, str(root), **options).filter("left_out is null").drop("left_out")
        return self.scan_table(found, "content")

    def scan_target(self, target: str, **options) -> DataFrame:
        """Matches of a folder or file; addresses and repositories are refused, as nothing here reaches out."""
        if kind(target) != "path":
            raise ValueError(f"{target}: {kind(target)} targets need a table of their contents; give it to scan_table")
        return self.scan_folder(target, **options)


def kind(target: str) -> str:
    """What a target is: ``repository``, ``url`` or ``path``."""
    if re.search(r"\A(?:https?://|ssh://git@|git@)?(?:www\.)?git(?:hub|lab)\.com[/:][^/]+/.", target):
        return "repository"
    return "url" if re.match(r"https?://", target) else "path"
