"""Public suffixes of host names, from a table of rules: plain ones, wildcards (``*.ck``) and exceptions (``!www.ck``)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.urls import host, hostname

#: Rules that a table may hold; the public list has about ten thousand.
MOST = 200_000
Trie = dict[str, "Trie"]
#: The key under which a node of the trie says what ends there: ``rule`` or ``exception``. No label has a dot.
ENDS = "."


def trie(rules: Iterable[str]) -> Trie:
    """The rules by their labels from the last one on."""
    root: Trie = {}
    for line in rules:
        rule = line.strip().lower()
        if not rule or rule.startswith("//"):
            continue
        node = root
        for label in reversed(rule.lstrip("!").strip(".").split(".")):
            node = node.setdefault(label.encode("idna").decode() if not label.isascii() else label, {})
        node[ENDS] = {"exception" if rule.startswith("!") else "rule": {}}
    return root


def suffix_length(labels: list[str], root: Trie) -> int:
    """How many of the last labels are the public suffix: an exception counts before the longest rule, one label if no rule fits."""
    longest, nodes = 1, [root]
    for depth, label in enumerate(reversed(labels), 1):
        nodes = [n[k] for n in nodes for k in (label, "*") if k in n]
        for node in nodes:
            what = node.get(ENDS, {})
            if "exception" in what:
                return depth - 1
            if "rule" in what:
                longest = max(longest, depth)
        if not nodes:
            break
    return longest


def domain(name: str, root: Trie) -> str | None:
    """The public suffix of a host name and the label before it; null where there is none, as for suffixes and addresses."""
    name = name.lower().rstrip(".")
    if not name or ":" in name or name.startswith("[") or re.fullmatch(r"[0-9.]+", name):
        return None
    labels = name.split(".")
    n = suffix_length(labels, root)
    return ".".join(labels[-n - 1 :]) if len(labels) > n and all(labels) else None


def known(suffixes: DataFrame) -> Trie:
    """The trie of a table (suffix), which is small: at most MOST rules."""
    rows = [r[0] for r in suffixes.select("suffix").filter("suffix is not null").limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} suffixes")
    return trie(rows)


def registered(name: Column, root: Trie) -> Column:
    """``domain`` of a column of host names."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        found: dict[str, str | None] = {}
        return pd.Series([None if n is None else found.setdefault(n, domain(n, root)) for n in names], dtype="object")

    return run(name)


def in_domain(url: Column, target: Column, suffixes: DataFrame) -> Column:
    """Whether two URLs have one registered domain; where one of them has none, whether they have one host."""
    root = known(suffixes)
    one, two = registered(hostname(url), root), registered(hostname(target), root)
    return F.when(one.isNotNull() & two.isNotNull(), one == two).otherwise(F.lower(host(url)) == F.lower(host(target)))
