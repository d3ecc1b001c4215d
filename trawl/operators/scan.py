"""The whole way from blobs to matches: each distinct blob once, candidates, matches, expansion, suppression, ids, first of equals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators import aesflow, detect, suppress
from trawl.operators.rules import Rule

#: Rules whose matches are wrapper functions that encrypt passwords; their groups name the function, its key's source and its key.
WRAPPERS = ("tr.js.crypto.1",)
#: What the wrapper's calls are known by.
MODE = {"cipher": "AES", "mode": "ECB", "padding": "Pkcs7"}


def expanded(matches: DataFrame) -> DataFrame:
    """``matches`` (of a scan with ``whole``) in which each wrapper that does not hold its password is replaced by its call sites.

    A call site is a match of the same rule at the call's place, with the argument as its group and what is known of the
    wrapper as named groups; a wrapper that is never called stays.
    """
    kept = [f for f in matches.schema.fields if f.name != "content"]
    names = [f.name for f in kept]
    wrapper = F.col("rule_id").isin(*WRAPPERS) & F.col("named")["password"].isNull()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                body, groups = row.pop("content") or "", dict(row["named"] or ())
                function = groups.get("encryptor") or ""
                data = body.encode("utf-8", "replace")
                after = len(data[: row["start"]].decode("utf-8", "ignore"))
                sites = aesflow.calls(body, after, function) if function else []
                key = groups.get("static_key") or (aesflow.assigned(body, after, groups["key_source"]) if groups.get("key_source") else None)
                for start, end, argument, is_literal in sites:
                    found = {**MODE, "encryptor": function, "argument": argument, "kind": "literal" if is_literal else "expression"}
                    if aesflow.is_key(key):
                        found["aes_key"] = key
                    first, last = (len(body[:k].encode("utf-8", "replace")) for k in (start, end))
                    place = [x for at in (first, last) for x in (data.count(b"\n", 0, at) + 1, at - data.rfind(b"\n", 0, at))]
                    before, behind = detect.surroundings(data, first, last, 2)
                    new = {"start": first, "end": last, "start_line": place[0], "start_column": place[1], "end_line": place[2], "end_column": place[3]}
                    new |= {"matching": body[start:end], "groups": [argument], "named": found, "before": before.decode("utf-8", "replace"), "after": behind.decode("utf-8", "replace")}
                    out.append({**row, **{k: v for k, v in new.items() if k in row}})
                if not sites:
                    out.append(row)
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    # Only wrappers are moved to Python; all other matches pass by.
    return matches.filter(~wrapper).select(*names).unionByName(matches.filter(wrapper).mapInPandas(run, schema))


def scan(blobs: DataFrame, rules: Iterable[Rule], text: str = "text", context: int = 2, most: int | None = None, suppressed: bool = True) -> DataFrame:
    """Matches of blobs (blob_id, ``text``, others), with ids, context and named groups; of equal contents in a blob the first.

    Each distinct blob is scanned once: other columns are those of one row of it, so provenance belongs in a table of its own.
    """
    rules = list(rules)
    whole = [r.id for r in rules if r.id in WRAPPERS]
    distinct = blobs.dropDuplicates(["blob_id"])
    found = detect.with_python(distinct, rules, text, most, context, whole)
    if whole:
        found = expanded(found)
    if suppressed:
        found = suppress.unsuppressed(found)
    return detect.first_by_content(detect.with_ids(found))
