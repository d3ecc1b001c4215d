"""Plans of requests that would test secrets, and what answers mean. Nothing here touches the network."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode, urlsplit, urlunsplit

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named groups that hold a secret, in the order in which they are asked for.
SECRET_GROUPS = ("secret", "token", "key", "password", "secret_key", "api_key")
AUTH = ("", "none", "bearer", "basic", "header", "query", "api_key")


@dataclass(frozen=True)
class Validator:
    name: str
    rule_ids: tuple[str, ...]
    method: str
    url: str
    auth: dict[str, str] = field(default_factory=dict)
    headers: tuple[tuple[str, str], ...] = ()
    body: str = ""
    success_codes: tuple[int, ...] = ()
    failure_codes: tuple[int, ...] = ()


def parse(text: str) -> list[Validator]:
    """Validators of a YAML document; ValueError for unknown kinds of auth, and for definitions without rules or url."""
    out = []
    for item in (yaml.safe_load(text) or {}).get("validators") or []:
        http = item.get("http") or {}
        auth = {k: str(v) for k, v in (http.get("auth") or {}).items()}
        if not item.get("rule_ids") or not http.get("url"):
            raise ValueError(f"validator {item.get('name')!r}: rule_ids and http.url are required")
        if auth.get("type", "") not in AUTH:
            raise ValueError(f"validator {item['name']}: auth type {auth['type']!r} is not known")
        headers = tuple((h["name"], str(h["value"])) for h in http.get("headers") or ())
        out.append(Validator(item["name"], tuple(item["rule_ids"]), http.get("method") or "GET", http["url"], auth, headers, http.get("body") or "", tuple(http.get("success_codes") or ()), tuple(http.get("failure_codes") or ())))
    return out


def filled(template: str, groups: dict[str, str]) -> str:
    """``{{name}}``, with blanks or a dot before the name, becomes that group; other marks stay."""
    return re.sub(r"\{\{ ?\.?([A-Za-z_]\w*) ?\}\}", lambda m: groups.get(m[1], m[0]), template)


def request(v: Validator, groups: dict[str, str]) -> dict:
    """Method, url, headers and body of a validator's request; ``error`` if the secret is missing."""
    plan = {"method": v.method, "url": filled(v.url, groups), "headers": {}, "body": filled(v.body, groups), "error": None}
    kind, secret = v.auth.get("type", ""), groups.get(v.auth.get("secret_group", ""))
    if secret is None:
        plan["error"] = f"named group {v.auth.get('secret_group', '')!r} not found"
        return plan
    if kind == "bearer":
        plan["headers"]["Authorization"] = f"Bearer {secret}"
    elif kind == "basic":
        pair = f"{v.auth.get('username') or secret}:{secret}"
        plan["headers"]["Authorization"] = "Basic " + base64.b64encode(pair.encode()).decode()
    elif kind == "header":
        plan["headers"][v.auth["header_name"]] = secret
    elif kind == "query":
        parts = urlsplit(plan["url"])
        plan["url"] = urlunsplit(parts._replace(query="&".join(filter(None, [parts.query, urlencode({v.auth["query_param"]: secret})]))))
    elif kind == "api_key":
        plan["headers"]["Authorization"] = v.auth.get("key_prefix", "key=") + secret
    plan["headers"].update((k, filled(value, groups)) for k, value in v.headers)
    return plan


def secret_of(named: Column, matching: Column) -> Column:
    """The secret of a match: its best named group, else all of it."""
    return F.coalesce(*[named[g] for g in SECRET_GROUPS], matching)


def verdict(code: Column, success: Column, failure: Column) -> Column:
    """(status, confidence) of an answer; no answer is undetermined with confidence 0."""
    status = F.when(code.isNull(), "undetermined").when(F.array_contains(success, code), "valid").when(F.array_contains(failure, code), "invalid").otherwise("undetermined")
    confidence = F.when(code.isNull(), 0.0).when(F.array_contains(success, code) | F.array_contains(failure, code), 1.0).otherwise(0.5)
    return F.struct(status.alias("status"), confidence.alias("confidence"))


def validated(matches: DataFrame, validators: list[Validator], send: Callable[[dict], int | None], parts: int = 4) -> DataFrame:
    """``matches`` (rule_id, named map, matching) with ``validation``. Each distinct secret of a rule is sent once.

    The first validator that names a rule is its validator. ``send`` gets a request plan on an executor and
    gives a status code, or None; ``parts`` bounds how many run at once.
    """
    spark = matches.sparkSession
    first: dict[str, Validator] = {}
    for v in validators:
        for rule in v.rule_ids:
            first.setdefault(rule, v)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = []
            for rule, named in zip(frame["rule_id"], frame["named"], strict=True):
                plan = request(first[rule], dict(named or {}))
                codes.append(None if plan["error"] else send(plan))
            yield pd.DataFrame({"rule_id": frame["rule_id"], "secret": frame["secret"], "code": pd.array(codes, "Int64")})

    keyed = matches.withColumn("secret", secret_of(F.col("named"), F.col("matching")))
    known = keyed.filter(F.col("rule_id").isin(*first)) if first else keyed.limit(0)
    asked = known.groupBy("rule_id", "secret").agg(F.any_value("named").alias("named")).repartition(parts, "rule_id", "secret").mapInPandas(ask, "rule_id string, secret string, code long")
    codes = spark.createDataFrame([(r, list(v.success_codes), list(v.failure_codes)) for r, v in first.items()], "rule_id string, success array<long>, failure array<long>")
    judged = asked.join(codes, "rule_id").select("rule_id", "secret", verdict(F.col("code"), F.col("success"), F.col("failure")).alias("validation"))
    none = F.struct(F.lit("undetermined").alias("status"), F.lit(0.0).alias("confidence"))
    return keyed.join(judged, ["rule_id", "secret"], "left").withColumn("validation", F.coalesce("validation", none)).drop("secret")
