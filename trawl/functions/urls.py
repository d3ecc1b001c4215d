"""URLs: mirrored paths, repositories, scopes."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import let

#: A host without its port, and a scheme, of an absolute URL.
HOST = r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


def host(url: Column) -> Column:
    """Host and port, in lower case; empty if the URL has none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def hostname(url: Column) -> Column:
    return F.regexp_replace(host(url), r":[0-9]*\z", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)


def safe_segment(value: Column) -> Column:
    """A file name of letters, digits, dots, dashes, underscores and equals signs."""
    kept = F.regexp_replace(F.trim(value), r"[^\p{L}\p{Nd}._=-]+", "_")
    return let(F.regexp_replace(kept, r"\A[._\- ]+|[._\- ]+\z", ""), lambda s: F.when(s == "", F.lit("_")).otherwise(s))


def mirror_path(url: Column) -> Column:
    """Where a mirror keeps a URL's content: host and path as folders, the query in the file's name."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    segments = F.transform(parts, lambda s: safe_segment(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)))
    folder = F.when((F.size(segments) == 0) | path(url).endswith("/"), F.concat(segments, F.array(F.lit("index")))).otherwise(segments)

    def name(all_: Column) -> Column:
        last = F.element_at(all_, -1)
        extension = F.regexp_extract(last, r"(\.[^.]*)\z", 1)
        base = F.substring(last, F.lit(1), F.length(last) - F.length(extension))
        token = safe_segment(query(url))
        short = F.when(F.octet_length(token) <= 80, token).otherwise(F.concat(F.substring(token, 1, 80), F.lit("_"), F.substring(F.sha1(query(url).cast("binary")), 1, 8)))
        named = F.concat(F.when(base == "", F.lit("index")).otherwise(base), F.lit("__query_"), short, extension)
        return F.array_join(F.concat(F.array(safe_segment(host(url))), F.slice(all_, 1, F.size(all_) - 1), F.array(F.when(query(url) != "", named).otherwise(last))), "/")

    return F.when(host(url) != "", let(folder, name))


def repository(reference: Column) -> Column:
    """A reference to a GitHub or GitLab repository as (platform, owner, repo, full_path); null for others."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(reference), r"[?#].*\z", ""), r"/-/.*\z", ""), r"/+\z", "")
    at = F.regexp_extract(clean, r"(?i)\A(?:https?://|ssh://git@|git@)?(?:www\.)?(github|gitlab)\.com[/:](.+)\z", 2)
    platform = F.lower(F.regexp_extract(clean, r"(?i)\A(?:https?://|ssh://git@|git@)?(?:www\.)?(github|gitlab)\.com[/:](.+)\z", 1))
    parts = F.split(F.regexp_replace(at, r"\.git\z", ""), "/")
    kept = F.when(platform == "github", F.slice(parts, 1, 2)).otherwise(parts)
    owner = F.array_join(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), "/")
    found = F.struct(platform.alias("platform"), owner.alias("owner"), F.regexp_replace(F.element_at(kept, -1), r"\.git\z", "").alias("repo"), F.regexp_replace(F.array_join(kept, "/"), r"\.git\z", "").alias("full_path"))
    return F.when((platform != "") & (F.size(parts) >= 2), found)


def registered_domain(url: Column, suffixes: list[str] | None = None) -> Column:
    """The host's public suffix and the label before it. Suffixes of several labels (``co.uk``) are those given."""
    name = hostname(url)
    labels = F.lit(2)
    for suffix in sorted(suffixes or [], key=lambda s: s.count(".")):
        labels = F.when(name.endswith("." + suffix.lower()), F.lit(suffix.count(".") + 2)).otherwise(labels)
    address = name.rlike(r"\A[0-9.]+\z|\A\[")
    return F.when(address, name).otherwise(F.call_function("substring_index", name, F.lit("."), -labels))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute http address without its fragment; null for other schemes and what cannot be read."""

    @F.pandas_udf("string")
    def join(bases: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for b, x in zip(bases, links, strict=True):
            try:
                full = urljoin(b or "", (x or "").strip()).split("#")[0]
            except ValueError:
                full = ""
            out.append(full if x and full.startswith(("http://", "https://")) else None)
        return pd.Series(out, dtype="object")

    return join(base, link)


def in_scope(url: Column, target: Column, scope: str, suffixes: list[str] | None = None) -> Column:
    """Whether a URL belongs to a target: ``rdn`` the same registered domain, ``dn`` the same host, else also the same scheme."""
    if scope == "rdn":
        domain = lambda u: registered_domain(u, suffixes)
        return domain(url) == domain(target)
    if scope in ("dn", "fqdn"):
        return host(url) == host(target)
    return (host(url) == host(target)) & (scheme(url) == scheme(target))
