"""Repairing and guessing addresses of assets: headers, manifests, literals of scripts, candidates for what was not found."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators.webassets import EXTENSIONS, script_literals

PORTS = {"http": 80, "https": 443}


def header_parts(header: Column) -> Column:
    """The links of a ``Link`` header: parts between commas that stand outside quotation marks."""
    return F.transform(F.regexp_extract_all(header, F.lit(r'((?:[^,"]|"[^"]*(?:"|\z))+)'), F.lit(1)), lambda p: F.trim(p))


def header_links(header: Column) -> Column:
    """The targets of a ``Link`` header, in order and once each."""
    found = F.transform(header_parts(header), lambda p: F.regexp_extract(p, r"<([^>]*)>", 1))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def segments(path: str) -> list[str]:
    return [s for s in path.split("/") if s]


def folder(path: str) -> list[str]:
    """The segments of a path's folder."""
    return segments(path if path.endswith("/") else path.rpartition("/")[0])


def has_scheme(text: str) -> bool:
    try:
        return bool(urlsplit(text).scheme)
    except ValueError:
        return False


def without_backslashes(path: str, host: str) -> str:
    """A path whose separators were escaped: backslashes go, slashes become single, and a first segment that is the host goes."""
    parts = segments(path.replace("\\", ""))
    lead = "/" if path.replace("\\", "").startswith("/") else ""
    if parts and host and parts[0].lower() == host.lower():
        return "/" + "/".join(parts[1:])
    tail = "/" if parts and path.replace("\\", "").endswith("/") else ""
    return lead + "/".join(parts) + tail


def clean_url(url: str) -> str:
    """An address whose path holds backslashes, cleaned, without the scheme's own port; others as they are."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return url
    if parts.scheme not in PORTS or "\\" not in unquote(parts.path):
        return url
    host = parts.netloc.rpartition(":")[0] if port == PORTS[parts.scheme] else parts.netloc
    return urlunsplit(parts._replace(netloc=host, path=without_backslashes(unquote(parts.path), parts.hostname or "")))


def literal(base: str, raw: str) -> str | None:
    """A script's string as an address, or None if it cannot be one: blanks, templates, names that only begin with a dot."""
    text = raw.strip()
    for escaped in ("\\/", "\\u002f", "\\u002F"):
        text = text.replace(escaped, "/")
    if not text or any(c in text for c in " \t\r\n{}"):
        return None
    if "\\" in text:
        if text[0] not in "\\/":
            return None
        text = without_backslashes(text, urlsplit(base).hostname or "")
    if not text or (text[0] == "." and not text.startswith(("./", "../"))):
        return None
    return text


def addresses(base: str, raw: str, public: str = "") -> list[str]:
    """Where a script's string may lie, best first: below the public path, with a folder that is named twice once, and below the root."""
    text = literal(base, raw)
    if text is None:
        return []
    if text.startswith("/") or has_scheme(text):
        return [text]
    root = ["/" + text] if text.startswith("static/") else []
    if public.strip():
        return [public.rstrip("/") + "/" + text.lstrip("/") if public.rstrip("/") else "/" + text.lstrip("/"), *root]
    own, here = segments(text), folder(urlsplit(base).path)
    if text[0] != "." and own and here and own[0] == here[-1]:
        return ["/" + "/".join([*here[:-1], *own])]
    return [text, *root]


def resolved(base: str, links: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> list[str]:
    """Absolute http addresses with one of the extensions, without fragments, once each."""
    out: dict[str, None] = {}
    for link in links:
        try:
            full = clean_url(urljoin(base, link.strip()).split("#")[0])
            if full.startswith(("http://", "https://")) and urlsplit(full).path.lower().endswith(extensions):
                out[full] = None
        except ValueError:
            continue
    return list(out)


def manifest_links(body: str) -> list[str]:
    """All strings of a JSON manifest, and keys that look like addresses."""
    try:
        todo = [json.loads(body)]
    except ValueError:
        return []
    out = []
    while todo:
        value = todo.pop(0)
        if isinstance(value, str):
            out.append(value)
        elif isinstance(value, list):
            todo = [*value, *todo]
        elif isinstance(value, dict):
            inner = []
            for key, item in value.items():
                inner += [key] if "/" in key or key.startswith(".") or has_scheme(key) else []
                inner.append(item)
            todo = [*inner, *todo]
    return out


def file_assets(url: str, body: str) -> list[str]:
    """The assets that a script or a manifest names."""
    path = urlsplit(url).path.lower()
    if path.endswith(".json") and body.lstrip()[:1] in ("{", "["):
        return resolved(url, manifest_links(body))
    public, found = script_literals(body)
    return resolved(url, [a for raw in found for a in addresses(url, raw, public)])


def candidates(url: str, target: str, base: str = "") -> list[str]:
    """Addresses at which a file that was not found may be: the target's folder exchanged for the base's, a repeated folder named once."""
    out = [url]
    try:
        here, goal = urlsplit(url), urlsplit(target)
        other = urlsplit(base)
    except ValueError:
        return out
    own, start = segments(here.path), folder(goal.path)
    if here.netloc.lower() != goal.netloc.lower() or here.scheme != goal.scheme or not start or own[: len(start)] != start:
        return out
    tail = own[len(start) :]
    again = lambda parts: urlunsplit(here._replace(path="/" + "/".join(parts)))
    if base and other.netloc.lower() == here.netloc.lower() and other.scheme == here.scheme and tail:
        out.append(again([*folder(other.path), *tail]))
    for n in range(min(len(start), len(tail) - 1), 0, -1):
        if start[-n:] == tail[:n]:
            out.append(again([*start[:-n], *tail]))
            break
    return list(dict.fromkeys(out))


def candidate_rows(urls: DataFrame, target: str, base: str = "", url: str = "url") -> DataFrame:
    """``urls`` with a row for each candidate (``candidate``) and its place."""

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series([candidates(v or "", target, base) for v in values])

    return urls.select("*", F.posexplode(found(F.col(url))).alias("place", "candidate"))


def files(contents: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Rows (url, asset): what each script and manifest of ``contents`` names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(u, a) for u, b in zip(frame["url"], frame["body"], strict=True) for a in file_assets(u or "", b or "")]
            yield pd.DataFrame(rows, columns=["url", "asset"], dtype="object")

    return contents.select(F.col(url).alias("url"), F.col(body).alias("body")).mapInPandas(run, "url string, asset string")
