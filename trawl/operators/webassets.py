"""Assets that pages refer to, and the walk over pages that are reached through them."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What script texts say about other files, and links that load something.
QUOTED = re.compile(r"[\"'`]([^\"'`]+?\.(?:js|json|map)(?:\?[^\"'`]*)?)[\"'`]")
SOURCE_MAP = re.compile(r"(?://[#@]|/\*[#@])\s*sourceMappingURL=([^\s*]+)")
PUBLIC_PATH = re.compile(r"\.p\s*=\s*[\"']([^\"']*)[\"']")
CHUNKS = re.compile(r"[\"']([^\"']*)[\"']\s*\+\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\+\s*[\"']([^\"']*)[\"']\s*\+\s*\{([^{}]+)\}\[[^\]]+\]\s*\+\s*[\"']([^\"']*\.js)[\"']")
CHUNK = re.compile(r"(\d+):[\"']([A-Za-z0-9]+)[\"']")
LINK_RELS = {"modulepreload", "preload", "prefetch", "stylesheet"}
LINK_KINDS = {"", "script", "fetch", "style"}
EXTENSIONS = (".js", ".mjs", ".json", ".map", ".css")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.links: list[str] = []
        self.scripts: list[tuple[str, str]] = []
        self.kind: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "script":
            if a.get("src"):
                self.links.append(a["src"])
            else:
                self.kind = a.get("type", "").strip().lower()
        elif tag == "link" and a.get("href") and set(a.get("rel", "").lower().split()) & LINK_RELS and a.get("as", "").lower() in LINK_KINDS:
            self.links.append(a["href"])

    def handle_data(self, data: str) -> None:
        if self.kind is not None:
            self.scripts.append((self.kind, data))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.kind = None


def script_literals(text: str) -> tuple[str, list[str]]:
    """The public path of a script's bundler (the last one), and the files it names: source maps, quoted names, chunks."""
    found = SOURCE_MAP.findall(text) + QUOTED.findall(text)
    for before, between, entries, after in CHUNKS.findall(text):
        found += [f"{before}{k}{between}{name}{after}" for k, name in CHUNK.findall(entries)]
    return (PUBLIC_PATH.findall(text) or [""])[-1], found


def script_links(text: str) -> list[str]:
    """Files that a script names, below its public path."""
    prefix, found = script_literals(text)
    return [u if not prefix or re.match(r"[a-z]+:|/|\.", u) else prefix.rstrip("/") + "/" + u for u in found]


def map_links(text: str) -> list[str]:
    """Targets of an import map."""
    try:
        spec = json.loads(text)
        tables = [spec.get("imports") or {}, *(spec.get("scopes") or {}).values()]
        return [v for t in tables for v in t.values() if isinstance(v, str)]
    except (ValueError, AttributeError):
        return []


def page_assets(url: str, html: str) -> list[str]:
    """Absolute URLs of a page's assets in the order in which they are met."""
    page = _Page()
    page.feed(html or "")
    links = list(page.links)
    for kind, text in page.scripts:
        links += map_links(text) if kind == "importmap" else script_links(text)
    found = []
    for link in links:
        try:
            full = urljoin(url or "", link.strip()).split("#")[0]
            if full.startswith(("http://", "https://")) and urlsplit(full).path.lower().endswith(EXTENSIONS):
                found.append(full)
        except ValueError:
            continue
    return list(dict.fromkeys(found))


def assets(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, a row for each asset with its position."""

    @F.pandas_udf("array<string>")
    def found(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([page_assets(u, b) for u, b in zip(urls, bodies, strict=True)])

    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(found(url, html)).alias("position", "asset"))


def map_candidates(asset: str = "asset"):
    """The source maps that a script may have: its name with ``.map``, without and with its query."""
    plain = F.substring_index(asset, "?", 1)
    query = F.substring(asset, F.length(plain) + 1, F.length(asset))
    return F.array_distinct(F.array(F.concat(plain, F.lit(".map")), F.concat(plain, F.lit(".map"), query)))


def crawl(pages: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows (url, depth) reached from ``seeds`` (url) through assets that ``pages`` (url, html) holds, to the end.

    Pages give their assets, scripts and manifests theirs. Each round joins the frontier with the pages and drops what was
    met before; it ends when nothing is new. ``rounds``: stop after so many; what they reached but did not read is then
    the rows of the greatest depth. The known set is written between rounds, so a round's plan does not hold the earlier ones.
    """
    from trawl.operators import asseturls
    from trawl.plans.store import stored

    known = stored(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = known, 0
    is_file = F.lower(F.regexp_extract("url", r"\A[^?#]*", 0)).rlike(r"\.(js|mjs|json|map)\z")
    while rounds is None or depth < rounds:
        depth += 1
        read = stored(pages.join(frontier.select("url"), "url", "left_semi").select("url", "html"))
        of_pages = assets(read.filter(~is_file)).select(F.col("asset").alias("url"))
        of_files = asseturls.files(read.filter(is_file)).select(F.col("asset").alias("url"))
        reached = of_pages.union(of_files).distinct()
        frontier = stored(reached.join(known, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = stored(known.unionByName(frontier))
    return known
