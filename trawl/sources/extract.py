"""Members of archives and documents: one container in, many texts out."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.ids import blob_id
from trawl.sources import pdf, sevenzip

#: Bytes of a member and of an archive that are read, nesting, and rows of a database table.
MEMBER, ARCHIVE, DEPTH, ROWS = 10 << 20, 100 << 20, 5, 1000
ZIPS = ("zip", "jar", "war", "ear", "apk", "ipa", "xpi", "crx")
#: Where document formats keep their text.
DOCUMENTS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(sharedStrings|worksheets/.*)\.xml", "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml"}
TEXTS = ("eml", "rtf", "ipynb")


def extension(path: str) -> str:
    name = path.lower().rsplit("/", 1)[-1]
    return "tgz" if name.endswith((".tar.gz", ".tgz")) else name.rsplit(".", 1)[-1] if "." in name else ""


def extractable(path: str) -> bool:
    return extension(path) in (*ZIPS, *DOCUMENTS, *TEXTS, "tar", "tgz", "7z", "pdf", "sqlite", "sqlite3", "db")


def _xml_text(data: bytes) -> str:
    words = " ".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())
    return " ".join("".join(c for c in words if c.isprintable() or c.isspace()).split())


@dataclass(frozen=True)
class Limits:
    """Bytes of a member and of an archive that are read, nesting, and rows of a database table."""

    member: int = MEMBER
    archive: int = ARCHIVE
    depth: int = DEPTH
    rows: int = ROWS


def _limits() -> Limits:
    return Limits(MEMBER, ARCHIVE, DEPTH, ROWS)


def _inside(name: str, body: bytes, depth: int, limits: Limits, left_out: list[tuple[str, str]]) -> Iterator[tuple[str, bytes]]:
    """A member itself, or what it holds if it is a container."""
    if extractable(name) and depth < limits.depth:
        inner_out: list[tuple[str, str]] = []
        for inner, content in members(name, body, depth + 1, limits, inner_out):
            yield f"{name}:{inner}", content
        left_out += [(f"{name}:{inner}", why) for inner, why in inner_out]
    elif extractable(name):
        left_out.append((name, "nested too deep"))
    elif b"\0" not in body[:8192]:
        yield name, body
    else:
        left_out.append((name, "binary"))


def members(path: str, body: bytes, depth: int = 1, limits: Limits | None = None, left_out: list[tuple[str, str]] | None = None) -> Iterator[tuple[str, bytes]]:
    """(member, content) of a container; damaged ones end early. Sizes are held while reading, whatever is declared.

    ``left_out`` gathers (member, reason) of what the limits, or damage, keep out.
    """
    limits = limits or _limits()
    left_out = [] if left_out is None else left_out
    kind, left = extension(path), limits.archive
    try:
        if kind in ZIPS or kind in DOCUMENTS:
            with zipfile.ZipFile(io.BytesIO(body)) as archive:
                for info in archive.infolist():
                    wanted = DOCUMENTS.get(kind)
                    if info.is_dir() or (wanted and not re.fullmatch(wanted, info.filename)):
                        continue
                    with archive.open(info) as stream:
                        data = stream.read(min(limits.member, left) + 1)
                    if len(data) > min(limits.member, left):
                        left_out.append((info.filename, "too large"))
                        continue
                    left -= len(data)
                    if wanted:
                        yield info.filename, _xml_text(data).encode()
                    else:
                        yield from _inside(info.filename, data, depth, limits, left_out)
        elif kind in ("tar", "tgz"):
            with tarfile.open(fileobj=io.BytesIO(body), mode="r:*") as archive:
                for info in archive:
                    if info.isfile() and info.size > min(limits.member, left):
                        left_out.append((info.name, "too large"))
                    elif info.isfile():
                        data = archive.extractfile(info).read(limits.member)
                        left -= len(data)
                        yield from _inside(info.name, data, depth, limits, left_out)
        elif kind == "7z":
            for name, data, why in sevenzip.members(body, limits.member, left):
                if data is None:
                    left_out.append((name, why))
                else:
                    yield from _inside(name, data, depth, limits, left_out)
        elif kind == "pdf":
            problems: list[str] = []
            text = pdf.text(body, min(limits.member, left), problems)
            left_out += [("content", why) for why in problems]
            if text.strip():
                yield "content", text.encode("utf-8", "replace")
        elif kind == "ipynb":
            for k, cell in enumerate(json.loads(body).get("cells", [])):
                if isinstance(cell.get("source"), list) and cell.get("cell_type") in ("code", "markdown"):
                    yield f"cell_{k}_{cell['cell_type']}", "".join(cell["source"]).encode()
        elif kind == "eml":
            yield "email", body
        elif kind == "rtf":
            text = re.sub(r"\\[a-zA-Z]+-?\d* ?|\\'[0-9a-fA-F]{2}|[{}]", " ", body.decode("latin-1"))
            yield "text", " ".join("".join(c for c in text if " " <= c <= "~" or c.isspace()).split()).encode()
        elif kind in ("sqlite", "sqlite3", "db"):
            with tempfile.NamedTemporaryFile(suffix=".db") as file:
                file.write(body)
                file.flush()
                base = sqlite3.connect(f"file:{file.name}?mode=ro", uri=True)
                for (table,) in base.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
                    quoted = table.replace('"', '""')
                    rows = base.execute(f'SELECT * FROM "{quoted}" LIMIT {limits.rows + 1}').fetchall()
                    if len(rows) > limits.rows:
                        rows = rows[: limits.rows]
                        left_out.append((table, f"rows after {limits.rows}"))
                    yield table, "\n".join(" ".join(c for c in r if isinstance(c, str)) for r in rows).encode()
                base.close()
    except (zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError, sqlite3.DatabaseError, ValueError, EOFError, OSError, RuntimeError) as e:
        left_out.append(("", f"damaged: {type(e).__name__}"))


def extract(blobs: DataFrame, path: str = "path", content: str = "content", limits: Limits | None = None, report: bool = False) -> DataFrame:
    """Rows (path, member, content) of every container among the blobs.

    ``limits`` are those of the module unless given. With ``report``, a column ``left_out`` is added, and what the limits or
    damage keep out has a row without content that says why.
    """
    limits = limits or _limits()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, body in zip(frame["path"], frame["content"], strict=True):
                if body is None or not extractable(p):
                    continue
                out: list[tuple[str, str]] = []
                rows = [(p, name, data, None) for name, data in members(p, bytes(body), 1, limits, out)]
                rows += [(p, name, None, why) for name, why in out] if report else []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "member", "content", "left_out"], dtype="object")

    named = blobs.select(F.col(path).alias("path"), F.col(content).alias("content"))
    found = named.mapInPandas(run, "path string, member string, content binary, left_out string")
    return found if report else found.drop("left_out")


def sources_of_map(text: str) -> list[tuple[str, str]]:
    """(name, content) of the sources that a source map holds, and those of its sections; none if it is no source map."""
    try:
        todo, out = [json.loads(text)], []
    except ValueError:
        return []
    while todo:
        one = todo.pop(0)
        if not isinstance(one, dict):
            continue
        names = one.get("sources") or []
        for k, content in enumerate(one.get("sourcesContent") or []):
            if isinstance(content, str) and content:
                name = names[k] if k < len(names) and isinstance(names[k], str) and names[k].strip() else f"source-{k + 1}.js"
                out.append((name, content))
        todo = [s.get("map") for s in one.get("sections") or [] if isinstance(s, dict)] + todo
    return out


def from_maps(blobs: DataFrame, path: str = "path", content: str = "content", most: int = 20 << 20) -> DataFrame:
    """Rows (blob_id, path, parent, content, too_large) of the sources within ``.map`` files, whose path has no query.

    Paths are ``parent::source-map/name``; sources of more than ``most`` bytes have a row without content.
    """
    plain = F.regexp_replace(F.col(path), r"[?#].*\z", "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, n, c) for p, body in zip(frame["path"], frame["content"], strict=True) for n, c in sources_of_map(body if isinstance(body, str) else bytes(body or b"").decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["parent", "name", "content"], dtype="object")

    found = blobs.filter(F.lower(plain).endswith(".map")).select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "parent string, name string, content string")
    name = F.regexp_replace("name", r"[\r\n]", "")
    large = F.octet_length("content") > most
    return found.select(
        blob_id(F.col("content")).alias("blob_id"), F.concat("parent", F.lit("::source-map/"), F.when(name == "", F.lit("source.js")).otherwise(name)).alias("path"),
        "parent", F.when(~large, F.col("content")).alias("content"), large.alias("too_large"),
    )
