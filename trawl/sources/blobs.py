"""Blobs from folders, tables and git repositories: rows (blob_id, path, content or text)."""

from __future__ import annotations

import fnmatch
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.ids import blob_id
from trawl.functions.text import is_binary


def is_hidden(path: Column) -> Column:
    """Whether a part of a relative path begins with a dot."""
    return path.rlike(r"(\A|/)\.[^/.][^/]*|(\A|/)\.\.[^/]+")


def ignored(patterns: list[str]):
    """A predicate for relative paths by lines of a .gitignore: later lines win, ``!`` takes back."""
    rules = [(p.lstrip("!").rstrip("/"), p.startswith("!")) for p in (line.strip() for line in patterns) if p and not p.startswith("#")]

    def matches(path: str, pattern: str) -> bool:
        parts = path.split("/")
        if "/" in pattern.strip("/"):
            own = pattern.strip("/")
            return any(fnmatch.fnmatchcase("/".join(parts[:n]), own) for n in range(1, len(parts) + 1))
        return any(fnmatch.fnmatchcase(p, pattern.strip("/")) for p in parts)

    @F.pandas_udf("boolean")
    def predicate(paths: pd.Series) -> pd.Series:
        out = []
        for path in paths:
            drop = False
            for pattern, back in rules:
                if matches(path or "", pattern):
                    drop = not back
            out.append(drop)
        return pd.Series(out, dtype="bool")

    return predicate


def files(spark: SparkSession, root: str, most: int = 20 << 20, gitignore: list[str] | None = None, binary: bool = False) -> DataFrame:
    """Files below ``root`` by name, size and ignore lines, before any content is read; then those without zero bytes.

    Files of more than ``most`` bytes are left out. Spark itself lists no files and folders whose names begin with a dot or an underscore.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most)
    base = root.split("://")[-1].rstrip("/")
    relative = F.substring_index("path", base + "/", -1)
    found = found.withColumn("path", relative)
    found = found.filter(~is_hidden(F.col("path")))
    if gitignore:
        found = found.filter(~ignored(gitignore)(F.col("path")))
    if not binary:
        found = found.filter(~is_binary(F.col("content")))
    return found.select(blob_id(F.col("content")).alias("blob_id"), "path", "content", F.col("length").alias("size"))


def from_table(df: DataFrame, text: str, path: Column) -> DataFrame:
    """Blobs from a text column; null texts are none."""
    return df.filter(F.col(text).isNotNull()).select(blob_id(F.col(text)).alias("blob_id"), path.alias("path"), F.col(text).alias("text"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list of URLs, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' and not startswith(url, '#')")


COMMIT = "commit string, author string, email string, committed timestamp, message string"
_FORMAT = "%x01%H%x02%an%x02%ae%x02%cI%x02%s"


def _git(repository: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repository, *arguments], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def _commit(line: str) -> tuple:
    commit, author, email, at, message = line.split("\x02")
    return commit, author, email, pd.Timestamp(at).tz_convert("UTC"), message


def _read(objects: DataFrame, repository: str, most: int) -> DataFrame:
    """``objects`` (oid, others) with content and size, of the blobs that are text and not too large. One process reads all of a task."""

    def contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = None
        for frame in frames:
            process = process or subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
            held, rows, taken = 0, [], []
            for k, oid in enumerate(frame["oid"]):
                process.stdin.write(f"{oid}\n".encode())
                process.stdin.flush()
                head = process.stdout.readline().split()
                if len(head) < 3:
                    continue  # a submodule's commit, which this repository does not hold
                size, left = int(head[2]), int(head[2]) + 1
                keep = head[1] == b"blob" and size <= most
                parts = []
                while left:
                    part = process.stdout.read(min(left, 1 << 20))
                    left -= len(part)
                    if keep:
                        parts.append(part)
                body = b"".join(parts)[:-1]
                if keep and b"\0" not in body[:8192]:
                    rows.append(k)
                    taken.append((body, size))
                    held += size
                if held > 8 << 20:
                    yield told(frame, rows, taken)
                    held, rows, taken = 0, [], []
            if rows:
                yield told(frame, rows, taken)
        if process:
            process.stdin.close()
            process.wait()

    def told(frame: pd.DataFrame, rows: list[int], taken: list[tuple[bytes, int]]) -> pd.DataFrame:
        out = frame.iloc[rows].reset_index(drop=True)
        return out.assign(content=[b for b, _ in taken], size=[n for _, n in taken]).rename(columns={"oid": "blob_id"})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in objects.schema.fields)
    return objects.mapInPandas(contents, kinds.replace("oid string", "blob_id string", 1) + ", content binary, size long")


def from_urls(urls: DataFrame, pages: DataFrame, most: int = 20 << 20) -> DataFrame:
    """Blobs of a list of addresses (url, and ``candidates`` to try in order) from a table of answers (url, status, content).

    The first address with a successful, non-empty answer of at most ``most`` bytes that is no binary counts; addresses without one
    have a row without a blob, with ``found`` false.
    """
    tried = F.posexplode(F.coalesce(F.col("candidates"), F.array("url")) if "candidates" in urls.columns else F.array("url"))
    asked = urls.select("url", tried.alias("place", "address"))
    size = F.octet_length("content")
    good = pages.filter((F.col("status") == 200) & (size > 0) & (size <= most) & ~is_binary(F.col("content"))).select(F.col("url").alias("address"), "content")
    first = asked.join(good.select("address").distinct(), "address").groupBy("url").agg(F.min_by("address", "place").alias("address"))
    held = first.join(good.dropDuplicates(["address"]), "address")
    found = held.select("url", F.col("address").alias("path"), blob_id(F.col("content")).alias("blob_id"), "content", F.lit(True).alias("found"))
    return urls.select("url").join(found, "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def from_listing(listing: DataFrame, repository: Column, most: int = 10 << 20) -> DataFrame:
    """Blobs of hosted repositories from a table of their files (path, encoding, content), as the hosts' interfaces list them.

    Contents are base64 or text; paths begin with the repository's name. Damaged, binary and larger ones are left out.
    """
    body = F.when(F.col("encoding") == "base64", F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))).otherwise(F.col("content").cast("binary"))
    found = listing.select(F.concat(repository, F.lit("/"), F.col("path")).alias("path"), body.alias("content")).filter("content is not null")
    kept = found.filter((F.octet_length("content") <= most) & ~is_binary(F.col("content")))
    return kept.select(blob_id(F.col("content")).alias("blob_id"), "path", "content", F.octet_length("content").cast("long").alias("size"))


def clone_path(url: Column) -> Column:
    """Where a mirror of clones keeps a repository: ``host/path.git``; paths of the local machine stay."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"\A(?:[a-z+]+://)?(?:[^@/]*@)?", ""), r"(?:\.git)?/*\z", "")
    remote = url.rlike(r"\A(?:[a-z+]+://|[^/@]+@[^/:]+:)")
    return F.when(remote, F.concat(F.regexp_replace(plain, r"\A([^/:]+):(?:[0-9]+/)?", "$1/"), F.lit(".git"))).otherwise(url)


def git_history(spark: SparkSession, repository: str, most: int = 20 << 20, parts: int = 16) -> DataFrame:
    """Every blob that any commit of a repository holds, once, with its path in the first commit that brought it, and that commit.

    The history is read in ``parts`` ranges of commits by the executors, which need the repository's folder; the driver
    asks for the number of commits only. Blobs of more than ``most`` bytes and binary ones are left out.
    """
    total = int(_git(repository, "rev-list", "--all", "--count").strip() or 0)
    step = max(1, -(-total // parts))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in frame["id"]:
                rows, at, commit = [], -1, ()
                for line in _git(repository, "-c", "core.quotePath=false", "log", "--all", f"--skip={start * step}", f"--max-count={step}", "--raw", "--no-abbrev", "--root", "-m", "--no-renames", f"--format={_FORMAT}").split("\n"):
                    if line.startswith("\x01"):
                        new = _commit(line[1:])
                        at += not commit or new[0] != commit[0]  # a merge is told once for each parent
                        commit = new
                    elif line.startswith(":"):
                        fields, _, path = line.partition("\t")
                        _, mode, _, oid, _ = fields.split()
                        if mode.startswith("100"):
                            rows.append((oid, path, int(start * step + at), *commit))
                yield pd.DataFrame(rows, columns=["oid", "path", "place", "commit", "author", "email", "committed", "message"])

    ranges = spark.range(0, max(1, -(-total // step)), 1, max(1, -(-total // step)))
    found = ranges.mapInPandas(listed, f"oid string, path string, place long, {COMMIT}")
    first = F.max_by(F.struct("path", "commit", "author", "email", "committed", "message"), F.struct("place", "path"))  # the log begins with the newest
    objects = found.groupBy("oid").agg(first.alias("first")).select("oid", "first.*").repartition(parts, "oid")
    return _read(objects, repository, most).select("blob_id", "path", "content", "size", "commit", "author", "email", "committed", "message")


def git_commit(spark: SparkSession, repository: str, revision: str = "HEAD", most: int = 20 << 20, parts: int = 16) -> DataFrame:
    """The files of one commit, each blob once, with the commit's metadata. Binary files and those of more than ``most`` bytes are left out."""
    (commit,) = [_commit(line[1:]) for line in _git(repository, "log", "-1", f"--format={_FORMAT}", revision).split("\n") if line.startswith("\x01")]

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _ in frame["id"]:  # one row: a tree is read by one process
                rows = []
                for entry in _git(repository, "ls-tree", "-r", "-z", commit[0]).split("\0"):
                    if entry.startswith("100"):
                        head, _, path = entry.partition("\t")
                        rows.append((head.split()[2], path))
                yield pd.DataFrame(rows, columns=["oid", "path"])

    found = spark.range(1).mapInPandas(listed, "oid string, path string").groupBy("oid").agg(F.min("path").alias("path")).repartition(parts, "oid")
    names = [c.split()[0] for c in COMMIT.split(", ")]
    return _read(found, repository, most).select("blob_id", "path", "content", "size", *[F.lit(v).alias(n) for v, n in zip(commit, names, strict=True)])


def left_out(spark: SparkSession, root: str, most: int = 20 << 20) -> DataFrame:
    """Files (path, size, reason) below ``root`` that ``files`` leaves out for their size, their name or as binary."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1)
    small = found.filter(F.col("length") <= most).select(path.alias("path"), F.col("length").alias("size"), F.when(is_hidden(path), "hidden").when(is_binary(F.col("content")), "binary").alias("reason"))
    large = found.filter(F.col("length") > most).select(path.alias("path"), F.col("length").alias("size"), F.lit("too large").alias("reason"))
    return small.filter("reason is not null").unionByName(large)
