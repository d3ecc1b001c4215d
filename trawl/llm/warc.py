"""A deterministic sharded WARC writer, and a reader.

Records are cut into ranges of ids by an exact histogram (and those without an id, or of one id that fills more than
a range, by a hash of address and payload), so the same table gives the same ranges on any cluster. Each range is sorted and written by one task: one gzip member for each record, a new file
whenever the compressed size reaches the limit. Headers, record ids and digests are made anew from the row.
A file is written under a temporary name and renamed when it is complete; the manifest, written last and
renamed too, makes the archive whole. A task that runs again writes the same bytes under the same names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import rename_new, stored

#: Compressed size at which a file is closed; payload of a range; fewest ranges; counts of a histogram.
ROLL, RANGE, LEAST_RANGES, BUCKETS = 256 << 20, 256 << 20, 64, 4096
#: Places of a record among those of one id.
PLACES = 1 << 20
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 0
#: A record's size besides its payload, for the histogram.
OVERHEAD = 512
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "file string, records long, bytes long, sha256 string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha1: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha1}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, html: str | None, sha1: str, size: int, first_id: int | None, first_url: str | None, revisit: bool) -> bytes:
    """A response, or a revisit that names the record with the same payload."""
    clean = lambda u: " ".join((u or "").split())  # noqa: E731  a header is one line
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, url, sha1)), ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)), ("Content-Type", "application/http; msgtype=response"),
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    headers.append(("X-Payload-Length", str(size)))
    if revisit:
        block = head
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first_id, first_url, sha1)),
            ("WARC-Refers-To-Target-URI", clean(first_url)), ("WARC-Refers-To-Date", DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ]
        if first_id is not None:
            headers.append(("X-Refers-To-Page-ID", str(first_id)))
    else:
        payload = (html or "").encode("utf-8", "surrogatepass")
        block = head + payload
        headers.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    return record([*headers, ("WARC-Block-Digest", "sha1:" + digest(block))], block)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, by any scheme that Hadoop uses and pyarrow has a name for."""
    scheme, sep, rest = folder.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sep + rest)


def ranges(rows: DataFrame, key: str, weight: str, parts: int) -> list[int]:
    """Lower bounds of about ``parts`` ranges of ``key`` with about equal weight.

    A histogram of BUCKETS counts, or a few for each range, is read by the driver; buckets that weigh more than a range are
    counted again in finer steps, until they do not or hold one key.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    cells: list[tuple[int, int, int]] = []  # start, width, weight
    most = max(BUCKETS, 4 * parts)
    todo, width = [low], high - low + 1
    target = None
    # All buckets of a level have one width, so a key's bucket is found by arithmetic, level by level.
    start, level = F.lit(low).cast("long"), rows
    while todo:
        step = max(1, -(-width // max(16, most // len(todo))))
        if target is not None:  # a row for each bucket that is counted again
            level = rows.withColumn("_above", start).join(F.broadcast(spark.createDataFrame([(t,) for t in todo], "_above long")), "_above", "left_semi")
        start = start + F.floor((F.col(key) - start) / F.lit(step)) * F.lit(step)
        counted = level.filter(F.col(key).isNotNull()).withColumn("_start", start.cast("long")).groupBy("_start").agg(F.sum(weight).alias("w")).collect()
        if target is None:
            target = max(1, sum(r["w"] for r in counted) // parts)
        heavy = [r["_start"] for r in counted if r["w"] > target and step > 1]
        cells += [(r["_start"], step, r["w"]) for r in counted if r["w"] <= target or step == 1]
        todo, width = sorted(heavy), step
    bounds, held = [low], 0
    for start, _, w in sorted(cells):
        if held and held + w > target:
            bounds.append(start)
            held = 0
        held += w
    return bounds


def cut(weighed: DataFrame, bounds: list[int], target: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the ranges behind that of the null ids, and the number of shards that each range is cut into.

    Only ranges that hold one id can outweigh ``target`` by much, so a cut is by place within the id.
    """
    starts = np.array(bounds, np.int64)
    shares = np.ones(len(bounds) + 1, np.int64)
    heavy = weighed.groupBy("page_id").agg(F.sum("weight").alias("weight")).filter(F.col("weight") > 2 * target)
    for row in heavy.collect():  # fewer than half the number of ranges
        k = 0 if row["page_id"] is None else int(np.searchsorted(starts, row["page_id"], side="right"))
        shares[k] = max(shares[k], -(-row["weight"] // target))
    return starts, shares


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes the archive of ``pages`` to ``folder`` (any file system that pyarrow knows) and returns its manifest.

    Of records with equal payloads of at least LEAST_BYTES bytes, those with the least id are responses and
    the others revisits of it; repeated rows of the least id are all responses. A null html is an empty
    payload, and payloads are written whole, however long. Null ids come first in the order and are the greatest when it
    comes to responses. Other columns, whatever their names, are left out. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    rows = rows.withColumn("place", F.pmod(F.xxhash64("url", "sha1"), F.lit(PLACES)))
    slim = stored(rows.drop("html"), f"{folder}/_temporary")
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = slim.select("sha1", place.alias("place")).groupBy("sha1").agg(F.min("place").alias("first"))
    key = ["page_id", "place", "url", "sha1"]
    links = slim.join(first, "sha1").withColumn("revisit", (F.col("size") >= LEAST_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    links = links.groupBy(*key, "size").agg(F.min("first.page_id").alias("first_id"), F.min("first.url").alias("first_url"), F.min("revisit").alias("revisit"))
    # A record's links go before it, so that payloads are dealt out once and never joined.
    none = {"first_id": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string"), "revisit": F.lit(None).cast("boolean")}
    known = links.withColumn("html", F.lit(None).cast("string")).withColumn("kind", F.lit(0)).unionByName(rows.withColumns(none).withColumn("kind", F.lit(1)))
    weighed = slim.select("page_id", (F.col("size") + OVERHEAD).alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    parts = max(LEAST_RANGES, -(-total // RANGE))
    bounds = ranges(weighed.filter("page_id is not null"), "page_id", "weight", parts)
    starts, shares = cut(weighed, bounds, -(-total // parts))
    first_of = np.concatenate([[0], np.cumsum(shares)])

    @F.pandas_udf("int")
    def shard(ids: pd.Series, place: pd.Series) -> pd.Series:
        range_ = np.where(ids.isna(), 0, np.searchsorted(starts, ids.fillna(0).astype("int64"), side="right"))
        return pd.Series((first_of[range_] + place.to_numpy() * shares[range_] // PLACES).astype(np.int32))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(f"{root}/_temporary", recursive=True)
        done: list[tuple[str, int, int, str]] = []
        current = -1
        out = None
        temporary = name = ""
        n = size = number = 0
        hashed = hashlib.sha256()
        links: tuple = ()

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                system.move(temporary, f"{root}/{name}")
                done.append((name, n, size, hashed.hexdigest()))
                out = None

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if row["kind"] == 0:
                    links = tuple(row[c] for c in ("page_id", "url", "sha1", "first_id", "first_url", "revisit"))
                    continue
                if links[:3] != (row["page_id"], row["url"], row["sha1"]):
                    raise ValueError("a record does not follow its links")
                if row["shard"] != current or size >= roll:
                    close()
                    number = number + 1 if row["shard"] == current else 0
                    current = row["shard"]
                    name = f"part-{current:06d}-{number:05d}.warc.gz"
                    temporary = f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary, compression=None)
                    n, hashed = 0, hashlib.sha256()
                    data = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size = len(data)
                    out.write(data)
                    hashed.update(data)
                data = page_record(*(row[c] for c in ("page_id", "url", "html", "sha1", "size")), *links[3:])
                out.write(data)
                hashed.update(data)
                n, size = n + 1, size + len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    dealt = known.withColumn("shard", shard("page_id", "place")).repartition("shard").sortWithinPartitions("shard", *key, "kind")
    manifest = stored(dealt.mapInArrow(put, MANIFEST), f"{folder}/_temporary")
    return commit(spark, manifest, folder)


def commit(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Writes the manifest under a temporary name and renames it; then the archive is whole."""
    temporary = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    manifest.orderBy("file").write.json(temporary)
    rename_new(spark, temporary, f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of an archive (READ; revisits have no payload of their own).

    Digests of blocks and payloads are computed and held against the headers.
    """
    number = lambda h, k: int(h[k]) if k in h else None

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != "sha1:" + digest(block):
                            raise ValueError(f"{name}: a block does not have its digest")
                        revisit = headers["WARC-Type"] == "revisit"
                        payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
                        found = headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload)
                        if headers["WARC-Payload-Digest"] != "sha1:" + found:
                            raise ValueError(f"{name}: a payload does not have its digest")
                        size = number(headers, "X-Payload-Length") if revisit else len(payload)
                        rows.append((number(headers, "X-Page-ID"), size, found, headers["WARC-Type"], number(headers, "X-Refers-To-Page-ID"), headers["WARC-Target-URI"], payload if payloads else None))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("file").repartitionByRange(max(1, manifest.count()), "file").mapInArrow(get, READ)  # about a task for each file
