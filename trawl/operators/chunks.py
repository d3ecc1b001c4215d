"""Large texts in pieces: overlapping chunks for matching, chunks of whole lines for a review, and what a review says."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.functions.ranks import numbered
from trawl.operators import detect, redact
from trawl.operators.rules import Rule

#: Bytes of a chunk that is searched, and lines that it shares with the one before; bytes of a chunk for review.
SIZE, OVERLAP, REVIEW = 5 << 20, 10, 60_000

# What marks a line of a review as an insight, and what takes it back; the number and length of insights.
MARKS = (
    "api key", "secret", "token", "credential", "password", "authorization", "auth", "unauth", "cors", "debug", "misconfig", "vulnerab", "exposed", "leak",
    "admin", "risk", "critical", "high confidence",
)
DENIALS = ("none found", "no findings", "no secret", "no obvious", "not enough evidence", "not observed")
INSIGHTS, LENGTH = 3, 220


def cut(body: bytes, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, lines before) of chunks of whole lines: a chunk takes lines while they fit, and begins ``overlap`` lines
    before the last one's end. A longer line is a chunk of its own."""
    ends = [0]
    while (at := body.find(b"\n", ends[-1])) >= 0:
        ends.append(at + 1)
    if ends[-1] < len(body) or len(ends) == 1:
        ends.append(len(body))
    out, first = [], 0
    while first < len(ends) - 1:
        last = first + 1
        while last < len(ends) - 1 and ends[last + 1] - ends[first] <= size:
            last += 1
        out.append((ends[first], ends[last], first))
        if last == len(ends) - 1:
            break
        first = max(last - overlap, first + 1)
    return out


def with_overlap(blobs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``blobs`` in chunks: their columns with a part of the text each, ``chunk``, ``chunk_start`` (bytes) and ``chunk_line`` (lines before)."""
    kept = [f for f in blobs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in detect.small_batches(batches, text):
            owners, parts = [], []
            for k, content in enumerate(batch.column(text).to_pylist()):
                body = (content or "").encode("utf-8", "surrogatepass")
                for number, (start, end, line) in enumerate(cut(body, size, overlap)):
                    owners.append(k)
                    parts.append((body[start:end].decode("utf-8", "replace"), number, start, line))
            if parts:
                columns = [pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(pa.array(owners)) for f in kept], *columns], [*[f.name for f in kept], text, "chunk", "chunk_start", "chunk_line"])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return blobs.mapInArrow(run, ", ".join([*own, f"`{text}` string", "chunk int, chunk_start long, chunk_line long"]))


def absolute(matches: DataFrame) -> DataFrame:
    """Matches within chunks as matches within the blob; ids are made from these places, so a hit in an overlap is one hit."""
    moved = {"start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start"), "start_line": F.col("start_line") + F.col("chunk_line"), "end_line": F.col("end_line") + F.col("chunk_line")}
    return matches.withColumns(moved).drop("chunk_start", "chunk_line")


def scan(blobs: DataFrame, rules: Iterable[Rule], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Matches of blobs (blob_id, ``text``, others) found chunk by chunk, once each; of equal places the first chunk's stays."""
    found = absolute(detect.with_python(with_overlap(blobs, text, size, overlap), rules, text))
    return detect.first_by_place(detect.with_ids(found), ["chunk"])


def rule_stats(blobs: DataFrame, rules: Iterable[Rule], text: str = "text") -> DataFrame:
    """Statistics of each rule and state over all chunks (rule_id, state, n_tried, n_matches, seconds), measured by the scan itself.

    ``n_tried`` counts the texts on which a rule was tried, as they hold what it needs. Matches are not kept.
    """
    scanned = detect.with_python(blobs, rules, text, stats=True)
    return detect.measured(scanned)[1]


def prepared(files: DataFrame) -> DataFrame:
    """Files (blob_id, path, text) that a review reads, each pair of blob and path once, with ``file_id`` by path."""
    kept = files.filter(redact.reviewed(F.col("path"))).dropDuplicates(["blob_id", "path"])
    number = F.lpad(F.col("number").cast("string"), 3, "0")
    named = numbered(kept, ["path", "blob_id"]).withColumn("file_id", F.concat(F.lit("FILE_"), F.when(F.col("number") < 1000, number).otherwise(F.col("number").cast("string"))))
    return named.drop("number")


def review_chunks(files: DataFrame, text: str = "text", most: int = REVIEW) -> DataFrame:
    """``files`` in chunks of whole lines of at most ``most`` bytes: ``chunk``, ``first_line``, ``last_line`` and the text.

    A line joins the chunk before it while both fit. Longer lines are chunks of their own.
    """
    pieces = with_overlap(files, text, most, 0)
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + (~F.col(text).endswith("\n")).cast("int")
    first = F.col("chunk_line") + 1
    return pieces.filter(F.col(text) != "").withColumns({"first_line": first, "last_line": F.greatest(first, F.col("chunk_line") + lines).cast("long")}).drop("chunk_start", "chunk_line")


def cleaned(line: Column) -> Column:
    """A line of a review without marks of lists and tables; empty if it is a rule or a fence."""
    out = F.regexp_replace(line, r"\A\s+|\s+\z", "")
    out = F.regexp_replace(out, r"\A\|+|\|+\z", "")
    out = F.regexp_replace(out, r"\A\s+|\s+\z", "")
    out = F.regexp_replace(out, r"\A[-*•0-9. ]+", "")
    out = F.regexp_replace(out, r"\A`+|`+\z", "")
    out = F.regexp_replace(out, r"\A\s+|\s+\z", "")
    out = F.when(out.startswith("---"), F.lit("")).otherwise(out)
    short = F.concat(F.rtrim(F.substring(out, 1, LENGTH)), F.lit("..."))
    return F.when(F.length(out) > LENGTH, short).otherwise(out)


def is_significant(line: Column) -> Column:
    lower = F.lower(line)
    has = lambda words: "(" + "|".join(words) + ")"
    return lower.rlike(has(MARKS)) & ~lower.rlike(has(DENIALS))


def insights(reviews: DataFrame, keys: list[str], text: str = "text", most: int = INSIGHTS) -> DataFrame:
    """Rows (keys, rank, insight): the first ``most`` distinct significant lines of each review."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), cleaned), lambda x: (x != "") & is_significant(x))
    found = reviews.select(*keys, F.posexplode(F.slice(F.array_distinct(lines), 1, most)).alias("rank", "insight"))
    return found.withColumn("rank", F.col("rank") + 1)


def chunk_counts(chunks: DataFrame, file: str = "file_id") -> DataFrame:
    return chunks.groupBy(file).agg(F.count("*").alias("n_chunks"))


def first_per_file(chunks: DataFrame, file: str = "file_id") -> DataFrame:
    """Each file's first chunk."""
    place = F.row_number().over(Window.partitionBy(file).orderBy("chunk"))
    return chunks.withColumn("_place", place).filter("_place = 1").drop("_place")
