"""Finding all matches of rules in texts, by two plans with the same result.

``with_columns`` stays in the JVM: one scan, in which every rule is tried only on texts that hold one of its
keywords. It suits few rules with one group. ``with_python`` reads texts as Arrow batches; literals that the patterns
themselves require are looked for all at once, and only rules whose literals a text holds are tried on it, with
Python's byte-wise regular expressions. ``^`` and ``$`` stand for the ends of lines. Offsets are bytes of UTF-8; lines and
columns count from 1, columns in bytes, and the end point is that of the first byte behind the match.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.functions import ids
from trawl.functions.text import context_after, context_before, let, newlines
from trawl.operators.ambiguity import is_exponential
from trawl.operators.rules import Rule, literals, portable

MATCH = (
    "rule_id string, rule_name string, rule_sid string, start long, end long, start_line long, start_column long, "
    "end_line long, end_column long, matching string, groups array<string>, named map<string,string>"
)
#: What a scan measures of each rule and task, beside the matches.
STATS = "state string, n_tried long, n_matches long, seconds double"
#: Seconds that a rule may spend on one text, if its pattern can take exponential time.
PATIENCE = 5.0


def wrapped(pattern: str) -> str:
    """The pattern behind the gap before it: group 1 is the gap, group 2 the match, the pattern's own follow.

    The end of the text also matches, as nothing: else the search behind the last match would begin again
    at every character.
    """
    return rf"(?md)((?s:.*?))((?:{portable(pattern)})|\z)"


def _moved(line: Column, column: Column, text: Column) -> tuple[Column, Column]:
    """Line and column after reading ``text``."""
    n = newlines(text)
    return line + n, F.when(n > 0, F.octet_length(F.substring_index(text, "\n", -1)) + 1).otherwise(column + F.octet_length(text))


def _all_of(text: Column, rule: Rule) -> Column:
    """All matches of a rule as an array of MATCH."""
    if len(rule.names) != 1:
        raise ValueError(f"rule {rule.id} has {len(rule.names)} groups; with_python takes any number")
    pattern = F.lit(wrapped(rule.pattern))
    name = rule.names[0]
    named = lambda g: F.create_map(F.lit(name), g) if name else F.create_map().cast("map<string,string>")
    part = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    long = lambda c: c.cast("long")
    empty = F.from_json(F.lit("[]"), f"array<struct<{MATCH.replace(' string', ': string').replace(' long', ': long').replace(' array', ': array').replace(' map', ': map')}>>")
    start = F.struct(long(F.lit(0)).alias("at"), long(F.lit(1)).alias("line"), long(F.lit(1)).alias("column"), empty.alias("out"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.octet_length(m["gap"])
        line, column = _moved(state["line"], state["column"], m["gap"])
        end_line, end_column = _moved(line, column, m["hit"])
        found = F.struct(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.lit(rule.structural_id).alias("rule_sid"),
            long(begin).alias("start"), long(begin + F.octet_length(m["hit"])).alias("end"), long(line).alias("start_line"), long(column).alias("start_column"),
            long(end_line).alias("end_line"), long(end_column).alias("end_column"), m["hit"].alias("matching"), F.array(m["group"]).alias("groups"), named(m["group"]).alias("named"),
        )
        return F.struct(
            long(begin + F.octet_length(m["hit"])).alias("at"), long(end_line).alias("line"), long(end_column).alias("column"),
            F.when(m["hit"] != "", F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"),
        )

    def walk(parts: Column) -> Column:
        rows = F.transform(parts["hit"], lambda h, i: F.struct(F.get(parts["gap"], i).alias("gap"), h.alias("hit"), F.get(parts["group"], i).alias("group")))
        return F.aggregate(rows, start, step, lambda s: s["out"])

    held = text.rlike("(?md)" + portable(rule.pattern))  # far cheaper than the search with gaps, and most texts have no match
    if rule.keywords:
        any_ = F.lit(False)
        for k in rule.keywords:
            any_ = any_ | F.contains(text, F.lit(k))
        held = any_ & held
    return F.when(held, let(F.struct(part(1).alias("gap"), part(2).alias("hit"), part(3).alias("group")), walk)).otherwise(empty)


def with_columns(blobs: DataFrame, rules: Iterable[Rule], text: str = "text", context: int | None = None) -> DataFrame:
    """``blobs`` without the text, a row for each match (MATCH). Every rule must have one group. Null texts have no match.

    ``context``: adds ``before`` and ``after``, with so many lines, from the text that the scan has at hand.
    """
    kept = [f"`{c}`" for c in blobs.columns if c != text]
    found = F.concat(*[_all_of(F.coalesce(F.col(text), F.lit("")), r) for r in rules])
    rows = blobs.select(*kept, F.col(text).alias("_text"), F.explode(found).alias("_match"))
    if context is None:
        return rows.select(*kept, "_match.*")
    data = F.col("_text").cast("binary")
    before = F.decode(F.substring(data, F.lit(1), F.col("_match.start").cast("int")), "utf-8")
    after = F.decode(F.substring(data, (F.col("_match.end") + 1).cast("int"), F.octet_length("_text")), "utf-8")
    return rows.select(*kept, "_match.*", context_before(before, context).alias("before"), context_after(after, context).alias("after"))


class Tools:
    """Compiled rules, and a machine that finds all literals which they require in one pass over a text."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, self._finder(r.pattern), tuple(k.encode() for k in r.keywords), r.names) for r in rules]
        self.machine = ahocorasick.Automaton()
        needs: dict[str, set[int]] = {}
        self.always = []
        for k, rule in enumerate(rules):
            found = literals(rule)
            if found is None:
                self.always.append(k)
            for word in found or ():
                needs.setdefault(word, set()).add(k)  # a character for each byte
        for word, own in needs.items():
            self.machine.add_word(word, frozenset(own))
        self.any = bool(needs)
        if self.any:
            self.machine.make_automaton()

    @staticmethod
    def _finder(pattern: str):
        """A function that finds all matches in bytes; it raises TimeoutError after PATIENCE if the pattern can take exponential time."""
        if not is_exponential(pattern):
            return re.compile(portable(pattern).encode(), re.MULTILINE).finditer
        bounded = regex.compile(portable(pattern).encode(), regex.MULTILINE)
        return lambda body: bounded.finditer(body, timeout=PATIENCE)

    def candidates(self, body: bytes) -> list[int]:
        """The rules, in order, that may match."""
        found = set(self.always)
        if self.any:
            found.update(*{own for _, own in self.machine.iter(body.lower().decode("latin-1"))})
        return sorted(found)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def surroundings(body: bytes, start: int, end: int, lines: int) -> tuple[bytes, bytes]:
    """The line to the left of a match and ``lines`` before it; the rest of its line and up to the ``lines``-th line end."""
    at = start
    for _ in range(lines + 1):
        at = body.rfind(b"\n", 0, at)
        if at < 0:
            break
    first = end + (body[end : end + 1] == b"\n")
    last = first - 1
    for _ in range(lines):
        last = body.find(b"\n", last + 1)
        if last < 0:
            break
    return body[at + 1 : start], body[first : last + 1 if last >= 0 else len(body)] if lines else b""


class Meter:
    """What the rules of one task cost: by rule and state, the texts tried, the matches and the seconds."""

    def __init__(self):
        self.rows: dict[tuple[str, str], list] = {}

    def add(self, rule_id: str, state: str, matches: int, seconds: float) -> None:
        own = self.rows.setdefault((rule_id, state), [0, 0, 0.0])
        own[0] += 1
        own[1] += matches
        own[2] += seconds


def with_python(blobs: DataFrame, rules: Iterable[Rule], text: str = "text", most: int | None = None, context: int | None = None, whole: Iterable[str] = (), stats: bool = False) -> DataFrame:
    """The same for any rules and for text or binary columns; groups that took no part are left out.

    ``most``: matches of a blob that are kept, in the order of rules and places (none by default). ``context``: adds
    ``before`` and ``after``, with so many lines. ``whole``: adds ``content``, the blob's text, to matches of these rules.
    ``stats``: adds STATS, null for matches, and rows without a place that hold what each task measured of each rule; a rule that
    ran out of PATIENCE on a text has the state ``timeout`` there, and what it found before is kept.
    """
    rules, whole = list(rules), frozenset(whole)
    kept = [f for f in blobs.schema.fields if f.name != text]
    more = ([] if context is None else ["before string", "after string"]) + (["content string"] if whole else [])
    measured = STATS.split(", ") if stats else []
    names = [c.split()[0] for c in [*MATCH.split(", "), *more]]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    types = [kinds[c.split()[1]] for c in [*MATCH.split(", "), *more]]
    stat_names, stat_types = [c.split()[0] for c in measured], [kinds[c.split()[1]] for c in measured]
    own_names = [f.name for f in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, meter, shape = Tools(rules), Meter(), None
        as_text = lambda b: b.decode("utf-8", "replace")
        for batch in small_batches(batches, text):
            owners: list[int] = []
            rows: list[tuple] = []
            shape = batch.schema
            for k, content in enumerate(batch.column(text).to_pylist()):
                body = b"" if content is None else content.encode("utf-8", "surrogatepass") if isinstance(content, str) else content
                ends: np.ndarray | None = None
                n = 0
                for rule, finder, keywords, groups in (tools.rules[c] for c in tools.candidates(body)):
                    if keywords and not any(w in body for w in keywords):
                        continue
                    before, began, state = n, time.perf_counter(), "completed"
                    try:
                        for m in finder(body):
                            if m.start() == m.end() or (most is not None and n >= most):
                                continue
                            n += 1
                            if ends is None:
                                ends = np.flatnonzero(np.frombuffer(body, np.uint8) == 10)
                            place = []
                            for at in m.span():
                                line = int(np.searchsorted(ends, at))
                                place += [line + 1, at - (int(ends[line - 1]) if line else -1)]
                            found = [(name, as_text(g)) for name, g in zip(groups, m.groups(), strict=True) if g is not None]
                            row = [rule.id, rule.name, rule.structural_id, *m.span(), *place, as_text(m[0]), [g for _, g in found], [(name, g) for name, g in found if name]]
                            if context is not None:
                                row += map(as_text, surroundings(body, *m.span(), context))
                            if whole:
                                row.append(as_text(body) if rule.id in whole else None)
                            owners.append(k)
                            rows.append(row)
                    except TimeoutError:
                        state = "timeout"
                    meter.add(rule.id, state, n - before, time.perf_counter() - began)
            if rows:
                found = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(owners)) for c in own_names], *found, *[pa.nulls(len(rows), t) for t in stat_types]], [*own_names, *names, *stat_names])
        if stats and meter.rows:
            told = [(rule_id, state, *values) for (rule_id, state), values in sorted(meter.rows.items())]
            ids, *values = (list(c) for c in zip(*told, strict=True))
            found = [pa.array(ids) if name == "rule_id" else pa.nulls(len(ids), t) for name, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(ids), shape.field(c).type) for c in own_names], *found, *[pa.array(v, t) for v, t in zip(values, stat_types, strict=True)]], [*own_names, *names, *stat_names])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return blobs.mapInArrow(scan, ", ".join([*own, MATCH, *more, *measured]))


def measured(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches, and the statistics (rule_id, state, n_tried, n_matches, seconds) by rule and state, of a scan with ``stats``.

    Both read ``scanned``: write it first (``plans.store.stored``), or it is scanned twice.
    """
    stats = scanned.filter("n_tried is not null").groupBy("rule_id", "state")
    sums = stats.agg(F.sum("n_tried").alias("n_tried"), F.sum("n_matches").alias("n_matches"), F.sum("seconds").alias("seconds"))
    return scanned.filter("n_tried is null").drop(*[c.split()[0] for c in STATS.split(", ")]), sums


def with_ids(matches: DataFrame, blob_id: str = "blob_id") -> DataFrame:
    """Adds structural_id (the place) and finding_id (the content)."""
    return matches.withColumns(
        {
            "structural_id": ids.match_structural_id(F.col("rule_sid"), F.col(blob_id), F.col("start"), F.col("end")),
            "finding_id": ids.finding_id(F.col("rule_sid"), F.col("groups")),
        }
    )


def _first(matches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; where equal blobs have several rows, ``order`` must tell them apart for reruns to agree."""
    ranked = matches.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def first_by_content(matches: DataFrame, blob_id: str = "blob_id", ties: Iterable[str] = ()) -> DataFrame:
    """Of a blob's matches with equal rule and groups, the first; of equal places (copies of a blob), the least by ``ties``."""
    return _first(matches, [blob_id, "rule_id", "groups"], ["start", "end", *ties])


def first_by_place(matches: DataFrame, ties: Iterable[str] = ()) -> DataFrame:
    """One row for each structural_id, the least by ``ties`` if any are given."""
    ties = list(ties)
    return _first(matches, ["structural_id"], ties) if ties else matches.dropDuplicates(["structural_id"])
