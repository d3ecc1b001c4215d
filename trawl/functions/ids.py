"""Content-addressed identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.unhex(F.lit("00"))


def _bytes(value: Column) -> Column:
    return value.cast("string").cast("binary")


def blob_id(content: Column) -> Column:
    """Git's id of a blob: SHA-1 of ``blob <bytes>\\0`` and the content; 40 hex digits."""
    return F.sha1(F.concat(_bytes(F.concat(F.lit("blob "), F.octet_length(content).cast("string"))), _zero(), content.cast("binary")))


def rule_structural_id(pattern: Column) -> Column:
    """SHA-1 of a pattern whose named groups have lost their names."""
    return F.sha1(F.regexp_replace(pattern, r"\(\?P<[^>]+>", "(").cast("binary"))


def match_structural_id(rule_sid: Column, blob: Column, start: Column, end: Column) -> Column:
    """A match's place: rule, blob (its 20 bytes) and byte offsets, between zero bytes."""
    return F.sha1(F.concat(_bytes(rule_sid), _zero(), F.unhex(blob), _zero(), _bytes(start), _zero(), _bytes(end)))


def finding_id(rule_sid: Column, groups: Column) -> Column:
    """A finding's content: rule and JSON array of the groups in base64 (null for no array)."""
    encoded = F.transform(groups, lambda g: F.regexp_replace(F.base64(g.cast("binary")), r"[\r\n]", ""))
    json = F.when(groups.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(encoded, lambda e: F.concat(F.lit('"'), e, F.lit('"'))), ","), F.lit("]")))
    return F.sha1(F.concat(_bytes(rule_sid), _zero(), _bytes(json)))
