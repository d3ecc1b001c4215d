"""Scalar expressions over text: binary test, context, entropy, masks, redacted queries, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters with these in their names are secret.
SENSITIVE = ("token", "secret", "password", "passwd", "key", "auth", "session", "jwt")


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192 bytes."""
    return F.position(F.unhex(F.lit("00")), F.substring(content.cast("binary"), 1, 8192)) > 0


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def context_before(prefix: Column, lines: int) -> Column:
    """The rest of the match's line to its left, and up to ``lines`` whole lines before it."""
    return F.substring_index(prefix, "\n", -(lines + 1))


def context_after(suffix: Column, lines: int) -> Column:
    """Up to the ``lines``-th line end after the match; a line end right behind the match is passed over first."""

    def cut(rest: Column) -> Column:
        head = F.substring_index(rest, "\n", lines)
        return F.when(F.length(head) < F.length(rest), F.concat(head, F.lit("\n"))).otherwise(head)

    return let(F.regexp_replace(suffix, r"\A\n", ""), cut)


def entropy(text: Column, by: str = "") -> Column:
    """Shannon entropy in bits per character, rounded to 9 decimals so that the order of sums does not show."""

    def measure(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.round(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), 9)

    return F.when(F.length(text) > 0, let(F.filter(F.split(text, by), lambda c: c != ""), measure)).otherwise(F.lit(0.0))


def mask(value: Column) -> Column:
    """The ends of a secret: nothing of 8 bytes, two of up to 16, four of more."""
    n = F.octet_length(value)
    ends = lambda k: F.concat(F.substring(value, 1, k), F.lit("..."), F.substring(value, -k, k))
    return F.when(n <= 8, F.lit("****")).when(n <= 16, ends(2)).otherwise(ends(4))


def redact_query(url: Column) -> Column:
    """A URL whose sensitive query parameters have lost their values."""
    start = F.instr(url, "?")
    after = F.substring(url, start + 1, F.length(url))
    query, fragment = F.substring_index(after, "#", 1), F.regexp_extract(after, r"(?s)\A[^#]*(#.*)\z", 1)

    def pair(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        secret = F.lower(key).rlike("|".join(SENSITIVE)) & (F.length(p) > F.length(key) + 1)
        return F.when(secret, F.concat(key, F.lit("=<redacted>"))).otherwise(p)

    redacted = F.array_join(F.transform(F.split(query, "&"), pair), "&")
    return F.when(start == 0, url).otherwise(F.concat(F.substring(url, F.lit(1), start), redacted, fragment))


def size_in_bytes(text: Column) -> Column:
    """``10MB`` as bytes; KB, MB and GB are powers of 1024; null if it is no size."""
    trimmed = F.upper(F.trim(text))
    number, unit = F.regexp_extract(trimmed, r"\A([0-9]+)\s*(B|KB|MB|GB)?\z", 1), F.regexp_extract(trimmed, r"\A([0-9]+)\s*(B|KB|MB|GB)?\z", 2)
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1).cast("long")
    return F.when(number != "", number.cast("long") * factor)
