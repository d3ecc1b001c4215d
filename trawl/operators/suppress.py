"""Predicates that drop matches which are no secrets: prompts, labels, placeholders, values without entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import entropy, let

# Fixed values.
PASSWORD_WORDS = ("密码", "口令")
PASSWORD_PROMPTS = (
    "请输入", "请填写", "请设置", "请确认", "输入", "填写", "不能为空", "不正确", "错误", "不一致", "确认密码", "登录密码", "忘记密码", "修改密码", "重置密码",
)
ENGLISH_PROMPTS = ("please", "enter", "input", "required", "confirm", "forgot", "forget", "reset", "change", "placeholder", "label", "repeat")
TYPE_MARKERS = ("color:", "date:", "email:", "month:", "number:", "range:", "tel:", "text:", "time:", "url:", "week:")
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "replace", "insert", "yourtoken", "yourapitoken", "yourapikey", "tokenhere")
CLIENT_PLACEHOLDERS = ("yourclientsecret", "clientsecrethere", "testsecret", "mocksecret", "fakesecret", "demosecret", "notasecret", "secretvalue")
PROMPT_EDGES = " \t\r\n\"'`“”‘’:：.!！?？。；;"
LEAST_ENTROPY = 3.0
#: Characters that a bare token takes at most, those before it that are searched, and those around it that labels are sought in.
BARE, BEFORE, AROUND = 512, 256, 512
#: The predicate of each rule of the built-in pack that has one.
OPAQUE_RULES, CLIENT_RULES, PROMPT_RULES = ("tr.http.query-secret", "tr.token.1"), ("tr.client-secret.1",), ("tr.password.1",)
CONTEXT_RULES = ("tr.linkedin.1",)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def is_password_prompt(value: Column) -> Column:
    """Text of a form rather than a password."""
    value = F.regexp_replace(value, r"\\\\(u[0-9A-Fa-f]{4})", r"\\$1")
    decoded = F.aggregate(
        F.filter(F.split(value, r"(?=\\u[0-9A-Fa-f]{4})|(?<=\\u[0-9A-Fa-f]{4})"), lambda p: p != ""), F.lit(""),
        lambda out, p: F.concat(out, F.when(p.rlike(r"\A\\u[0-9A-Fa-f]{4}\z"), F.decode(F.unhex(F.substring(p, 3, 4)), "utf-16be")).otherwise(p)),
    )
    value = F.when(F.contains(value, F.lit("\\u")), decoded).otherwise(value)
    edge = "[" + "".join("\\" + c if c in "\"'`.?:" else c for c in PROMPT_EDGES) + "]*"
    trimmed = F.regexp_replace(value, rf"\A{edge}|{edge}\z", "")

    def judge(v: Column) -> Column:
        lower = F.lower(v)
        return F.when(has_any(v, PASSWORD_WORDS), has_any(v, PASSWORD_PROMPTS)).otherwise(F.contains(lower, F.lit("password")) & has_any(lower, ENGLISH_PROMPTS))

    return let(trimmed, judge)


def is_type_label(value: Column, window: Column) -> Column:
    """A short label among the names of input types: a translation table."""
    squeezed = F.translate(F.lower(window), " \t\r\n\"'", "")

    def count(w: Column) -> Column:
        n = F.lit(0)
        for m in TYPE_MARKERS:
            n = n + F.contains(w, F.lit(m)).cast("int")
        return n >= 6

    return value.rlike(r"\A\p{L}{1,32}\z") & let(squeezed, count)


def is_opaque(value: Column) -> Column:
    """A value that could be a random secret: long enough, letters and digits, varied, no placeholder."""

    def judge(v: Column) -> Column:
        compact = F.regexp_replace(F.lower(v), "[_.-]", "")
        n = F.octet_length(v)
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.hex(v.cast("binary")), 2 * k + 1, F.lit(2)))
        varied = F.when(n > 0, F.size(F.array_distinct(pairs)) >= 6).otherwise(False)
        return (n >= 12) & (n <= 256) & v.rlike("[A-Za-z]") & v.rlike("[0-9]") & varied & ~has_any(compact, PLACEHOLDERS) & (entropy(v) >= LEAST_ENTROPY)

    return let(F.regexp_replace(F.regexp_replace(value, r"\A\s+|\s+\z", ""), r"=+\z", ""), judge)


def is_client_secret(value: Column) -> Column:
    return is_opaque(value) & ~has_any(F.regexp_replace(F.lower(value), "[_.-]", ""), CLIENT_PLACEHOLDERS)


def is_in_context(value: Column, before: Column, line: Column) -> Column:
    """A token that stands alone on its line, or whose service is named shortly before it."""
    near = F.lower(F.substring(before, -BEFORE, BEFORE))
    named = F.contains(near, F.lit("linkedin")) | (F.contains(near, F.lit("authorization")) & F.contains(near, F.lit("bearer"))) | near.rlike(r"access[_ -]?token")
    return (F.length(value) <= BARE) & ((F.trim(line) == value) | named)


def unsuppressed(matches: DataFrame, window: Column | None = None) -> DataFrame:
    """Matches that no predicate of their rule drops. ``window``: the text around a match, for the type labels.

    Matches with ``before`` and ``after`` bring their own window, and are also held against their context.
    """
    around = "before" in matches.columns and "after" in matches.columns
    if window is None and around:
        window = F.concat(F.substring("before", -AROUND, AROUND), "matching", F.substring("after", 1, AROUND))
    value = F.get(F.col("groups"), 0)
    rule = F.col("rule_id")
    prompt = is_password_prompt(value) | (is_type_label(value, window) if window is not None else F.lit(False))
    drop = F.when(rule.isin(*PROMPT_RULES), prompt).when(rule.isin(*CLIENT_RULES), ~is_client_secret(value)).when(rule.isin(*OPAQUE_RULES), ~is_opaque(value))
    if around:
        line = F.concat(F.substring_index("before", "\n", -1), "matching", F.substring_index("after", "\n", 1))
        drop = drop.when(rule.isin(*CONTEXT_RULES), ~is_in_context(value, F.col("before"), line))
    return matches.filter(~F.coalesce(drop.otherwise(F.lit(False)), F.lit(False)))
