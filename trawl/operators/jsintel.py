"""What JavaScript says about its surroundings: endpoints, cloud storage, domains, packages, source maps.

Every extractor yields artifacts (category, method, value, detail, confidence, line, column); lines and
columns count from 1, columns in characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import entropy, let, mask, newlines

# Patterns of calls, properties, hosts and packages.
CALL = r"(?i)\.\s*(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
FETCH = r"(?i)\b(fetch|importScripts)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
PROPERTY = r"(?i)\b(url|uri|endpoint|path)\s*[:=]\s*['\"`]([^'\"`]+)['\"`]"
PATH = r"[A-Za-z0-9._~!$&'()*+,;=:@%/-]"
CLOUD = (
    rf"(?i)\b(?:[a-z0-9][a-z0-9.-]*\.s3(?:[.-][a-z0-9-]+)?\.amazonaws\.com(?:/{PATH}*)?|s3[.-][a-z0-9-]+\.amazonaws\.com/{PATH}+"
    rf"|storage\.googleapis\.com/{PATH}+|[a-z0-9][a-z0-9.-]*\.blob\.core\.windows\.net/{PATH}+|[a-z0-9][a-z0-9.-]*\.digitaloceanspaces\.com/{PATH}*)\b"
)
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b"
NODE_MODULES = r"(?i)(^|[/\\\"'])node_modules/(@[a-z0-9._-]+/[a-z0-9._-]+|[a-z0-9._-]+)"
REQUIRE = r"(?i)\b(require|import)\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)"
FROM = r"(?i)\b(from)\s+['\"`]([^'\"`]+)['\"`]"
SOURCE_MAP = r"(?://[#@]|/\*[#@])\s*sourceMappingURL=([^\s*]+)"
SECRET = (
    r"(?i)\b([a-z0-9_.-]*(?:api[_-]?key|secret|token|password|passwd|bearer|authorization|aws_access_key_id|aws_secret_access_key)[a-z0-9_.-]*)\b"
    r"\s*[:=]\s*['\"`]([^'\"`\s]{8,})['\"`]"
)
NO_SECRETS = ("authorization", "bearer", "basic", "token", "secret", "password", "passwd", "undefined", "null", "false", "true", "example", "changeme", "placeholder")

ARTIFACT = ("category", "method", "value", "detail", "confidence", "line", "column")


def spans(text: Column, pattern: str, groups: int, behind: Callable[[Column], Column] | None = None) -> Column:
    """All matches as an array of (hit, g1, g2, line, column).

    ``behind`` gives the part of a match (hit, g1, g2) that stands before the place to be told; the place is
    the match's start without it.
    """
    wrapped = F.lit(rf"((?s:.*?))((?:{pattern})|\z)")
    part = lambda k: F.regexp_extract_all(text, wrapped, F.lit(k))
    parts = F.struct(part(1).alias("gap"), part(2).alias("hit"), *[part(2 + k).alias(f"g{k}") for k in range(1, groups + 1)])
    none = F.array().cast("array<struct<hit:string,g1:string,g2:string,line:bigint,column:bigint>>")
    start = F.struct(F.lit(1).cast("long").alias("line"), F.lit(1).cast("long").alias("column"), none.alias("out"))

    def moved(line: Column, column: Column, s: Column) -> tuple[Column, Column]:
        n = newlines(s)
        return (line + n).cast("long"), F.when(n > 0, F.length(F.substring_index(s, "\n", -1)) + 1).otherwise(column + F.length(s)).cast("long")

    def step(state: Column, m: Column) -> Column:
        line, column = moved(state["line"], state["column"], m["gap"])
        at_line, at_column = moved(line, column, behind(m)) if behind else (line, column)
        found = F.struct(m["hit"].alias("hit"), m["g1"].alias("g1"), m["g2"].alias("g2"), at_line.alias("line"), at_column.alias("column"))
        end_line, end_column = moved(line, column, m["hit"])
        return F.struct(end_line.alias("line"), end_column.alias("column"), F.when(m["hit"] != "", F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))

    def walk(p: Column) -> Column:
        group = lambda k, i: F.get(p[f"g{k}"], i) if k <= groups else F.lit("")
        rows = F.transform(p["hit"], lambda h, i: F.struct(F.get(p["gap"], i).alias("gap"), h.alias("hit"), group(1, i).alias("g1"), group(2, i).alias("g2")))
        return F.aggregate(rows, start, step, lambda s: s["out"])

    return let(parts, walk)


def _before_last_group(tail: int, k: str = "g2") -> Callable[[Column], Column]:
    """The part of a match before its last group, which ``tail`` characters follow."""
    return lambda m: F.substring(m["hit"], F.lit(1), F.length(m["hit"]) - tail - F.length(m[k]))


def _found(df: DataFrame, text: str, pattern: str, groups: int, behind=None) -> DataFrame:
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.explode(spans(F.coalesce(F.col(text), F.lit("")), pattern, groups, behind)).alias("_m")).select(*kept, "_m.*")


def distinct(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Of equal artifacts of one text, the first."""
    own = [*keys, "category", "method", "value", "detail", "confidence"]
    return artifacts.groupBy(*own).agg(F.min(F.struct("line", "column")).alias("_at")).select(*own, "_at.line", "_at.column")


def _artifacts(found: DataFrame, keys: list[str], category: str, method: Column, value: Column, detail: Column, confidence: Column | None = None) -> DataFrame:
    columns = (F.lit(category), method, value, detail, F.lit("info") if confidence is None else confidence, F.col("line"), F.col("column"))
    return found.select(*keys, *[c.alias(n) for c, n in zip(columns, ARTIFACT, strict=True)])


def is_endpoint(value: Column) -> Column:
    lower = F.lower(value)
    return F.octet_length(value).between(2, 300) & ~lower.rlike(r"\A(data:|javascript:)") & ~value.rlike("[<>{}]") & F.contains(value, F.lit("/"))


def endpoints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Calls of HTTP methods, fetch and importScripts, and properties that hold URLs."""
    df, value, none = df.select(*keys, text), F.col("g2"), F.lit("")
    calls = _artifacts(_found(df, text, CALL, 2, _before_last_group(1)), keys, "endpoint", F.upper("g1"), value, F.lit("method call"))
    fetches = _artifacts(_found(df, text, FETCH, 2, _before_last_group(1)), keys, "endpoint", none, value, F.concat(F.lower("g1"), F.lit(" call")))
    properties = _artifacts(_found(df, text, PROPERTY, 2, _before_last_group(1)), keys, "endpoint", none, value, F.lit("url-like property"))
    return distinct(calls.unionByName(fetches).unionByName(properties).filter(is_endpoint(F.col("value"))), keys)


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"[.,;:)\]}\"']+\z", "")


def cloud_urls(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    found = _found(df.select(*keys, text), text, CLOUD, 0)
    return distinct(_artifacts(found, keys, "cloud_url", F.lit(""), _trimmed(F.col("hit")), F.lit("")), keys)


def subdomains(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Domain names, without file names and numbers."""
    found = _artifacts(_found(df.select(*keys, text), text, DOMAIN, 0), keys, "subdomain", F.lit(""), F.lower(_trimmed(F.col("hit"))), F.lit(""))
    noise = F.col("value").rlike(r"\.\.|\A\.|\.\z|\.(js|json|css)\z|\A[0-9.]*\z")
    return distinct(found.filter(~noise), keys)


def package_name(name: Column) -> Column:
    """A package's name in a registry, or null: no relative paths, no built-ins, two parts if scoped."""
    trimmed = F.regexp_replace(F.trim(name), "\\A[\"']+|[\"']+\\z", "")

    def judge(n: Column) -> Column:
        scoped = F.lower(F.substring_index(n, "/", 2))
        plain = F.lower(F.substring_index(n, "/", 1))
        found = F.when(n.rlike(r"\A(node:|\.|/)"), F.lit(None).cast("string")).when(n.startswith("@"), F.when(F.contains(n, F.lit("/")), scoped)).otherwise(plain)
        return let(found, lambda v: F.when((F.octet_length(v) <= 214) & ~F.contains(v, F.lit("..")) & v.rlike(r"\A(@[\p{Ll}\p{Nd}_.-]+/)?[\p{Ll}\p{Nd}_.-]+\z"), v))

    return let(trimmed, judge)


def dependencies(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Packages that are imported, named in paths, or listed in a package file; each with its first line."""
    df = df.select(*keys, text)
    kinds = ((NODE_MODULES, 0, "node_modules path"), (REQUIRE, None, "import/require"), (FROM, 1, "import/from"))
    found = None
    for order, (pattern, tail, detail) in enumerate(kinds, 1):
        behind = _before_last_group(tail) if tail is not None else lambda m: F.substring(m["hit"], F.lit(1), F.position(m["g2"], m["hit"]) - 1)
        own = _artifacts(_found(df, text, pattern, 2, behind), keys, "dependency", F.lit(""), F.col("g2"), F.lit(detail)).withColumn("_order", F.lit(order))
        found = own if found is None else found.unionByName(own)
    listed = None
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        names = F.json_object_keys(F.get_json_object(F.col(text), f"$.{section}"))
        own = df.filter(F.contains(F.col(text), F.lit(f'"{section}"'))).select(*keys, F.explode(names).alias("value"), F.col(text).alias("_text"), F.lit(section).alias("detail"))
        listed = own if listed is None else listed.unionByName(own)
    paths = F.filter(F.json_object_keys(F.get_json_object(F.col(text), "$.packages")), lambda k: F.contains(k, F.lit("node_modules/")))
    locked = df.filter(F.contains(F.col(text), F.lit('"packages"'))).select(*keys, F.explode(paths).alias("_path"), F.col(text).alias("_text"), F.lit("lockfile packages").alias("detail"))
    locked = locked.select(*keys, F.substring_index("_path", "node_modules/", -1).alias("value"), "_text", "detail")
    listed = listed.unionByName(locked)
    before = F.call_function("substring_index", F.col("_text"), F.concat(F.lit('"'), F.col("value"), F.lit('"')), F.lit(1))
    listed = listed.select(
        *keys, F.lit("dependency").alias("category"), F.lit("").alias("method"), "value", "detail", F.lit("info").alias("confidence"),
        (newlines(before) + 1).cast("long").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 2).cast("long").alias("column"), F.lit(0).alias("_order"),
    )
    named = found.unionByName(listed).withColumn("value", package_name(F.col("value"))).filter("value is not null")
    first = named.groupBy(*keys, "category", "method", "value", "confidence").agg(F.min(F.struct("line", "_order", "column", "detail")).alias("_at"))
    return first.select(*keys, "category", "method", "value", "_at.detail", "confidence", "_at.line", "_at.column")


MAP = "sources array<string>, sourcesContent array<string>"


def _data(reference: Column) -> Column:
    """The content of a ``data:`` address in base64 or percent form; null where it is damaged."""
    payload = F.regexp_extract(reference, r"(?s)\A[^,]*,(.*)\z", 1)
    coded = F.lower(F.regexp_extract(reference, r"\A([^,]*),", 1))
    return F.when(F.contains(coded, F.lit(";base64")), F.try_to_binary(payload, F.lit("base64")).cast("string")).otherwise(F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B"))))


def source_maps(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """References to source maps outside the text."""
    found = _found(df.select(*keys, text), text, SOURCE_MAP, 1, _before_last_group(0, "g1"))
    value = F.regexp_replace(F.col("g1"), r"\*/\z", "")
    return distinct(_artifacts(found.filter(~F.col("g1").startswith("data:")), keys, "source_map", F.lit(""), value, F.lit("external source map reference")), keys)


def inline_maps(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Source maps within the text, by the number of sources they hold; damaged ones are none."""
    found = _found(df.select(*keys, text), text, SOURCE_MAP, 1, _before_last_group(0, "g1")).filter(F.col("g1").startswith("data:"))
    parsed = F.from_json(_data(F.regexp_replace(F.col("g1"), r"\*/\z", "")), MAP)
    held = F.size(F.filter(F.coalesce(parsed["sourcesContent"], F.array().cast("array<string>")), lambda c: c != ""))
    inline = found.withColumn("_held", F.when(parsed.isNotNull(), held)).filter("_held is not null")
    detail = F.concat(F.col("_held").cast("string"), F.lit(" embedded source file(s)"))
    return distinct(_artifacts(inline, keys, "source_map", F.lit(""), F.lit("inline source map"), detail), keys)


def embedded_sources(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows (keys, path, content) of the sources in source maps within the text, in base64 or percent form."""
    found = _found(df.select(*keys, text), text, SOURCE_MAP, 1).filter(F.col("g1").startswith("data:"))
    parsed = F.from_json(_data(F.regexp_replace(F.col("g1"), r"\*/\z", "")), MAP)
    rows = found.select(*keys, parsed.alias("m")).select(*keys, "m.sources", F.posexplode("m.sourcesContent").alias("i", "content")).filter("content <> ''")
    name = F.coalesce(F.get("sources", F.col("i")), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r"\Awebpack://", ""), r"\A\./", "")
    clean = F.regexp_replace(F.translate(clean, "\\", "/"), r"(\.\./)+", "")
    path = F.when(F.trim(name) == "", F.concat(F.lit("source-"), F.col("i") + 1, F.lit(".js"))).when(clean == "", F.lit("source.js")).otherwise(clean)
    return rows.select(*keys, path.alias("path"), "content")


def analyze(df: DataFrame, keys: list[str], text: str = "text", secrets: bool = False) -> DataFrame:
    """The artifacts of all extractors, of equal ones of a text the first; ``secrets`` adds the heuristic for secrets."""
    found = endpoints(df, keys, text)
    for extractor in (cloud_urls, subdomains, dependencies, source_maps, inline_maps, *([generic_secrets] if secrets else [])):
        found = found.unionByName(extractor(df, keys, text))
    first = found.groupBy(*keys, "category", "method", "value", "detail").agg(F.min(F.struct("line", "column", "confidence")).alias("_at"))
    return first.select(*keys, "category", "method", "value", "detail", F.coalesce("_at.confidence", F.lit("info")).alias("confidence"), "_at.line", "_at.column")


def generic_secrets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Assignments to names that sound secret; the value is masked, and its entropy sets the confidence."""
    found = _found(df.select(*keys, text), text, SECRET, 2, _before_last_group(1))
    lower = F.lower("g2")
    none = F.lit(False)
    for w in NO_SECRETS:
        none = none | (lower == w) | F.contains(lower, F.lit(f"{w} value"))
    sure = F.when(entropy(F.col("g2")) >= 3.5, F.lit("medium")).otherwise(F.lit("low"))
    return distinct(_artifacts(found.filter(~none), keys, "generic_secret_heuristic", F.lit(""), mask(F.col("g2")), F.col("g1"), sure), keys)


def unregistered(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Dependencies that a registry (name) does not hold: candidates for dependency confusion."""
    missing = packages.join(registry.select(F.col("name").alias("value")), "value", "left_anti")
    return missing.withColumns({"category": F.lit("dependency_confusion"), "detail": F.lit("package missing from configured npm registry"), "confidence": F.lit("low")})
