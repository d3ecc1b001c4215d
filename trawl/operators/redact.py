"""Texts without addresses and secrets, for readers outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.ranks import numbered
from trawl.functions.text import let

# What is looked for.
URL = r"https?://[^\s\"'<>\\)]+"
HOSTNAME = r"\b(?:[A-Za-z0-9-]{2,}\.)+[A-Za-z]{2,}\b"
AUTH = r"(?i)(authorization\s*[:=]\s*[\"']?)(bearer|basic)\s+[^\"',\s]+"
COOKIE = r"(?i)((?:cookie|set-cookie)\s*[:=]\s*[\"']?)[^\"'\n]+"
QUERY_SECRET = r"(?i)([?&](?:token|key|secret|password|passwd|auth|session|jwt|access_token|id_token|refresh_token)=)[^&\s\"'<>]+"
SECRET = r"(?i)((?:api[_-]?key|secret|token|password|passwd|client[_-]?secret|access[_-]?token|refresh[_-]?token)\s*[:=]\s*[\"']?)[^\"',\s]{6,}"
RANDOM = r"\b[A-Za-z0-9_/\-+=]{32,}\b"
#: HOSTNAME for Java: labels and the ending give nothing back (``}+``), as no dot and no word boundary is within them.
_HOSTNAME = HOSTNAME.replace("{2,}", "{2,}+")
#: Extensions of files that a review reads.
REVIEWED = ("js", "mjs", "cjs", "json", "map", "jsx", "ts", "tsx")


#: Beginnings of placeholders, which are no random values.
PLACEHOLDER = r"(?:TARGET|EXTERNAL)_(?:ORIGIN|HOST)_|(?:ORIGIN|HOST|SECRET_VALUE|COOKIE_VALUE)_REDACTED|SECRET_CANDIDATE|HIGH_ENTROPY_VALUE_REDACTED|FILE_"


def _random_replaced(text: Column) -> Column:
    """Long random values as marks that tell their length; placeholders stay."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(rf"({RANDOM})"), F.lit(1)), lambda v: ~v.rlike(rf"\A(?:{PLACEHOLDER})")))
    mark = lambda v: F.concat(F.lit("HIGH_ENTROPY_VALUE_REDACTED_LEN_"), F.length(v).cast("string"))
    longest = F.array_sort(found, lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0))
    return F.aggregate(longest, text, lambda out, v: F.replace(out, v, mark(v)))


def redacted(text: Column, standard: bool = True) -> Column:
    """The text with hosts, credentials and (in the standard mode) long random values replaced.

    Placeholders carry no numbers and no lengths, so the same text gives the same result wherever it stands;
    ``numbered_text`` gives them both.
    """
    out = F.regexp_replace(text, URL, "ORIGIN_REDACTED")
    out = F.regexp_replace(out, HOSTNAME, "HOST_REDACTED")
    out = _credentials(out, "SECRET_CANDIDATE")
    return F.regexp_replace(out, RANDOM, "HIGH_ENTROPY_VALUE_REDACTED") if standard else out


def _credentials(text: Column, candidate: str) -> Column:
    out = F.regexp_replace(text, AUTH, "$1$2 SECRET_VALUE_REDACTED")
    out = F.regexp_replace(out, COOKIE, "$1COOKIE_VALUE_REDACTED")
    out = F.regexp_replace(out, QUERY_SECRET, "$1SECRET_VALUE_REDACTED")
    return F.regexp_replace(out, SECRET, f"$1{candidate}")


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"\A(https?://[^/?#]+)", 1)


def _urls(text: Column) -> Column:
    """All URLs of a text, null if it has none: a search for a fixed part spares most texts the pattern."""
    return F.when(text.contains("://"), F.regexp_extract_all(text, F.lit(rf"({URL})"), F.lit(1)))


def _hostnames(text: Column) -> Column:
    """All host names of a text in lower case, null if it has none; every one has a dot before letters."""
    return F.when(text.rlike(r"\.[A-Za-z]{2}"), F.transform(F.regexp_extract_all(text, F.lit(rf"({_HOSTNAME})"), F.lit(1)), F.lower))


def _without_urls(text: Column) -> Column:
    return F.when(text.contains("://"), F.regexp_replace(text, URL, " ")).otherwise(text)


def _numbered_names(df: DataFrame, key: str, found: Column, targets: list[str], kind: str, host: Column) -> DataFrame:
    """Rows (name, placeholder) of the names in ``found`` (an array), numbered by first text, place there, and kind."""
    rows = df.select(key, F.posexplode(found).alias("at", "name"))
    first = rows.groupBy("name").agg(F.min(F.struct(F.col(key).alias("text"), "at")).alias("first"))
    own = host.isin(*[t.lower() for t in targets]) if targets else F.lit(False)
    named = first.select("name", F.col("first.text").alias("text"), F.col("first.at").alias("at"), F.when(own, F.lit("TARGET")).otherwise(F.lit("EXTERNAL")).alias("kind"))
    return numbered(named, ["text", "at", "name"], keys=("kind",)).select("name", F.concat("kind", F.lit(f"_{kind}_"), F.col("number").cast("string")).alias("placeholder"))


def _numbered_origins(df: DataFrame, key: str, targets: list[str], found: Column) -> DataFrame:
    host = F.lower(F.regexp_replace(F.regexp_extract("name", r"\Ahttps?://(?:[^@]*@)?([^/?#]*)", 1), r":[0-9]*\z", ""))
    return _numbered_names(df, key, found, targets, "ORIGIN", host).withColumnRenamed("name", "origin")


def _numbered_hosts(df: DataFrame, key: str, targets: list[str], found: Column) -> DataFrame:
    first = df.select(key, F.explode(found).alias("host")).groupBy("host").agg(F.min(key).alias("first"))
    kind = F.when(F.col("host").isin(*targets), F.lit("TARGET_HOST_")).otherwise(F.lit("EXTERNAL_HOST_")) if targets else F.lit("EXTERNAL_HOST_")
    named = numbered(first.withColumn("kind", kind), ["first", "host"], keys=("kind",))
    return named.select("host", F.concat("kind", F.col("number").cast("string")).alias("placeholder"))


def origins(df: DataFrame, key: str, targets: list[str], text: str = "text") -> DataFrame:
    """Rows (origin, placeholder): every origin of a URL in the corpus, numbered in the order in which they are met."""
    return _numbered_origins(df, key, targets, F.transform(_urls(F.col(text)), _origin))


def hosts(df: DataFrame, key: str, targets: list[str], text: str = "text") -> DataFrame:
    """Rows (host, placeholder): every host of the corpus, numbered by its first text and name, without a sort in one task."""
    return _numbered_hosts(df, key, targets, _hostnames(F.col(text)))


def _named(value: Column, pattern: str, name) -> Column:
    """The text with each match of a pattern exchanged by its name's placeholder (in ``_names``) and what follows the name."""
    put = lambda n, h: F.concat(F.coalesce(F.try_element_at("_names", n), n), F.substring(h, F.length(n) + 1, F.length(h)))
    hits = F.transform(F.regexp_extract_all(value, F.lit(rf"({pattern})"), F.lit(1)), lambda h: let(name(h), lambda n: put(n, h)))
    return F.array_join(F.zip_with(F.split(value, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


def _numbered_candidates(text: Column) -> Column:
    parts = F.split(text, "SECRET_CANDIDATE_#", -1)
    joined = F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("SECRET_CANDIDATE_"), k.cast("string"), p))), "")
    return F.when(text.contains("SECRET_CANDIDATE_#"), joined).otherwise(text)


def numbered_text(df: DataFrame, key: str, targets: list[str], text: str = "text", standard: bool = True) -> DataFrame:
    """``df`` with ``redacted``: origins and hosts by their numbers, candidates numbered within the text.

    The names of each text are looked for once and kept in a table. The numbers come from two tables of names; each text joins the
    names it holds, so the names of the corpus are in no one place. What one step gives the next is evaluated once (``let``).
    """
    from trawl.plans.store import stored

    body = F.coalesce(F.col(text), F.lit(""))
    found = df.select(key, F.transform(_urls(body), _origin).alias("_origins"), let(_without_urls(body), _hostnames).alias("_hosts"))
    found = stored(found.filter("size(_origins) > 0 or size(_hosts) > 0"))
    numbers = _numbered_origins(found, key, targets, F.col("_origins")).withColumnRenamed("origin", "name")
    numbers = numbers.unionByName(_numbered_hosts(found, key, targets, F.col("_hosts")).withColumnRenamed("host", "name"))
    own = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("_origins", "_hosts")])
    names = found.select(key, F.explode(F.array_distinct(own)).alias("name")).join(numbers, "name")
    table = names.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("name", "placeholder"))).alias("_names"))  # the names of one text
    joined = df.join(table, key, "left")

    # A text without names has nothing to exchange, one without these signs no credentials.
    exchanged = lambda t: let(_named(t, URL, _origin), lambda out: _named(out, _HOSTNAME, F.lower))
    hidden = lambda t: F.when(t.contains(":") | t.contains("="), _credentials(t, "SECRET_CANDIDATE_#")).otherwise(t)
    out = let(let(F.when(F.col("_names").isNull(), body).otherwise(let(body, exchanged)), hidden), _numbered_candidates)
    return joined.withColumn("redacted", let(out, _random_replaced) if standard else out).drop("_names")


def reviewed(url: Column) -> Column:
    """Whether a path, without its query, has an extension that a review reads."""
    clean = F.regexp_replace(url, r"[?#].*\z", "")
    return F.lower(F.regexp_extract(clean, r"\.([A-Za-z0-9]+)\z", 1)).isin(*REVIEWED)


def path_names(files: DataFrame) -> DataFrame:
    """Rows (path, placeholder): ``FILE_n_name`` for every path, numbered by path, the name with plain characters only."""
    clean = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"/+\z", "")
    base = F.regexp_replace(F.substring_index(clean, "/", -1), r"[^A-Za-z0-9._-]+", "_")
    paths = numbered(files.select("path").distinct(), ["path"])
    return paths.select("path", F.concat(F.lit("FILE_"), F.col("number").cast("string"), F.lit("_"), F.when(base == "", F.lit("file")).otherwise(base)).alias("placeholder"))


def redaction_map(df: DataFrame, key: str, targets: list[str], text: str = "text") -> DataFrame:
    """Rows (kind, name, placeholder) of all that ``numbered_text`` exchanged, to undo it by."""
    found = origins(df, key, targets, text).select(F.lit("origin").alias("kind"), F.col("origin").alias("name"), "placeholder")
    plain = df.withColumn(text, F.regexp_replace(text, URL, " "))
    return found.unionByName(hosts(plain, key, targets, text).select(F.lit("host").alias("kind"), F.col("host").alias("name"), "placeholder"))
