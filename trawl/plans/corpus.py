"""Queries over the driver's tables with something planted: texts are read whole, with credentials, prompts or scripts at their ends,
written to folders and read back, or kept in stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import ids, suffix, urls
from trawl.operators import chunks, detect, jsintel, rules, suppress, triage
from trawl.plans import mirror, reviews
from trawl.plans.store import Store, shared_folder, stored
from trawl.sources import folder

#: Rules with letters beyond ASCII, in either case.
FOREIGN = (
    rules.Rule("tr.foreign.1", "École", r"(ÉCOLE-[0-9]{4})"), rules.Rule("tr.foreign.2", "Пароль", r"ПАРОЛЬ=([0-9]{4})"), rules.Rule("tr.foreign.3", "Straße", r"(?i)(straße-[a-z]+)"),
)
SAMPLES = tuple((r, rules.sample(r)) for r in rules.pack())
KEY = rules.Rule("tr.pair.key", "Key id", r"\b(AKIA[A-Z2-7]{16})\b", keywords=("AKIA",))
SECRET = rules.Rule("tr.pair.secret", "Secret key", r"aws_secret_access_key = \"([A-Za-z0-9/+=]{40})\"", keywords=("aws_secret",))
#: What ends a host, and the public suffixes that are known.
ENDINGS = ("co.uk", "b.ck", "www.ck", "city.kobe.jp", "x.kobe.jp", "com", "example.unknown", "s3.amazonaws.com")
SUFFIXES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "s3.amazonaws.com")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from trawl.plans.catalog import table

    return table(spark, sf_dir, name)


def _chosen(values: list[str], by) -> F.Column:
    """One of some fixed texts by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def match_foreign(spark, d):
    """Rules with accented and Cyrillic capitals, planted in either case behind each document's text."""
    planted = _chosen(["ÉCOLE-1234", "école-1234", "ПАРОЛЬ=9876", "пароль=9876", "STRAßE-abc", "nothing"], F.col("doc_id"))
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), planted).alias("text"))
    return detect.with_python(docs, FOREIGN).select("doc_id", "rule_id", "start", "matching")


def match_samples(spark, d):
    """Each rule of the whole pack on documents that end with a text it matches."""
    texts = _chosen([f"\n {text} \n" for _, text in SAMPLES], F.col("doc_id"))
    name = _chosen([r.id for r, _ in SAMPLES], F.col("doc_id"))
    docs = _table(spark, d, "documents").select("doc_id", name.alias("planted"), F.octet_length(F.coalesce("text", F.lit(""))).alias("from"), F.concat(F.coalesce("text", F.lit("")), texts).alias("text"))
    found = detect.with_python(docs, [r for r, _ in SAMPLES]).filter("rule_id = planted and start >= from")
    return found.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n_matches"))


def suppressed_planted(spark, d):
    """Prompts, placeholders and real values behind each turn of the conversations: what no predicate drops."""
    own = F.sha2(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    planted = [
        F.lit("password = '请输入密码'"), F.lit("password: \"Please enter your password\""), F.concat(F.lit("passwd = 'hunter-"), F.substring(own, 1, 12), F.lit("'")),
        F.lit("client_secret: 'your_client_secret_1234'"), F.concat(F.lit("client_secret: '"), own, F.lit("'")), F.lit("see https://h.example/x?api_key=aaaaaaaaaaaaaaaa"),
        F.concat(F.lit("see https://h.example/x?api_key="), own, F.lit("#top")), F.concat(F.lit("token = \""), F.repeat(F.lit("0123456789"), 4), F.lit("\"")),
    ]
    text = F.element_at(F.array(*planted), ((F.col("conv_id") + F.col("turn")) % len(planted) + 1).cast("int"))
    turns = _table(spark, d, "conversations").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).alias("from"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), text).alias("text"))
    found = detect.with_python(turns, rules.BUILTIN, context=2).filter("start >= from")
    kept = suppress.unsuppressed(found).withColumn("kept", F.lit(True)).select("conv_id", "turn", "rule_id", "start", "kept")
    every = found.groupBy("rule_id").agg(F.count("*").alias("n_found"))
    left = kept.groupBy("rule_id").agg(F.count("*").alias("n_kept"))
    return every.join(left, "rule_id", "left").select("rule_id", "n_found", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"))


def paired_credentials(spark, d):
    """Key ids and secrets behind each document: apart by 400 bytes, on either side, too far, and two of them."""
    number = F.col("doc_id").cast("string")
    key = F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(F.md5(number.cast("binary")), 1, 16)), "0189", "GHIJ"))
    secret = lambda salt: F.concat(F.lit('aws_secret_access_key = "'), F.sha1(F.concat(number, F.lit(salt)).cast("binary")), F.lit('"'))
    gap = lambda n: F.lit(" " + "." * (n - 2) + " ")
    cases = [
        F.concat(key, gap(400), secret("a")), F.concat(secret("b"), gap(300), key), F.concat(key, gap(2000), secret("c")),
        F.concat(secret("d"), gap(20), key, gap(50), secret("e")), F.concat(secret("f"), gap(60), key, gap(60), secret("g")),
    ]
    planted = F.element_at(F.array(*cases), (F.col("doc_id") % len(cases) + 1).cast("int"))
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), planted).alias("text"))
    named = docs.select("doc_id", ids.blob_id(F.col("text")).alias("blob_id"), "text")
    found = detect.with_ids(detect.with_python(named, [KEY, SECRET]))
    pairs = triage.paired_near(found, [KEY.id], [SECRET.id])
    return found.filter(F.col("rule_id") == KEY.id).select("doc_id", F.col("structural_id").alias("key_id")).join(pairs, "key_id").select("doc_id", "key", "secret", "side", "distance")


def scope_suffix(spark, d):
    """Registered domains of the pages' hosts under endings with wildcard and exception rules, and whether they belong to one target."""
    ending = _chosen(list(ENDINGS), F.col("page_id"))
    name = F.concat(F.substring_index(urls.hostname(F.col("url")), ".", 1), F.lit("."), ending)
    root = suffix.known(spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string"))
    page = _table(spark, d, "pages").select("page_id", name.alias("host"))
    return page.select("page_id", "host", suffix.registered(F.col("host"), root).alias("domain"))


def mirror_folder(spark, d):
    """Pages and documents written as a mirror of downloads, two contents to some paths, and read back as a folder with hidden files."""
    page = _table(spark, d, "pages").select(F.concat(F.lit("https://h.example/p/"), (F.col("page_id") % 100).cast("string"), F.lit("/page.html")).alias("base"), "page_id", F.col("html").alias("content"))
    # Addresses that differ in their fragment only have one path.
    pages = page.select(F.concat("base", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "content")
    docs = _table(spark, d, "documents").select(F.concat(F.lit("https://d.example/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".env")).alias("url"), F.col("text").alias("content"))
    where = shared_folder(spark)
    made = mirror.write(pages.unionByName(docs), f"{where}/files", f"{where}/manifest")
    read = folder.read(spark, f"{where}/files", hidden=True, gitignore=False, binary=True, partitions=16)
    return made.join(read.select(F.col("path").alias("file"), F.col("blob_id").alias("found_id"), F.col("size").alias("found_size")), "file", "full").select(
        "url", "blob_id", "size", (F.col("blob_id") == F.col("found_id")).alias("same"), (F.col("size") == F.col("found_size")).alias("same_size")
    )


def store_filtered(spark, d):
    """Three runs of blobs into a store, each looked up by its filters: what is new each time."""
    store = Store(spark, shared_folder(spark))
    docs = _table(spark, d, "documents").filter("text is not null").select("doc_id", ids.blob_id(F.col("text")).alias("blob_id"), F.octet_length("text").cast("long").alias("size"))
    told: DataFrame | None = None
    for k, part in enumerate(("doc_id % 2 = 0", "doc_id % 3 = 0", "true")):
        new = store.unseen(docs.filter(part)).dropDuplicates(["blob_id"]).select("blob_id", "size")
        count = spark.createDataFrame([(k, new.count())], "run int, n_new long")
        told = count if told is None else told.unionByName(count)
        store.add("blobs", new)
    return told.unionByName(store.table("blobs").agg(F.lit(-1).alias("run"), F.count("*").alias("n_new")))


def pages_scripts(spark, d):
    """Scripts planted into the pages' own HTML: endpoints and cloud addresses found in the whole of it."""
    k = F.col("page_id").cast("string")
    script = F.concat(F.lit("<script>fetch(\"/api/v2/items/"), k, F.lit("\"); const u = 'https://bucket-"), k, F.lit(".s3.amazonaws.com/a.txt';</script>"))
    page = _table(spark, d, "pages").select("page_id", F.concat("html", script).alias("text"))
    found = jsintel.endpoints(page, ["page_id"]).unionByName(jsintel.cloud_urls(page, ["page_id"]))
    return found.filter("value like '/api/v2/items/%' or value like '%bucket-%'").select("page_id", "category", "value")


def review_resume(spark, d):
    """A review of all documents that stops after some of its chunks and goes on: what is pending then, and each file's state in the end."""
    store = Store(spark, shared_folder(spark))
    made = reviews.named(chunks.review_chunks(_table(spark, d, "documents").select("doc_id", "text"), most=3000), "doc_id").select("doc_id", "chunk", "chunk_id")
    made = stored(made)
    answer = lambda rows: rows.select("chunk_id", F.concat(F.lit("chunk "), F.col("chunk").cast("string")).alias("answer"), F.lit(False).alias("failed"))
    reviews.record(store, answer(made.filter("doc_id % 3 = 0")))
    half = reviews.manifest(store, made, "doc_id").select("doc_id", F.col("status").alias("before"))
    reviews.record(store, answer(reviews.pending(store, made)))
    return reviews.manifest(store, made, "doc_id").join(half, "doc_id").select("doc_id", "n_chunks", "n_done", "before", "status")


QUERIES = {
    "match_foreign": match_foreign, "match_samples": match_samples, "suppressed_planted": suppressed_planted, "paired_credentials": paired_credentials, "scope_suffix": scope_suffix,
    "mirror_folder": mirror_folder, "store_filtered": store_filtered, "pages_scripts": pages_scripts, "review_resume": review_resume,
}
