"""The registered queries over the driver's tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawl.functions import ids, text, urls
from trawl.functions.ranks import numbered
from trawl.operators import aesflow, asseturls, chunks, detect, findings, jsintel, redact, report, rules, scan, suppress, triage, webassets
from trawl.plans.store import Store, contents, keep_contents, shared_folder
from trawl.plans import store as stores
from trawl.sources import blobs as sources
from trawl.sources import extract
from trawl.streaming import scan as streaming

BY_ID = {r.id: r for r in rules.BUILTIN}
#: Rules with hits in the driver's documents.
PACK = [BY_ID[k] for k in ("tr.token.1", "tr.email.1", "tr.ipv4.1", "tr.card.1", "tr.licence.1")]
CONTEXT = 2
#: Tables of whole texts, which cost more to read than to move.
WIDE = ("documents", "pages")
SELECTION = {"rule": ["E-mail address", "IPv4 address"], "validation": ["valid", "-"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer pieces than the cluster has cores (small files of one row group) is dealt out anew."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in WIDE and found.rdd.getNumPartitions() < cores else found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", ids.blob_id(F.col("text")).alias("blob_id"))


def found(spark: SparkSession, sf_dir: str, pack: list | None = None) -> DataFrame:
    """Matches of the pack in all documents, with ids."""
    return detect.with_ids(detect.with_columns(documents(spark, sf_dir), pack or PACK))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    joined = found(spark, sf_dir).join(labels, "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), F.lit(None).cast("string")).when(F.col("toxic") == 1, "invalid").when(F.col("quality") == 1, "valid").otherwise("undetermined")
    return joined.withColumn("status", kind).withColumn("confidence", F.when(F.col("status") == "undetermined", 0.5).when(F.col("status").isNotNull(), 1.0))


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with rule name, categories and validation status."""
    rolled = findings.roll_up(validated(spark, sf_dir), ["finding_id", "rule_id", "rule_name"])
    pack = rules.frame(spark, PACK).select(F.col("id").alias("rule_id"), "categories")
    return rolled.join(pack, "rule_id")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each page, made of its url, as the tables hold none that call anything."""
    k, u = F.col("page_id").cast("string"), F.col("url")
    lines = [
        F.concat(F.lit("import a from 'Pkg-"), F.expr("page_id % 7").cast("string"), F.lit("/sub';")),
        F.concat(F.lit('fetch("'), u, F.lit('"); axios.Post( `/api/v1/é/'), k, F.lit("` )")),
        F.concat(F.lit("const x = require('@Scope/lib-"), F.expr("page_id % 5").cast("string"), F.lit("'); cfg = {endpoint: '/rest/"), k, F.lit("', url: 'data:x/y'}")),
        F.concat(F.lit("// é https://bucket-"), k, F.lit(".s3.amazonaws.com/key/"), k, F.lit(".txt, and node_modules/left-pad/index.js")),
        F.concat(F.lit("apiKey = 'k3y"), F.substring(F.md5(u.cast("binary")), 1, 12), F.lit("'; //# sourceMappingURL=app."), k, F.lit(".js.map")),
    ]
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat_ws("\n", *lines).alias("text"))


def blob_ids(spark, d):
    return documents(spark, d).select("doc_id", "blob_id", F.octet_length("text").cast("long").alias("size"))


def binary_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_binary(F.col("text")).alias("is_binary"))


def match_rules(spark, d):
    return found(spark, d).select("doc_id", "blob_id", "rule_id", "start", "end", "start_line", "start_column", "end_line", "end_column", "matching", F.get("groups", 0).alias("secret"))


def match_one(rule_id: str):
    def query(spark, d):
        return detect.with_columns(documents(spark, d), [BY_ID[rule_id]]).select("doc_id", "start", "end", "start_line", "start_column", "matching", F.get("groups", 0).alias("secret"))

    return query


def match_context(spark, d):
    return detect.with_columns(documents(spark, d).select("doc_id", "text"), PACK[:3], context=CONTEXT).select("doc_id", "rule_id", "start", "before", "after")


def dedup_content(spark, d):
    return detect.first_by_content(found(spark, d), ties=["doc_id"]).select("doc_id", "blob_id", "rule_id", "start", F.get("groups", 0).alias("secret"))


def dedup_location(spark, d):
    return detect.first_by_place(found(spark, d)).select("structural_id", "rule_id", "blob_id", "start", "end")


def match_ids(spark, d):
    return found(spark, d).select("doc_id", "rule_id", "start", "structural_id", "finding_id")


def findings_group(spark, d):
    return findings.findings(detect.first_by_place(found(spark, d))).select("finding_id", "rule_id", "rule_name", F.get("groups", 0).alias("secret"), "n_matches", "n_blobs")


def findings_top3(spark, d):
    return findings.first_matches(detect.first_by_place(found(spark, d))).select("finding_id", "rank", "structural_id", "blob_id", "start")


def summary_by_rule(spark, d):
    return findings.summary(detect.first_by_place(found(spark, d)))


def stats_bytes(spark, d):
    return documents(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("blob_id").alias("n_blobs"), F.sum(F.octet_length("text")).alias("n_bytes"))


def entropy_filter(spark, d):
    rows = found(spark, d, PACK[:1]).select("doc_id", "start", F.get("groups", 0).alias("secret"))
    return rows.select("doc_id", "start", F.round(text.entropy(F.col("secret")), 6).alias("entropy"), suppress.is_opaque(F.col("secret")).alias("opaque"))


def mask_values(spark, d):
    return found(spark, d).select("doc_id", "rule_id", "start", text.mask(F.get("groups", 0)).alias("masked"))


def suppress_prompts(spark, d):
    """Every turn of every conversation, whole, as a candidate for a password."""
    return table(spark, d, "conversations").select("conv_id", "turn", suppress.is_password_prompt(F.coalesce("text", F.lit(""))).alias("prompt"))


def _matches_of(spark, d, chosen):
    """How many matches each of the chosen rules (id, others) has in all documents; rules without any have none."""
    rows = detect.with_python(documents(spark, d).select("doc_id", "text"), rules.BUILTIN)
    counts = rows.groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return chosen.join(counts, "id", "left").withColumn("n_matches", F.coalesce("n", F.lit(0))).drop("n")


def rule_include_exclude(spark, d):
    """Rules chosen by their ids, with their matches in the documents."""
    chosen = rules.select(rules.frame(spark, rules.BUILTIN), "http, ^tr\\.(aws|card)", "query").select("id", "name", "structural_id", ids.rule_structural_id(F.col("pattern")).alias("computed_id"))
    return _matches_of(spark, d, chosen)


def ruleset_semi(spark, d):
    """The rules of a ruleset, with their matches in the documents."""
    sets = spark.createDataFrame([(r.id, list(r.rule_ids)) for r in rules.RULESETS], "id string, rule_ids array<string>")
    return _matches_of(spark, d, rules.of_ruleset(rules.frame(spark, rules.BUILTIN), sets, "identifiers").select("id", "name"))


def incremental_anti(spark, d):
    docs = documents(spark, d)
    seen = table(spark, d, "labels").join(docs, "doc_id").select("blob_id").distinct()
    return findings.unseen(docs, seen).select("doc_id", "blob_id")


def combined_sources(spark, d):
    parts = (
        sources.from_table(table(spark, d, "documents"), "text", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))),
        sources.from_table(table(spark, d, "conversations"), "text", F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))),
        sources.from_table(table(spark, d, "pages"), "html", F.col("url")),
        sources.from_table(table(spark, d, "benchmark"), "text", F.concat(F.lit("item/"), F.col("item_id").cast("string"))),
    )
    return findings.combined(*parts).select("blob_id", "path", F.octet_length("text").cast("long").alias("size"))


def facet_counts(spark, d):
    return findings.facets(finding_rows(spark, d))


def facet_filtered(spark, d):
    return findings.facets_under(finding_rows(spark, d), SELECTION)


def validation_rollup(spark, d):
    return findings.roll_up(validated(spark, d), ["finding_id"])


def provenance_first(spark, d):
    docs = documents(spark, d)
    prov = docs.select("blob_id", F.col("doc_id").alias("prov_id"), F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return findings.first_provenance(detect.first_by_place(found(spark, d)), prov).select("structural_id", "rule_id", "path")


def annotate_upsert(spark, d):
    labels = table(spark, d, "labels")
    old = labels.select(F.lit("finding").alias("target_type"), F.col("doc_id").cast("string").alias("target_id"), F.lit("accept").alias("status"), F.lit("first").alias("comment"), F.col("doc_id").alias("at"))
    new = labels.filter("quality = 0 or toxic = 1").select("doc_id", F.lit("finding").alias("target_type"), F.lit("reject").alias("status"), F.lit("second").alias("comment"))
    new = new.select("target_type", F.col("doc_id").cast("string").alias("target_id"), "status", "comment", (F.col("doc_id") + 1000000).alias("at"))
    return findings.annotate(old, new)


def js_query(extract: Callable):
    return lambda spark, d: extract(scripts(spark, d), ["page_id"])


def query_redact(spark, d):
    full = F.concat("url", F.when(F.instr("url", "?") > 0, F.lit("&")).otherwise(F.lit("?")), F.lit("api_token=abc"), F.col("page_id").cast("string"), F.lit("&x=1&Session="))
    return table(spark, d, "pages").select("page_id", text.redact_query(full).alias("redacted"))


def html_assets(spark, d):
    page = table(spark, d, "pages")
    tag = F.concat(F.lit("<link rel=stylesheet href='/s/"), F.col("page_id").cast("string"), F.lit(".css'><script src='../a.js?v=1'></script><script>load('/c/chunk.js')</script>"))
    return webassets.assets(page.select("page_id", "url", F.concat("html", tag).alias("html"))).select("page_id", "position", "asset")


def scope_filter(spark, d):
    page = table(spark, d, "pages")
    target = F.lit("https://www.example.com/start")
    return page.select("page_id", urls.in_scope(F.col("url"), target, "rdn").alias("rdn"), urls.in_scope(F.col("url"), target, "fqdn").alias("fqdn"), urls.in_scope(F.col("url"), target, "origin").alias("origin"))


def mirror_path(spark, d):
    return table(spark, d, "pages").select("page_id", urls.mirror_path(F.col("url")).alias("path"))


def repo_parse(spark, d):
    """References to repositories made of each document's source and id, in the ways that people write them."""
    owner, name = F.col("source"), F.concat(F.lit("r"), F.col("doc_id").cast("string"))
    ways = [
        F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")), F.concat(F.lit("git@github.com:"), owner, F.lit("/"), name, F.lit(".git")),
        F.concat(F.lit("https://gitlab.com/"), owner, F.lit("/sub/"), name, F.lit("/-/tree/main")), F.concat(F.lit("https://github.com/"), owner),
        F.concat(F.lit("https://example.com/"), owner, F.lit("/"), name), F.concat(F.lit("gitlab.com/"), owner, F.lit("/"), name, F.lit("/")),
    ]
    rows = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*ways), (F.col("doc_id") % 6 + 1).cast("int")).alias("reference"))
    return rows.withColumn("r", urls.repository(F.col("reference"))).select("doc_id", "reference", "r.platform", "r.owner", "r.repo", "r.full_path")


def size_parse(spark, d):
    page = table(spark, d, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, ("", "B", "KB", " mb", "GB", "TB"))), (F.col("page_id") % 6 + 1).cast("int"))).alias("size"))
    return page.select("page_id", "size", text.size_in_bytes(F.col("size")).alias("bytes"))


def redact_content(spark, d):
    return table(spark, d, "documents").select("doc_id", redact.redacted(F.col("text")).alias("redacted"))


def redact_hosts(spark, d):
    return redact.hosts(table(spark, d, "documents"), "doc_id", [])


def chunk_lines(spark, d):
    """Whole lines in chunks that begin every 1000 bytes; a line belongs to the chunk in which it begins."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "part")).withColumn("bytes", F.octet_length("part").cast("long") + 1)
    at = F.sum("bytes").over(Window.partitionBy("doc_id").orderBy("line")) - F.col("bytes")
    cut = lines.withColumn("chunk", F.floor(at / 1000))
    return cut.groupBy("doc_id", "chunk").agg((F.min("line") + 1).cast("long").alias("first_line"), (F.max("line") + 1).cast("long").alias("last_line"), F.sum("bytes").alias("bytes"))


def sarif_json(spark, d):
    rows = detect.first_by_place(found(spark, d), ties=["doc_id"])
    return report.sarif_results(rows, F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("blob_id")))


def report_json(spark, d):
    return report.findings_json(detect.first_by_place(found(spark, d)))


def ai_corpus_filter(spark, d):
    page = table(spark, d, "pages")
    named = F.concat(F.substring_index(F.substring_index("url", "#", 1), "?", 1), F.element_at(F.array(*map(F.lit, (".js", ".png", ".TSX?x=1", "", ".json"))), (F.col("page_id") % 5 + 1).cast("int")))
    return page.select("page_id", named.alias("path")).filter(redact.reviewed(F.col("path")))


def match_python(spark, d):
    """The whole pack with the plan for many rules."""
    rows = detect.with_python(documents(spark, d).select("doc_id", "blob_id", "text"), rules.BUILTIN)
    return rows.select("doc_id", "rule_id", "start", "end", "start_line", "start_column", "end_line", "end_column", "matching")


def stream_detect(spark, d):
    """The documents as a stream of files, scanned in micro-batches into a table."""
    schema = table(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*").select(ids.blob_id(F.col("text")).alias("blob_id"), "text")
    folder = shared_folder(spark)
    query = streaming.matches(stream, rules.BUILTIN).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("blob_id", "rule_id", "start", "end", "matching", "structural_id")


def extract_members(spark, d):
    """Pages as cells of notebooks, taken out again."""
    cell = F.struct(F.lit("code").alias("cell_type"), F.array("html").alias("source"))
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".ipynb"))
    book = table(spark, d, "pages").select(name.alias("path"), F.to_json(F.struct(F.array(cell).alias("cells"))).cast("binary").alias("content"))
    return extract.extract(book).select("path", "member", F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("size"))


def password_flow(spark, d):
    """Wrapper functions that encrypt passwords, and where they are called, in scripts made of the pages' ids."""
    k = F.col("page_id").cast("string")
    body = F.concat(F.lit("var key = '0123456789abcdef'; function enc"), k, F.lit("(p) {}\nuser.token = enc"), k, F.lit("(form.name); body.password = enc"), k, F.lit("(form.password);"))
    page = table(spark, d, "pages").select(k.alias("blob_id"), body.alias("text"), F.concat(F.lit("enc"), k).alias("encryptor"))
    start = (F.instr("text", "function") - 1).cast("long")
    found = aesflow.expand(page.select("blob_id", "text", start.alias("start"), "encryptor", F.lit("key").alias("key_source"), F.lit(None).cast("string").alias("static_key")))
    return found.select("blob_id", "start", "end", "encryptor", "argument", "is_literal", "aes_key")


#: Rules whose groups have names, and one that stands on lines of its own.
NAMED = rules.Rule("tr.address.1", "Address", r"\b(?P<user>[A-Za-z0-9._%+-]+)@(?P<host>[A-Za-z0-9.-]+\.[A-Za-z]{2,24})\b")
ANCHORED = rules.Rule("tr.line.1", "Licence line alone", r"^((?:Licensed|Released) under [^\n]*)$")
#: Overlapping chunks of a scan, small enough for the driver's texts to have several.
SMALL, SHARED = 4096, 3


def scanned(spark, d):
    """The whole way over all documents."""
    return scan.scan(documents(spark, d).select("blob_id", "text"), rules.BUILTIN)


def scan_full(spark, d):
    return scanned(spark, d).select("blob_id", "rule_id", "start", "end", "start_line", F.get("groups", 0).alias("secret"), "structural_id", "finding_id")


def suppressed(spark, d):
    """Matches that stay, before anything is dropped as a copy."""
    rows = detect.with_python(documents(spark, d).select("doc_id", "text"), rules.BUILTIN, context=CONTEXT)
    return suppress.unsuppressed(rows).select("doc_id", "rule_id", "start", "end")


def named_groups(spark, d):
    rows = detect.with_python(documents(spark, d).select("doc_id", "text"), [NAMED])
    return rows.select("doc_id", "start", F.col("named")["user"].alias("user"), F.col("named")["host"].alias("host"), F.size("groups").alias("n_groups"))


def match_anchored(spark, d):
    """Anchors stand for the ends of lines in either plan."""
    docs = documents(spark, d).select("doc_id", "text")
    both = [plan(docs, [ANCHORED]).select("doc_id", "start", "end", F.lit(name).alias("plan")) for name, plan in (("columns", detect.with_columns), ("python", detect.with_python))]
    return both[0].unionByName(both[1])


def match_pack(spark, d):
    """All documents by all rules with one group: about three hundred."""
    rows = detect.with_python(documents(spark, d).select("doc_id", "text"), [r for r in rules.pack() if len(r.names) == 1])
    return rows.select("doc_id", "rule_id", "start", "end", F.get("groups", 0).alias("secret"))


def scan_chunked(spark, d):
    """Found in overlapping chunks, told as places in the document."""
    found_ = chunks.scan(documents(spark, d).select("blob_id", "text"), PACK, size=SMALL, overlap=SHARED)
    return found_.select("structural_id", "rule_id", "blob_id", "start", "end", "start_line", "end_line")


def rule_stats(spark, d):
    """What a scan in chunks measured of each rule; rules that matched nowhere are left to ``rule_effort``."""
    pieces = chunks.with_overlap(documents(spark, d).select("blob_id", "text").dropDuplicates(["blob_id"]), size=SMALL, overlap=0)
    return triage.merged_stats(chunks.rule_stats(pieces, PACK)).filter("n_matches > 0").select("rule_id", "state", "n_matches")


def rule_effort(spark, d):
    """On how many documents each rule was tried, and what it found."""
    stats = chunks.rule_stats(documents(spark, d).select("doc_id", "text"), PACK)
    return stats.filter("seconds >= 0").select("rule_id", "state", "n_tried", "n_matches")


def _half(spark, d):
    """Findings of all documents, and matches in the odd ones only; a third of those with ids of another kind."""
    rows = stores.stored(detect.first_by_place(found(spark, d), ["doc_id"]).drop("text"))
    whole = rows.groupBy("finding_id", "rule_id", "groups").agg(F.min("rule_name").alias("rule_name"))
    own = rows.filter("doc_id % 2 = 1").withColumn("finding_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old-"), "finding_id")).otherwise(F.col("finding_id")))
    return whole, own


def report_rows(spark, d):
    return triage.report_rows(*_half(spark, d)).select("finding_id", "rule_id", F.get("groups", 0).alias("secret"), "by", "structural_id", "start")


def provenance_all(spark, d):
    docs = documents(spark, d)
    prov = docs.select("blob_id", F.col("doc_id").alias("prov_id"), F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return triage.all_provenance(detect.first_by_place(found(spark, d)), prov).select("structural_id", "path", "place")


def _overview(spark, d):
    labels = table(spark, d, "labels")
    rows = stores.stored(detect.first_by_place(validated(spark, d), ["doc_id"]))  # read four times
    notes = rows.filter("doc_id % 2 = 0").select("finding_id").distinct()
    notes = notes.select(F.lit("finding").alias("target_type"), F.col("finding_id").alias("target_id"), F.lit("accept").alias("status"), F.lit("seen").alias("comment"))
    prov = documents(spark, d).select("blob_id", F.col("doc_id").alias("prov_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return triage.overview(rows, rules.frame(spark, PACK), notes, prov)


def annotations_join(spark, d):
    return _overview(spark, d).select("finding_id", "n_matches", "n_blobs", "status", F.round("confidence", 6).alias("confidence"), "annotation", "path")


def findings_sorted(spark, d):
    """The places of findings in the order by number of matches, greatest first."""
    rows = _overview(spark, d).select("finding_id", "rule_name", "n_matches", (-F.col("n_matches")).alias("_order"))
    return numbered(rows, ["_order", "rule_name", "finding_id"], "place").select("finding_id", "n_matches", "place")


def scan_counters(spark, d):
    return triage.counters(table(spark, d, "documents"), F.octet_length("text"), text.is_binary(F.col("text")), 20_000)


def look_back(spark, d):
    """Errors as encryption, clicks and views as parsed values: the latest of eight before that has a key's size."""
    value = F.when(F.col("event_id") % 3 == 0, F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 16)).otherwise(F.concat("event_type", F.lit("!")))
    events = table(spark, d, "events").withColumn("said", value)
    rows = triage.looked_back(events, ["ts", "event_id"], F.col("event_type").isin("click", "view"), F.col("said"), F.col("event_type") == "error", ("user_id",))
    return rows.select("event_id", "user_id", "candidate")


def capture_filter(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("text/html", "image/png", "application/JSON", "font/woff", "text/css"))), (F.col("page_id") % 5 + 1).cast("int"))
    how = F.element_at(F.array(*map(F.lit, ("Document", "image", "xhr", "font"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", triage.captured((F.col("page_id") % 7 * 50 + 150).cast("int"), kind, how).alias("captured"))


def resolvable_urls(spark, d):
    page = table(spark, d, "pages")
    return triage.resolvable(page.select("page_id", "url"), page.filter("page_id % 2 = 0").select(urls.hostname(F.col("url")).alias("host")))


def blob_store(spark, d):
    """Contents kept by id, and those of pages read back."""
    folder = shared_folder(spark)
    docs = documents(spark, d).select("blob_id", F.col("text").alias("content"))
    page = table(spark, d, "pages").select(ids.blob_id(F.col("html")).alias("blob_id"), F.col("html").alias("content"))
    keep_contents(docs.unionByName(page), folder)
    kept = contents(spark, folder, page)
    return kept.select("blob_id", F.octet_length("content").cast("long").alias("size"), (ids.blob_id(F.col("content")) == F.col("blob_id")).alias("same"))


def store_scan(spark, d):
    """Two incremental runs into a store; the second one overlaps the first."""
    store = Store(spark, shared_folder(spark))
    docs = documents(spark, d).select("doc_id", "blob_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    for part in (docs.filter("doc_id % 3 < 2"), docs.filter("doc_id % 3 > 0")):
        stores.scan(store, part.drop("doc_id"), PACK)
    return store.table("matches").select("structural_id", "rule_id", "start").unionByName(store.table("blobs").select(F.col("blob_id").alias("structural_id"), F.lit("blob").alias("rule_id"), F.col("size").alias("start")))


def insights(spark, d):
    """What a review says, with the turns of conversations as lines of reviews that speak of tokens."""
    marks = F.element_at(F.array(*map(F.lit, ("- the api key is ", "plain ", "3. No secret: ", "| token | "))), (F.col("turn") % 4 + 1).cast("int"))
    body = F.concat(marks, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), marks)))
    return chunks.insights(table(spark, d, "conversations").select("conv_id", "turn", body.alias("text")), ["conv_id", "turn"])


def link_header(spark, d):
    header = F.concat(F.lit("<"), "url", F.lit('>; rel="preload, x"; as=script, </s/'), F.col("page_id").cast("string"), F.lit(".js>;rel=modulepreload,  <"), "url", F.lit(">"))
    return table(spark, d, "pages").select("page_id", F.posexplode(asseturls.header_links(header)).alias("position", "target"))


def prepared_files(spark, d):
    page = table(spark, d, "pages")
    named = F.concat(F.regexp_replace("url", r"[?#].*\z", ""), F.element_at(F.array(*map(F.lit, (".js", ".png", ".json"))), (F.col("page_id") % 3 + 1).cast("int")))
    files = page.select(ids.blob_id(F.col("html")).alias("blob_id"), named.alias("path"), F.col("html").alias("text"))
    return chunks.prepared(files.unionByName(files)).select("blob_id", "path", "file_id")


def review_chunks(spark, d):
    """All documents in chunks of whole lines of at most 3000 bytes."""
    return chunks.review_chunks(documents(spark, d).select("doc_id", "text"), most=3000).select("doc_id", "chunk", "first_line", "last_line", F.octet_length("text").cast("long").alias("bytes"))


def redact_numbered(spark, d):
    return redact.numbered_text(table(spark, d, "documents").select("doc_id", "text"), "doc_id", []).select("doc_id", "redacted")


def asset_candidates(spark, d):
    page = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://h.example/app/web/"), F.when(F.col("page_id") % 2 == 0, F.lit("web/")).otherwise(F.lit("")), F.col("page_id").cast("string"), F.lit(".js")).alias("address"))
    return asseturls.candidate_rows(page, "https://h.example/app/web/index.html", "https://h.example/base/", "address").select("page_id", "place", "candidate")


def crawl_fixpoint(spark, d):
    """Pages that name scripts, which name manifests, which name the next page's script: the walk ends by itself."""
    k = F.col("page_id").cast("string")
    page = table(spark, d, "pages").select("page_id", k.alias("k"), (F.col("page_id") + 1).cast("string").alias("next"))
    at = lambda name, c: F.concat(F.lit(f"https://h.example/{name}"), c)
    html = page.select(at("p", F.col("k")).alias("url"), F.concat(F.lit("<script src='/s"), "k", F.lit(".js'></script>")).alias("html"))
    script = page.select(F.concat(at("s", F.col("k")), F.lit(".js")).alias("url"), F.concat(F.lit('load("m'), "k", F.lit('.json")')).alias("html"))
    manifest = page.select(F.concat(at("m", F.col("k")), F.lit(".json")).alias("url"), F.concat(F.lit('{"files": {"./t'), "k", F.lit('.js": ["/s'), "k", F.lit('.js"]}}')).alias("html"))
    return webassets.crawl(html.unionByName(script).unionByName(manifest), html.select("url"))


def js_analyze(spark, d):
    return jsintel.analyze(scripts(spark, d), ["page_id"])


def pages_query(extract: Callable):
    """An extractor over the pages as they are."""
    return lambda spark, d: extract(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), ["page_id"])


def sarif_rules(spark, d):
    """The rules as a SARIF log of the documents' matches describes them."""
    return _matches_of(spark, d, report.sarif_rules(rules.frame(spark, rules.BUILTIN)))


def report_rendered(spark, d):
    rows = detect.with_columns(documents(spark, d).select("doc_id", "blob_id", "text"), PACK, context=1)
    return report.rendered(detect.first_by_place(detect.with_ids(rows), ["doc_id"])).select("finding_id", "rank", "line")


def rfc3339(spark, d):
    """Times as text and back."""
    out = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", out.alias("written"), F.unix_micros(F.to_timestamp(out, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("read"))


QUERIES = {
    "match_rules": match_rules, "blob_ids": blob_ids, "binary_filter": binary_filter, "match_token_assign": match_one("tr.token.1"), "match_email": match_one("tr.email.1"),
    "match_ipv4": match_one("tr.ipv4.1"), "match_card": match_one("tr.card.1"), "match_license": match_one("tr.licence.1"), "match_python": match_python, "match_context": match_context,
    "dedup_content": dedup_content, "dedup_location": dedup_location, "match_ids": match_ids, "findings_group": findings_group, "findings_top3": findings_top3,
    "summary_by_rule": summary_by_rule, "stats_bytes": stats_bytes, "entropy_filter": entropy_filter, "mask_values": mask_values, "suppress_prompts": suppress_prompts,
    "rule_include_exclude": rule_include_exclude, "ruleset_semi": ruleset_semi, "incremental_anti": incremental_anti, "combined_sources": combined_sources, "facet_counts": facet_counts,
    "facet_filtered": facet_filtered, "validation_rollup": validation_rollup, "provenance_first": provenance_first, "annotate_upsert": annotate_upsert,
    "js_endpoints": js_query(jsintel.endpoints), "js_cloud_urls": js_query(jsintel.cloud_urls), "js_subdomains": js_query(jsintel.subdomains), "js_dependencies": js_query(jsintel.dependencies),
    "js_source_maps": js_query(jsintel.source_maps), "js_generic_secrets": js_query(jsintel.generic_secrets), "query_redact": query_redact, "html_assets": html_assets,
    "scope_filter": scope_filter, "mirror_path": mirror_path, "repo_parse": repo_parse, "size_parse": size_parse, "redact_content": redact_content, "redact_hosts": redact_hosts,
    "chunk_lines": chunk_lines, "sarif_json": sarif_json, "report_json": report_json, "ai_corpus_filter": ai_corpus_filter,
    "scan_full": scan_full, "suppressed": suppressed, "named_groups": named_groups, "match_anchored": match_anchored, "match_pack": match_pack, "scan_chunked": scan_chunked, "rule_stats": rule_stats, "rule_effort": rule_effort,
    "report_rows": report_rows, "provenance_all": provenance_all, "annotations_join": annotations_join, "findings_sorted": findings_sorted, "scan_counters": scan_counters, "look_back": look_back,
    "capture_filter": capture_filter, "resolvable_urls": resolvable_urls, "blob_store": blob_store, "store_scan": store_scan, "insights": insights, "link_header": link_header,
    "prepared_files": prepared_files, "review_chunks": review_chunks, "redact_numbered": redact_numbered, "asset_candidates": asset_candidates, "crawl_fixpoint": crawl_fixpoint, "js_analyze": js_analyze,
    "pages_endpoints": pages_query(jsintel.endpoints), "pages_cloud_urls": pages_query(jsintel.cloud_urls), "pages_subdomains": pages_query(jsintel.subdomains),
    "pages_dependencies": pages_query(jsintel.dependencies), "pages_source_maps": pages_query(jsintel.source_maps), "pages_generic_secrets": pages_query(jsintel.generic_secrets),
    "sarif_rules": sarif_rules, "report_rendered": report_rendered, "rfc3339": rfc3339,
    "stream_detect": stream_detect, "extract_members": extract_members, "password_flow": password_flow,
}

from trawl.plans import corpus  # noqa: E402  (reads tables as this module does)

QUERIES |= corpus.QUERIES
