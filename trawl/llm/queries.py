"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import circulant, compression_quality, mixing, packing, prefix_trie, progressive_jpeg, quality_rules, shards, simhash, token_counts, toxicity, vector_codes, warc
from trawl.llm.shared import fresh, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules over every text of ``documents``."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in two halves, each appended as small shards in arrivals and compacted with what is there, and read back."""
    root = shared_folder(spark)
    documents = table(spark, sf_dir, "documents")
    arrival = fresh(documents.columns, "arrival")
    dealt = documents.withColumn(arrival, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]), F.lit(shards.ARRIVALS)))
    half = F.col(arrival) < shards.ARRIVALS // 2
    for arrived in (half, ~half):
        shards.append_all(dealt.filter(arrived), root, arrival)
        shards.compact(spark, root)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    return shards.read(spark, root).select("doc_id", "lang", "source", "n_chars", size, F.sha2("text", 256).alias("text_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all ``documents``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """A public tokenizer's file; looked up where it is read."""
    import public_tokenizers

    return public_tokenizers.path(name)


def correct_words() -> list[str]:
    """Words that are spelled as they should be: those of a public tokenizer's vocabulary."""
    return toxicity.vocabulary(tokenizer("word_bpe_49k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to target weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as a sharded WARC archive and read back."""
    folder = shared_folder(spark)
    found = warc.read(warc.write(table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as a progressive JPEG, read back."""
    return progressive_jpeg.features(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents`` from two compression dictionaries."""
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), lambda: tokenizer("word_bpe_49k.json"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` under a byte-level BPE vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), lambda: tokenizer("byte_bpe_50k.json"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), known=correct_words())


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings``."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``, rebuilt on their families' first turns."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` by circulant MinHash."""
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality_rules": op1, "op2_sharding": op2, "op3_simhash_near_dedup": op3, "op4_pareto_mix": op4, "op5_warc": op5, "op6_progressive_jpeg": op6, "op7_compression_quality": op7, "op8_best_fit_packing": op8, "op9_token_counts": op9, "op10_toxicity": op10, "op11_annular_codes": op11, "op12_conversation_trie": op12, "op13_circulant_minhash": op13}
