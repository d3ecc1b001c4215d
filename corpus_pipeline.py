"""From raw documents to packed training sequences, in stages that each write a table.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, whatever they are called. Labels are read from ``sf_dir``. Null and empty texts are judged as empty ones, texts are
read whole, however long, and an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import compression_quality, mixing, packing, shingles, toxicity
from trawl.llm.queries import correct_words, table, tokenizer
from trawl.llm.shared import fresh, shared_folder, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely toxic than not."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), known=correct_words())
    score = fresh(docs.columns, "score")
    return toxicity.with_score(docs, model, score=score).filter(F.col(score) < 0.5).drop(score)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are at least as likely good as not."""
    model = compression_quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "score")
    return compression_quality.with_score(docs, model, score=score).filter(F.col(score) >= 0.5).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group, and one row of it.

    Near are texts whose five-word shingles have a Jaccard similarity of 0.8 or more; candidates come from the tries of
    SimHash fingerprints and from bands of minima. Rows are told by id and words, so an id that several texts have loses none of
    them that is near nothing. Rows without an id cannot be referred to and all stay.
    """
    node = fresh(docs.columns, "node")
    found = shingles.kept(docs).withColumnsRenamed({"doc_id": "_kept_id", "node": "_kept_node"})
    named = docs.filter("doc_id is not null").withColumn(node, shingles.node_of(F.col("text"))).alias("d")
    same = (F.col("d.doc_id") == F.col("k._kept_id")) & (F.col(f"d.{node}") == F.col("k._kept_node"))
    one = named.join(found.alias("k"), same, "left_semi").dropDuplicates(["doc_id", node]).drop(node)
    return one.unionByName(docs.filter("doc_id is null")).select([F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences."""
    return packing.pack(docs, lambda: tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

#: The classifiers and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
