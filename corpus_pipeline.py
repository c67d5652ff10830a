"""A corpus pipeline: language ID, near-duplicate removal, decontamination, redaction of secrets, source mix.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet
and read again as the next one's docs, and goes once the next one is written (the last stays, as it is the result). All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontamination, jaccard_join, language_id, mixing, secret_scan
from skein.llm.common import drop_folder, shared_folder, shrink_heaps, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; null texts and texts without letters go, repeated rows
    stay. Columns of any names pass through."""
    shrink_heaps(spark)
    return language_id.confident(docs, language_id.train(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by word-shingle Jaccard of 0.8 or more."""
    shrink_heaps(spark)
    return jaccard_join.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are each kept or not."""
    shrink_heaps(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; n_chars, if there is such a column, follows the text where that
    changed. Null texts stay null; repeated rows stay."""
    shrink_heaps(spark)
    return secret_scan.redact(docs, secret_scan.learn(docs), chars="n_chars" if "n_chars" in docs.columns else None)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: copy and taken (its first words that belong to the mix) of each document taken.

    Ties are served in one order of source, place and copy; null texts have no words and are never taken; repeated rows
    are served each. Without documents the mix is empty.
    """
    shrink_heaps(spark)
    mix = mixing.mix(docs).where("taken > 0").select("doc_id", "text_hash", "size", "source_size", "target", "copy", "finish", "taken", "place")
    texts = docs.select("doc_id", "text", "lang", "source").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"])
    out = mix.join(texts.withColumnRenamed("doc_id", "_id"), mix["doc_id"].eqNullSafe(F.col("_id")) & (mix["text_hash"] == F.col("_hash")))
    out = out.select("doc_id", "text", "lang", "source", "size", "source_size", "target", "copy", "finish", "taken", "place")
    return out.repartitionByRange("finish", "source", "place").sortWithinPartitions("finish", "source", "place").drop("place")


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("source_mix", mixed),
]

#: SQL cannot express the learned stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents, each written to a folder of its own below spark.checkpoint.dir."""
    base, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{base}/{name}"
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:  # nothing reads it any more
            drop_folder(spark, before)
        before = out
    return docs
