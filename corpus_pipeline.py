"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import bpe, jaccard, quality, toxicity, winnow
from tonemill.llm.common import shared_dir, table
from tonemill.llm.common import stage as stage_table
from tonemill.llm.queries import token_digest, tokenizer_definition


def packed(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside what the operators read, so that no column of theirs meets one of the documents'."""
    return docs.select(F.struct("*").alias("_doc"), "doc_id", "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts.

    Null and empty texts are judged by their features, which are all zero; equal texts fare alike; ids do not matter. The
    table is written here, since texts only go through Python in small batches while one is.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return stage_table(quality.score_quality(packed(docs), model, ["_doc"]).where("predicted = 1").select("_doc.*"), "good")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier does not reject; null and empty texts stay; equal texts fare alike."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(packed(docs), model, ["_doc"]).where("predicted = 0").select("_doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id, null ids last.

    Rows are told apart by a stored row number, so of rows that repeat an id or have none one stays in each group, too.
    Documents without words are near duplicates of nothing: all stay.
    """
    numbered = stage_table(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("doc_id")), "numbered")
    numbered = numbered.withColumn("text", F.col("_doc")["text"])  # the text is written once
    classes = jaccard.jaccard_components(numbered)
    ids = numbered.select("doc_id", F.col("_doc")["doc_id"].alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", F.col("doc_id").alias("row")))
    kept = classes.join(ids, "doc_id").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("doc_id"))
    return numbered.join(kept, "doc_id", "left_semi").select("_doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts hold none, and equal texts fare alike."""
    found = winnow.find_contamination(packed(docs), table(spark, sf_dir, "benchmark"), ["_doc"])
    return found.where(~F.col("contaminated")).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its id, number of tokens, and digests of token ids and decoded text; null and empty texts have none.

    The digests are written here for the same reason as the table of ``keep_good``.
    """
    return stage_table(token_digest(bpe.encode_documents(docs, tokenizer_definition())), "tokens")


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", drop_contaminated),
    ("tokens", encode),
]

# Classifiers, components and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
