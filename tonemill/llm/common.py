"""Helpers the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z to a-z and nothing else, for bytes.translate
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Labelled rows a classifier is fitted on: about this many, chosen by a hash of the id.
FIT_ROWS = 12_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session that names none (tests) takes one below its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/llm-shared").rstrip("/")


BATCH_ROWS = 1000  # rows of an Arrow batch while whole texts or arrays go through Python


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the job that wrote them: what later jobs read is staged or persisted."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stage(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % divisor


def in_remainder(col: str, divisor: int, remainder: int) -> Column:
    return F.coalesce(id_remainder(col, divisor) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int, rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, text, y)`` of about ``rows`` labelled documents outside the held-out remainder.

    Rows are chosen by a hash of the id, so the choice does not depend on order or partitions. A document with
    several labels takes the largest; rows with a null id or label take no part.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_remainder("doc_id", divisor) != held))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    total = usable.count()
    keep = min(1.0, rows / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(keep * (1 << 30)))
    # about `rows` rows of two numbers: bounded by the parameter, so they may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def count_frame(counts: dict) -> pd.DataFrame:
    """Counts of words as rows; the word column keeps its kind when there are none."""
    return pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})


KEY_BITS = 1 << 24


def key_bitmap(keys: DataFrame, column: str, bits: int = KEY_BITS) -> np.ndarray:
    """A bitmap of fixed size with a bit for every key (long), as 32-bit words.

    It only spares other keys a shuffle; a join must decide, since different keys may share a bit.
    """
    at = keys.select(F.pmod(column, F.lit(bits)).alias("bit"))
    mask = F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int))) AS mask")
    rows = at.groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(mask).toArrow()  # columns: row objects would fill the driver
    words = np.zeros(bits // 32, np.uint32)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy().astype(np.uint32)
    return words


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys have their bit set."""
    bit = keys.view(np.uint64) % np.uint64(32 * len(words))
    return (words[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
