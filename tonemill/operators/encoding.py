"""Vocabulary, fixed-length encoding, and pooling of token vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill import fixed_values as fixed
from tonemill.functions import text as tx
from tonemill.session import scratch_dir


def build_vocab(df: DataFrame, size: int, column: str = "text") -> DataFrame:
    """The ``size`` most frequent tokens with their counts and ids, ties by token.

    Tokens are counted map-side first, so a token that makes up a third of the corpus costs each task
    one row. The number of tokens per count gives the smallest count that can be in the result; only tokens
    that reach it are put in order, and only the ``size`` rows of the result are numbered in one place.
    """
    counted = df.select(F.explode(tx.tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    more_frequent = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))) - F.col("tokens")
    per_count = counted.groupBy("n").agg(F.count("*").alias("tokens")).withColumn("above", more_frequent)
    least = per_count.where(F.col("above") < size).agg(F.min("n").alias("n")).scalar()
    by_rank = [F.desc("n"), F.asc("token")]
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by_rank))
    return counted.where(F.col("n") >= least).orderBy(*by_rank).limit(size).select(
        "token", "n", (number + (fixed.FIRST_TOKEN_ID - 1)).cast("int").alias("id")
    )


def encode_text(df: DataFrame, vocab: DataFrame, max_length: int, column: str = "text") -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``token_type_ids``, each ``max_length`` long.

    Tokens beyond ``max_length - 2`` are cut, then the start and end markers are added and the rest is
    padding. Unknown tokens share one id, and a null text gives null arrays. Ids of rows are not read, so they may be
    missing or repeated.

    Texts are dictionary-coded first: a chunk of rows numbers its distinct tokens once and holds its texts as those
    numbers. Only the dictionaries meet the vocabulary, one row for each token of a chunk, however often it occurs;
    frequent tokens skew that join no more than there are chunks. The vocabulary may have any size.
    """
    if max_length < 2:
        raise ValueError("max_length must leave room for the two markers")
    spark = df.sparkSession
    kept = F.slice(tx.tokens(F.col(column)), 1, max(max_length - 2, 1)) if max_length > 2 else F.array().cast("array<string>")
    # Tokens are words, so a blank keeps them apart; a null text must stay null.
    words = F.when(F.col(column).isNotNull(), F.array_join(kept, " "))
    path = f"{scratch_dir(spark)}/coded-{uuid.uuid4().hex}"
    ready = df.select("*", F.monotonically_increasing_id().alias("__chunk"), words.alias("__words"))
    coded_schema = T.StructType([*df.schema.fields, *_CODED.fields])
    ready.mapInArrow(_number_tokens(coded_schema.names), coded_schema).write.parquet(path)
    coded = spark.read.schema(coded_schema).parquet(path)

    tokens = coded.where(F.col("__tokens").isNotNull()).select("__chunk", F.posexplode("__tokens").alias("__no", "token"))
    known = vocab.select("token", F.col("id").cast("int").alias("__id"))
    found = tokens.join(known, "token", "left").select("__chunk", F.struct("__no", F.coalesce("__id", F.lit(fixed.UNK_ID)).alias("id")).alias("__pair"))
    ids = found.groupBy("__chunk").agg(F.transform(F.array_sort(F.collect_list("__pair")), lambda p: p["id"]).alias("__id_of"))
    joined = coded.join(ids.withColumnRenamed("__chunk", "__of"), F.col("__chunk") == F.col("__of"), "left")
    translated = joined.withColumn("__ids", F.transform("__codes", lambda c: F.get("__id_of", c)))
    return _pad(translated.drop("__of", "__id_of", "__chunk", "__tokens", "__codes"), max_length)


# Rows whose tokens share a dictionary.
CHUNK_ROWS = 2000
_CODED = T.StructType(
    [
        T.StructField("__chunk", T.LongType()),
        T.StructField("__codes", T.ArrayType(T.IntegerType())),
        T.StructField("__tokens", T.ArrayType(T.StringType())),
    ]
)


def _number_tokens(names: list[str]):
    """Rows with their tokens as numbers of the chunk's dictionary, which comes with the chunk's first row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                numbers: dict[str, int] = {}
                codes = [
                    None if text is None else [numbers.setdefault(t, len(numbers)) for t in text.split(" ") if t]
                    for text in part.column("__words").to_pylist()
                ]
                chunk = [part.column("__chunk")[0].as_py()] * part.num_rows
                tokens = [list(numbers), *[None] * (part.num_rows - 1)]
                columns = [part.column(n) for n in names[:-3]]
                columns += [pa.array(chunk, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return code


def _pad(coded: DataFrame, max_length: int) -> DataFrame:
    n = F.size("__ids") + 2
    gap = F.lit(max_length) - n

    def fill(value: int, times: Column | int) -> Column:
        return F.array_repeat(F.lit(value), times)

    return coded.withColumns(
        {
            "input_ids": F.concat(F.array(F.lit(fixed.CLS_ID)), "__ids", F.array(F.lit(fixed.SEP_ID)), fill(fixed.PAD_ID, gap)),
            "attention_mask": F.concat(fill(1, n), fill(0, gap)),
            "token_type_ids": fill(0, max_length),
        }
    ).drop("__ids")


def max_pool(tokens: DataFrame, dims: int) -> DataFrame:
    """Largest value per dimension over the unmasked tokens of a row; a row without any gets the masked value.

    Vectors are maximised as vectors, whatever their width: within each batch first, so that a row leaves a task as one
    vector or few, and then over the rows of a partition as they come in order. A row of very many tokens is never
    gathered. A NaN is the largest value.
    """
    ready = tokens.select("row_id", (F.coalesce("mask", F.lit(0)) == 1).alias("here"), F.col("vec").cast("array<float>").alias("vec"))
    schema = T.StructType([tokens.schema["row_id"], T.StructField("vec", T.ArrayType(T.FloatType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("row_id").dictionary_encode(null_encoding="encode")
                order = np.argsort(ids.indices.to_numpy(zero_copy_only=False), kind="stable")
                values = np.full((batch.num_rows, dims), fixed.MASKED_VALUE, np.float32)
                here = batch.column("here").to_numpy(zero_copy_only=False)
                shown = batch.column("vec").filter(batch.column("here"))
                values[here] = shown.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                starts = np.searchsorted(ids.indices.to_numpy(zero_copy_only=False)[order], np.arange(len(ids.dictionary)))
                yield _vector_rows(ids.dictionary, np.maximum.reduceat(values[order], starts))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("row_id").to_pylist()
            values = batch.column("vec").flatten().to_numpy().reshape(-1, dims)
            starts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]]
            tops = np.maximum.reduceat(values, starts)
            keys = [ids[i] for i in starts]
            if last is not None and keys[0] == last_id:
                tops[0] = np.maximum(tops[0], last)
            elif last is not None:
                yield _vector_rows(pa.array([last_id], batch.schema.field("row_id").type), last[None, :])
            last_id, last = keys[-1], tops[-1].copy()
            yield _vector_rows(pa.array(keys[:-1], batch.schema.field("row_id").type), tops[:-1])
            id_type = batch.schema.field("row_id").type
        if last is not None:
            yield _vector_rows(pa.array([last_id], id_type), last[None, :])

    return ready.mapInArrow(partial, schema).repartition("row_id").sortWithinPartitions("row_id").mapInArrow(final, schema)


def _vector_rows(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(values, np.float32).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
    return pa.RecordBatch.from_arrays([ids, vectors], ["row_id", "vec"])


def first_pool(tokens: DataFrame) -> DataFrame:
    """Vector of the first token."""
    return tokens.where(F.col("pos") == 0).select("row_id", "vec")
