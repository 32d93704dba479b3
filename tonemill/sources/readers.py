"""Read labelled text. Every reader takes a fixed schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill import fixed_values as fixed
from tonemill.operators.sampling import union_slices

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("class_index", T.IntegerType()),
        T.StructField("review_title", T.StringType()),
        T.StructField("review_text", T.StringType()),
    ]
)
MODEL_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
# The same files as published, without a row number; ``sinks.number_rows`` adds one.
RAW_REVIEW_SCHEMA = T.StructType([f for f in REVIEW_SCHEMA if f.name != "row_id"])
RAW_MODEL_SCHEMA = T.StructType([f for f in MODEL_SCHEMA if f.name != "row_id"])

# Shared by reader and writer, so that blank text, missing values, padding, quotes, commas, line breaks and
# backslashes come back as they were.
CSV_OPTIONS = {
    "header": "true",
    "nullValue": fixed.CSV_NULL,
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = MODEL_SCHEMA, multi_line: bool = True) -> DataFrame:
    """CSV whose header names the columns of ``schema`` in their order; any other header fails the job.

    A file with quoted line breaks is one task, so large sets are written as many files. Files known to hold none can be
    cut into many tasks with ``multi_line=False``.
    """
    options = {**CSV_OPTIONS, "enforceSchema": "false", "multiLine": str(multi_line).lower()}
    return spark.read.schema(schema).options(**options).csv(path)


def read_split(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """A split in any file format. ``multi_line`` is for CSV, as in ``read_csv``."""
    if fmt == "csv":
        return read_csv(spark, path, schema, multi_line)
    return spark.read.schema(schema).format(fmt).load(path)


def load_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Named splits as one table with a ``split`` column; a filter on it prunes whole scans."""
    return union_slices([df.withColumn("split", F.lit(name)) for name, df in splits.items()])
