"""Profile a labelled text table. Each function is one aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions import text as tx


def head(df: DataFrame, n: int, by: str = "row_id") -> DataFrame:
    """First ``n`` rows by ``by`` (a top-n, not a full sort)."""
    return df.orderBy(by).limit(n)


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"))


def _one_row_per_column(df: DataFrame, aggregates: dict[str, list[Column]], fields: list[str]) -> DataFrame:
    """Aggregate every column in a single pass, then turn the one result row into rows."""
    wide = df.agg(
        *[
            F.struct(F.lit(name).alias("column"), *[v.alias(f) for v, f in zip(values, fields)]).alias(f"c{i}")
            for i, (name, values) in enumerate(aggregates.items())
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column."""
    return _one_row_per_column(df, {c: [F.count_if(F.col(c).isNull())] for c in df.columns}, ["nulls"])


def column_info(df: DataFrame) -> DataFrame:
    """Column name, non-null count and type."""
    return _one_row_per_column(df, {c: [F.count(c), F.lit(t)] for c, t in df.dtypes}, ["non_null", "dtype"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of the non-null rows per value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # The total comes from a one-row aggregate, so a column with many values is never put in one window.
    total = counted.agg(F.sum("n").alias("total")).scalar()
    return counted.select("value", (F.col("n").cast("double") / total.cast("double")).alias("share"))


def class_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values; null counts as one value."""
    c = F.col(column)
    values = df.groupBy(c.alias("value")).agg(F.lit(1).alias("seen"))
    return values.agg(F.count("*").alias("classes"))


def max_words(df: DataFrame, column: str = "text") -> DataFrame:
    """Word count of the longest text."""
    return df.agg(F.max(tx.word_count(F.col(column)).cast("bigint")).alias("max_words"))
