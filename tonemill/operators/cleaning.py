"""Clean reviews and labels. Row-wise steps only: no shuffle, no Python worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions import labels as lb
from tonemill.functions import text as tx
from tonemill.functions import vectors as vx


def drop_null_reviews(df: DataFrame) -> DataFrame:
    """Keep reviews that have both a text and a class. Used for every split alike."""
    return df.na.drop(subset=["review_text", "class_index"])


def fill_titles(df: DataFrame) -> DataFrame:
    return df.na.fill({"review_title": ""})


def add_text(df: DataFrame) -> DataFrame:
    """Add ``text`` as title and review joined."""
    return df.withColumn("text", tx.title_and_text(F.col("review_title"), F.col("review_text")))


def add_clean_text(df: DataFrame) -> DataFrame:
    return df.withColumn("clean_text", tx.clean_text(F.col("text")))


def drop_raw_columns(df: DataFrame) -> DataFrame:
    return df.drop("review_title", "review_text", "text")


def rename_model_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"class_index": "label", "clean_text": "text"})


def cast_columns(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast columns; a value that does not fit fails the job, or is null with ``strict=False``."""
    if strict:
        # An explicit check, so that the result does not hang on the session's ANSI setting.
        def cast(name: str, kind: str):
            value = F.col(name)
            safe = value.try_cast(kind)
            bad = F.raise_error(F.concat(F.lit(f"cannot cast {name} to {kind}: "), value.cast("string")))
            return F.when(value.isNotNull() & safe.isNull(), bad.cast(kind)).otherwise(safe)
    else:
        def cast(name: str, kind: str):
            return F.col(name).try_cast(kind)
    return df.withColumns({name: cast(name, kind) for name, kind in types.items()})


def map_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Stars to sentiment class."""
    return df.withColumn(column, lb.sentiment_of_stars(F.col(column)))


def zero_base_labels(train: DataFrame, others: dict[str, DataFrame], column: str = "label") -> dict[str, DataFrame]:
    """Shift labels down by one in every split if the training labels start at one.

    The decision is a one-row aggregate of the training split, read as a scalar subquery.
    """
    has_zero = F.coalesce(F.bool_or(F.col(column) == 0), F.lit(False))
    has_one = F.coalesce(F.bool_or(F.col(column) == 1), F.lit(False))
    shift = train.agg(F.when(~has_zero & has_one, 1).otherwise(0).alias("shift")).scalar()
    splits = {"train": train, **others}
    return {name: df.withColumn(column, F.col(column) - shift) for name, df in splits.items()}


def class_slice(df: DataFrame, label: int, column: str = "label") -> DataFrame:
    return df.where(F.col(column) == label)


def prepare_reviews(df: DataFrame) -> DataFrame:
    """Raw reviews to ``(row_id, label, text)`` in one pass over the rows, labels still 1-5."""
    cleaned = add_clean_text(add_text(fill_titles(drop_null_reviews(df))))
    return cast_columns(rename_model_columns(drop_raw_columns(cleaned)), {"label": "int", "text": "string"})


def guard_labels(df: DataFrame, classes: int, column: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows whose label lies in ``0..classes-1``, and a one-row count of the others."""
    good = F.coalesce(F.col(column).between(0, classes - 1), F.lit(False))
    return df.where(good), df.agg(F.count_if(~good).alias("rejected"))


def guard_nan(df: DataFrame, column: str = "logits") -> tuple[DataFrame, DataFrame]:
    """Rows without a NaN in ``column``, and a one-row count of the others."""
    bad = F.coalesce(vx.has_nan(F.col(column)), F.lit(False))
    return df.where(~bad), df.agg(F.count_if(bad).alias("rejected"))
