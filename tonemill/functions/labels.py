"""Label expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed


def sentiment_of_stars(stars: Column) -> Column:
    """4 and 5 stars are Positive, 3 is Neutral, every other value (null too) is Negative."""
    return F.when(stars.isin(4, 5), 2).when(stars == 3, 1).otherwise(0)


def names_from_list(text: str) -> list[str]:
    """Class names from a comma list; their number is the number of classes."""
    return [name.strip() for name in text.split(",")]


def class_name(pred: Column, names: Sequence[str] = fixed.CLASS_NAMES) -> Column:
    """Name of a class index; an index outside the list is ``Unknown``."""
    return F.coalesce(
        F.get(F.array(*[F.lit(n) for n in names]), pred.cast("int")), F.lit(fixed.UNKNOWN_CLASS)
    )


def original_class(pred: Column) -> Column:
    """Class number counted from one."""
    return pred + 1
