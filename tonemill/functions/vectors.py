"""Expressions over logits, probabilities and fixed-length vectors held in array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Class probabilities; the largest logit is subtracted first."""
    shifted = _let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return _let(
        shifted,
        lambda e: _let(_total(e), lambda s: F.transform(e, lambda x: x / s)),
    )


def argmax(values: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(probs: Column, pred: Column) -> Column:
    """Probability of the predicted class."""
    return F.get(probs, pred)


def cross_entropy(logits: Column, y: Column) -> Column:
    """logsumexp(logits) - logits[y]."""
    return _let(
        F.array_max(logits),
        lambda top: F.log(_total(F.transform(logits, lambda x: F.exp(x - top)))) + top,
    ) - F.get(logits, y)


def has_nan(values: Column) -> Column:
    return F.exists(values, lambda x: F.isnan(x))


def linear_logits(vec: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """W.x + b as an array, one entry per class.

    Meant for heads with few classes; the weights are literals of the plan. For wide heads use the
    batch scorer, which multiplies whole Arrow batches.
    """

    def one(row: Sequence[float], b: float) -> Column:
        products = F.zip_with(vec, F.lit([float(w) for w in row]), lambda x, w: x.cast("double") * w)
        return _total(products) + F.lit(float(b))

    return F.array(*[one(row, b) for row, b in zip(weights, bias)])
