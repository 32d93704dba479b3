"""Train a head on pooled vectors: split, fit by epochs, keep the best weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.operators.fitting import layer_weights
from tonemill.operators.sampling import train_test_split
from tonemill.operators.training import EpochSettings, FitResult, fit_layers

# Widths of the hidden layers of the classifier on frozen vectors, and its dropout.
HIDDEN_WIDTHS = [512, 128]
HIDDEN_DROPOUT = 0.3


def train_head(
    vectors: DataFrame,
    classes: int,
    dims: int,
    settings: EpochSettings = EpochSettings(),
    test_fraction: float = 0.2,
    hidden: Sequence[int] = (),
    state_folder: str | None = None,
) -> FitResult:
    """Split ``(row_id, vec, label)`` by class and train with validation on the held-out part.

    Without ``hidden`` widths the head is linear.
    """
    split = train_test_split(vectors, test_fraction, settings.seed)
    parts = [split.where(F.col("split") == name) for name in ("train", "test")]
    return fit_layers(*parts, [dims, *hidden, classes], settings, state_folder)


def save_fit(result: FitResult, like: DataFrame, folder: str) -> None:
    """Write the best weights, the final weights and the epoch history."""
    spark, folder = like.sparkSession, folder.rstrip("/")
    for name, layers in (("best", result.best), ("final", result.last)):
        if layers is not None:
            layer_weights(spark, layers).write.mode("overwrite").parquet(f"{folder}/{name}")
    result.history_table(spark).write.mode("overwrite").parquet(f"{folder}/history")
