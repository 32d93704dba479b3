"""Model selection over the table of epoch metrics (one row per epoch, so it is small by nature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed


def early_stop(
    history: DataFrame,
    metric: str,
    patience: int = fixed.DEFAULT_PATIENCE,
    delta: float = fixed.DEFAULT_DELTA,
    mode: str = "max",
    compat: bool = False,
) -> DataFrame:
    """Where training stops: an ordered fold over the epochs.

    An epoch that gains less than ``delta`` adds one to a counter, any other resets it and becomes the best;
    at ``patience`` training stops. ``mode='min'`` works on the negated metric. A NaN is no gain.

    ``compat`` gives the behaviour of the original rule instead: in ``min`` mode no epoch is ever a gain, and
    a NaN counts as one.

    One row: ``stop_epoch`` (null if never), ``best_epoch``, ``best_score``, ``counter``.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode is 'min' or 'max'")
    sign = -1.0 if mode == "min" else 1.0
    worst = float("inf") if compat and mode == "min" else float("-inf")
    none = F.lit(None).cast("bigint")

    start = F.struct(
        F.lit(worst).alias("best"), none.alias("best_epoch"), F.lit(0).alias("counter"), none.alias("stop_epoch")
    )

    def step(state: Column, row: Column) -> Column:
        score = row["score"]
        short = score < state["best"] + F.lit(float(delta))
        # Spark orders NaN above all numbers, so both readings of NaN are spelled out.
        no_gain = short & ~F.isnan(state["best"]) if compat else short | F.isnan(score)
        counter = F.when(no_gain, state["counter"] + 1).otherwise(0)
        moved = F.struct(
            F.when(no_gain, state["best"]).otherwise(score).alias("best"),
            F.when(no_gain, state["best_epoch"]).otherwise(row["epoch"]).alias("best_epoch"),
            counter.alias("counter"),
            F.when(no_gain & (counter >= patience), row["epoch"]).alias("stop_epoch"),
        )
        return F.when(state["stop_epoch"].isNotNull(), state).otherwise(moved)

    epochs = history.agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("epoch").cast("bigint").alias("epoch"), (F.lit(sign) * F.col(metric)).alias("score"))
            )
        ).alias("epochs")
    )
    end = epochs.select(F.aggregate("epochs", start, step).alias("end"))
    return end.select(
        F.col("end.stop_epoch").alias("stop_epoch"),
        F.col("end.best_epoch").alias("best_epoch"),
        (F.lit(sign) * F.col("end.best")).alias("best_score"),
        F.col("end.counter").alias("counter"),
    )


def best_epoch(history: DataFrame, metric: str = "f1") -> DataFrame:
    """The first epoch with the highest metric above zero; no row if there is none."""
    m = F.col(metric)
    return history.where((m > 0) & ~F.isnan(m)).orderBy(F.desc(metric), "epoch").limit(1)
