"""Clean and score rows as they arrive.

Cleaning, batch scoring and the prediction columns look at one row at a time, so the functions used on tables
apply to a stream as they are: no state, no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tonemill import fixed_values as fixed
from tonemill.operators.scoring import add_predictions, score_batches


def score_stream(
    stream: DataFrame,
    load_scorer: Callable[[], Callable],
    dims: int,
    path: str,
    checkpoint: str,
    names: Sequence[str] = fixed.CLASS_NAMES,
) -> StreamingQuery:
    """Score the rows that have arrived and write their predictions as Parquet, each row once."""
    predicted = add_predictions(score_batches(stream, load_scorer, dims), names)
    return (
        predicted.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
