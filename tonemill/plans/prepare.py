"""Raw reviews to a prepared training and test set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tonemill import fixed_values as fixed
from tonemill.operators.cleaning import map_labels, prepare_reviews
from tonemill.operators.sampling import balance_classes, stratified_sample
from tonemill.sources.cache import cache_key, prepared_set
from tonemill.sources.sinks import write_csv


def prepare_splits(
    splits: Mapping[str, DataFrame],
    caps: Mapping[str, Mapping[int, int]] | None = None,
    seed: int = fixed.DEFAULT_SEED,
    allow_short: bool = False,
) -> dict[str, DataFrame]:
    """Clean every split, map stars to classes and cap the classes named in ``caps``.

    The searches for the caps read the label and id columns only; the text is cleaned once, when the result
    is written.
    """
    ready = {name: map_labels(prepare_reviews(df)) for name, df in splits.items()}
    return {
        name: balance_classes(df, (caps or {}).get(name, {}), seed, allow_short=allow_short)
        for name, df in ready.items()
    }


def save_csv(splits: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in splits.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}")


def cached_fraction(
    spark: SparkSession,
    root: str,
    splits: Mapping[str, DataFrame],
    sources: Mapping[str, str],
    fraction: float | None,
    seed: int = fixed.DEFAULT_SEED,
    version: str = "1",
) -> dict[str, DataFrame]:
    """A class-wise fraction of every split (all of it without one), computed once per sources, fraction, seed and
    version.

    ``version`` is to be changed when the sources change in place.
    """
    def build() -> Mapping[str, DataFrame]:
        if not fraction:
            return splits
        return {name: stratified_sample(df, fraction, seed) for name, df in splits.items()}

    key = cache_key(sources=dict(sources), fraction=fraction, seed=seed, version=version)
    return prepared_set(spark, root, key, build)
