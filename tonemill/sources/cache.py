"""Write-once store of prepared sets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tonemill.sources.manifest import attempt_name, entries, put_entry


def cache_key(**parts: Any) -> str:
    """Name of a prepared set: everything that shapes it (sources, fraction, seed, version) goes in."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def prepared_set(
    spark: SparkSession, root: str, key: str, build: Callable[[], Mapping[str, DataFrame]]
) -> dict[str, DataFrame]:
    """The splits stored under ``key``; built and written on the first call.

    Every writer has a folder of its own and publishes it with one file. Of several writers the first to publish
    counts, for all readers and for good; a broken one is never seen.
    """
    place = f"{root.rstrip('/')}/prepared/{key}"
    published = entries(spark, place)
    if not published:
        attempt = attempt_name()
        splits = build()
        for name, df in splits.items():
            df.write.parquet(f"{place}/{attempt}/{name}")
        put_entry(spark, place, attempt, {"splits": sorted(splits)})
        published = entries(spark, place)
    first = published[0]
    return {name: spark.read.parquet(f"{place}/{first['attempt']}/{name}") for name in first["splits"]}
