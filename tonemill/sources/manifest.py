"""Publish written tables by one small file that comes last.

A writer puts its tables into a folder of its own and then one manifest file into another folder of its own. That file
is there whole or not at all, on object stores too: nothing is renamed, no two writers share a folder, and a writer that
breaks leaves a folder nobody reads.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def attempt_name() -> str:
    return uuid.uuid4().hex


def put_entry(spark: SparkSession, place: str, attempt: str, entry: dict[str, Any]) -> None:
    row = spark.createDataFrame([(json.dumps({**entry, "attempt": attempt}),)], "value string")
    row.coalesce(1).write.text(f"{place}/manifest/{attempt}")


def entries(spark: SparkSession, place: str) -> list[dict[str, Any]]:
    """All published entries, the earliest first; one small row for each attempt that ended well."""
    try:
        files = spark.read.option("recursiveFileLookup", "true").text(f"{place}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    when = F.col("_metadata.file_modification_time")
    rows = files.select("value", when.alias("at"), F.col("_metadata.file_path").alias("path")).collect()
    return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: (r["at"], r["path"]))]
