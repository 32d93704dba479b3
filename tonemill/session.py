"""Session settings every operator shares."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "tonemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``.

    Without it a local session takes a folder below its warehouse; a cluster, whose machines share no such folder by
    default, is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/tonemill-scratch").rstrip("/")


def bucket_count(spark: SparkSession) -> int:
    """Order buckets to cut a table into: as many as the user gives shuffles partitions.

    A bucket is ordered inside one task, so it must be what a shuffle partition is: a size the
    executors handle. Both then grow with the one setting that is sized to the data.
    """
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
