"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters rows into memory-sized buckets by a seeded hash; the exchange holds the buckets on disk. Pass two
shuffles every bucket in memory (Spark's array ``shuffle`` is a Fisher-Yates shuffle) and writes it. Buckets in order
then form one random order of all rows, which is cut into shards whose row counts are at most one apart.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.common import stage

SHARDS = 16
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1 << 15
OFFSET_GROUP = 1024  # buckets whose sizes one window adds up
SMALL_OFFSETS = 200_000  # buckets whose offsets, two numbers each, may be broadcast; more are joined by shuffle


def shuffled_buckets(rows: DataFrame, size: str, seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns, with ``_bucket`` and the shuffled position ``_place`` in it, written once.

    A bucket gets about ``bucket_bytes``, by the sum of ``size``, and about ``BUCKET_ROWS`` rows at most. Repeated rows
    are told apart by their place in the input, so that copies of one row do not meet in one bucket.
    """
    total = rows.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    buckets = max(1, ceil((total["b"] or 0) / bucket_bytes), ceil(total["n"] / BUCKET_ROWS))
    scattered = rows.select(
        F.struct("*").alias("_row"),
        F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).alias("_bucket"),
    )
    mixed = scattered.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows")).select("_bucket", F.shuffle("_rows", seed).alias("_rows"))
    placed = mixed.select("_bucket", F.posexplode("_rows").alias("_place", "_row"))
    return stage(placed.select("_row.*", "_bucket", "_place"), "buckets")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, each with ``size``, ``shard`` and its ``slot`` in the shard.

    size is the UTF-8 bytes of ``text`` plus one (null: none). Shard row counts are at most one apart and slots run from
    0 without a gap, for empty tables, null ids and texts and repeated rows alike. Columns that are called size, shard
    or slot already are replaced.
    """
    rows = docs.drop("size", "shard", "slot").withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    placed = shuffled_buckets(rows, "size", seed, bucket_bytes)
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / OFFSET_GROUP))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_n")).withColumn("_all", F.lit(0))
    groups = groups.select("_group", F.coalesce(F.sum("_n").over(before("_all").orderBy("_group")), F.lit(0)).alias("_start"))
    offsets = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before("_group").orderBy("_bucket")), F.lit(0)))
    offsets = offsets.join(groups, "_group").select("_bucket", (F.col("_start") + F.col("_in")).alias("_start"))
    totals = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("b")).first()
    n = max(1, totals["n"] or 0)
    if totals["b"] <= SMALL_OFFSETS:
        offsets = F.broadcast(offsets)
    position = F.col("_start") + F.col("_place")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return (
        placed.join(offsets, "_bucket")
        .withColumn("_position", position)
        .withColumn("shard", F.expr(f"cast((_position * {shards}L) div {n}L as int)"))
        .withColumn("slot", F.col("_position") - first)
        .drop("_bucket", "_place", "_start", "_position")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a file are in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
