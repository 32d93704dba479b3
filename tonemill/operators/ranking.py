"""Order a whole table without ordering it in one task.

Classes are few, so a window per class would sort a third of the table in one task. Both tools here
cut the order into buckets first and look inside a bucket only as far as needed:

* ``smallest_per_group`` finds, per group, the order key of the last row to keep. The wide rows are
  then only filtered; they are never shuffled or sorted.
* ``with_positions`` numbers all rows: rows of earlier buckets are counted from a small table, and
  only the place inside the bucket needs the rows themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.session import bucket_count, scratch_dir

# Hex digits of the order key added per refinement: 16**3 buckets per group.
DIGITS_PER_LEVEL = 3
# Rows of one group's cut bucket that may be ranked in one task.
MAX_CUT_ROWS = 100_000
# Groups of partitions whose quantile sketches are merged apart.
SKETCH_GROUPS = 256
# Sort before and after every md5 string.
BEFORE_ALL = ""
AFTER_ALL = "g"


def order_key(row_id: Column, seed: int | str) -> Column:
    """A reproducible random order: md5 of ``row_id:seed``, as evenly spread as the ids are unique."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")).cast("binary"))


def mark_smallest_per_group(
    df: DataFrame,
    group: str | None,
    quotas: Callable[[DataFrame], DataFrame],
    seed: int,
    id_col: str = "row_id",
    flag: str = "selected",
) -> DataFrame:
    """Add ``flag``: true for the first ``quota`` rows of each group in the seeded order.

    ``quotas`` maps the table ``(grp, size)`` to ``(grp, size, quota)``. ``id_col`` must be unique.

    The cut of a group is found digit by digit, like in a radix sort. One pass over the group and id columns counts rows
    by group and first digits of the order key; the counts are stored, and all groups find their cut bucket in them at
    once. While the fullest cut bucket holds more rows than a task may rank, the rows of the cut buckets are counted by
    the digits that follow. Then the cut buckets are ranked, and the pass over the wide rows is a filter against one row
    per group. The steps are the same for three groups and for millions; the tables are stored, so Spark knows their
    sizes when it chooses how to join them.
    """
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"

    def stored(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    grp = F.col(group) if group else F.lit(0)
    keyed = df.select(grp.alias("grp"), F.col(id_col).alias("id"), order_key(F.col(id_col), seed).alias("key"))

    digits = DIGITS_PER_LEVEL
    counts = keyed.groupBy("grp", F.substring("key", 1, digits).alias("prefix")).agg(F.count("*").alias("n"))
    histogram = stored(counts, "histogram")
    goals = quotas(histogram.groupBy("grp").agg(F.sum("n").alias("size")))

    def cut_bucket(hist: DataFrame, need: DataFrame) -> DataFrame:
        """Per group the bucket in which the running count reaches what is needed."""
        in_order = Window.partitionBy("grp").orderBy("prefix")
        running = hist.withColumn("upto", F.sum("n").over(in_order))
        before = F.col("upto") - F.col("n")
        return (
            _join_groups(running, need.select("grp", "need"))
            .where((before < F.col("need")) & (F.col("upto") >= F.col("need")))
            .select("grp", (F.col("need") - before).alias("need"), F.col("prefix").alias("cut"), "n")
        )

    goals = stored(goals.select("grp", "size", "quota"), "goals")
    split = goals.where((F.col("quota") > 0) & (F.col("quota") < F.col("size")))
    cut = stored(cut_bucket(histogram, split.select("grp", F.col("quota").alias("need"))), "cut")
    while digits < 30 and (cut.agg(F.max("n")).first()[0] or 0) > MAX_CUT_ROWS:
        inside = _join_groups(keyed, cut.select("grp", "cut")).where(F.substring("key", 1, digits) == F.col("cut"))
        digits += DIGITS_PER_LEVEL
        finer = inside.groupBy("grp", F.substring("key", 1, digits).alias("prefix")).agg(F.count("*").alias("n"))
        cut = stored(cut_bucket(finer, cut), f"cut-{digits}")

    last_row = Window.partitionBy("grp").orderBy("key", "id")
    exact = (
        _join_groups(keyed, cut)
        .where(F.substring("key", 1, digits) == F.col("cut"))
        .withColumn("rank", F.row_number().over(last_row))
        .where(F.col("rank") == F.col("need"))
        .select("grp", F.col("key").alias("last_key"), F.col("id").alias("last_id"))
    )
    limits = _join_groups(goals, exact, how="left").select(
        "grp",
        F.when(F.col("quota") <= 0, BEFORE_ALL)
        .when(F.col("quota") >= F.col("size"), AFTER_ALL)
        .otherwise(F.col("last_key"))
        .alias("last_key"),
        F.col("last_id"),
    )
    key = order_key(F.col(id_col), seed)
    if group is None:  # one limit at most: constants of the plan, no join
        last = limits.first()
        if last is None:
            return df.withColumn(flag, F.lit(False))
        bound = F.struct(F.lit(last["last_key"]), F.lit(last["last_id"]).cast(df.schema[id_col].dataType))
        return df.withColumn(flag, F.coalesce(F.struct(key, F.col(id_col)) <= bound, F.lit(False)))
    limits = stored(limits, "limits")
    joined = df.join(limits.withColumnsRenamed({"grp": "__grp", "last_key": "__key", "last_id": "__id"}),
                     grp.eqNullSafe(F.col("__grp")), "left")
    # As one comparison of pairs the key is computed once per row.
    taken = F.struct(key, F.col(id_col)) <= F.struct("__key", "__id")
    return joined.withColumn(flag, F.coalesce(taken, F.lit(False))).drop("__grp", "__key", "__id")


def _join_groups(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``grp`` where null is a group like any other."""
    renamed = right.withColumnRenamed("grp", "__g")
    return left.join(renamed, left["grp"].eqNullSafe(F.col("__g")), how).drop("__g")


def smallest_per_group(
    df: DataFrame, group: str | None, quotas: Callable[[DataFrame], DataFrame], seed: int, id_col: str = "row_id"
) -> DataFrame:
    """The rows ``mark_smallest_per_group`` marks."""
    return mark_smallest_per_group(df, group, quotas, seed, id_col, "__take").where("__take").drop("__take")


def quantile_buckets(df: DataFrame, column: str, buckets: int, out: str = "bucket") -> Bucketizer | None:
    """A transformer that cuts ``column`` at quantiles, so that buckets hold about equal numbers of rows.

    The edges only balance the work: every row lands in a bucket and any edges give the same results. So they
    are quantiles of quantiles: partitions are sketched in groups, and the group quantiles are sketched once
    more, which keeps one task from merging the sketches of all partitions. The driver sees at most
    ``buckets`` numbers. Returns None when one bucket is enough.
    """
    if buckets < 2:
        return None
    # As one text literal: a list would be one expression per mark.
    marks = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
    accuracy = max(10_000, 4 * buckets)
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))
    values = F.col(column).cast("double")
    partial = df.select(group.alias("g"), values.alias("v")).groupBy("g").agg(F.percentile_approx("v", marks, accuracy).alias("q"))
    edges = partial.select(F.explode("q").alias("v")).agg(F.percentile_approx("v", marks, accuracy).alias("edges")).first()["edges"]
    inner = sorted(set(edges or []))
    if not inner:
        return None
    return Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol=column, outputCol=out, handleInvalid="error"
    )


def _never_null(bucket: Column) -> Column:
    """Keep the optimizer from adding a null filter, which would work out the bucket again for every row."""
    return F.coalesce(bucket, F.lit(0))


def with_positions(df: DataFrame, id_col: str = "row_id", seed: int | str | None = None) -> DataFrame:
    """Add ``pos`` (0-based place in the total order) and ``total`` (row count).

    With a seed the order is the seeded shuffle, else it is ``id_col`` itself (numeric). The one
    shuffle of wide rows is by bucket, which is what a total reordering needs anyway; the bucket offsets
    are joined on that partitioning.
    """
    buckets = bucket_count(df.sparkSession)
    if seed is None:
        order = [F.col(id_col)]
        cutter = quantile_buckets(df, id_col, buckets, "__bucket")
        placed = cutter.transform(df) if cutter else df.withColumn("__bucket", F.lit(0.0))
        placed = placed.withColumn("__bucket", _never_null(F.col("__bucket").cast("int")))
    else:
        key = order_key(F.col(id_col), seed)
        order = [F.col("__key"), F.col(id_col)]
        head = F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint")
        placed = df.withColumn("__key", key).withColumn(
            "__bucket", _never_null(F.shiftright(head * buckets, 32).cast("int"))
        )

    counts = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    everything = Window.partitionBy(F.lit(0))
    offsets = counts.select(
        F.col("__bucket").alias("__b"),
        (F.sum("__n").over(everything.orderBy("__bucket")) - F.col("__n")).alias("__offset"),
        F.sum("__n").over(everything).alias("total"),
    )
    inside = Window.partitionBy("__bucket").orderBy(*order)
    return (
        placed.withColumn("__place", F.row_number().over(inside) - 1)
        .join(offsets, F.col("__bucket") == F.col("__b"))
        .withColumn("pos", F.col("__offset") + F.col("__place"))
        .drop("__key", "__bucket", "__b", "__n", "__offset", "__place")
    )
