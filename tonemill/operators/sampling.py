"""Balance, sample, split, shuffle, shard and batch rows, all reproducible from a seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed
from tonemill.operators import ranking as rk


def balance_classes(
    df: DataFrame,
    caps: Mapping[int, int],
    seed: int = fixed.DEFAULT_SEED,
    group: str = "label",
    allow_short: bool = False,
) -> DataFrame:
    """Keep ``caps[c]`` random rows of class c; classes without a cap stay whole.

    A cap above the class size is an error unless ``allow_short``.
    """
    if not caps:
        return df
    cap_of = F.create_map(*[F.lit(v) for pair in caps.items() for v in pair])

    def quotas(sizes: DataFrame) -> DataFrame:
        cap = F.when(F.col("grp").isNotNull(), F.try_element_at(cap_of, F.col("grp")))
        if not allow_short:
            short = sizes.where(cap > F.col("size")).limit(5).collect()
            if short:
                raise ValueError(f"cap above class size: {[(r['grp'], r['size']) for r in short]}")
        return sizes.withColumn("quota", F.least(F.coalesce(cap, F.col("size")), F.col("size")))

    return rk.smallest_per_group(df, group, quotas, seed)


def balance_to_class(df: DataFrame, anchor: int, seed: int = fixed.DEFAULT_SEED, group: str = "label") -> DataFrame:
    """Keep as many random rows of every class as class ``anchor`` has; smaller classes stay whole.

    Sizes come from the histogram the cut is found in, so no extra count is needed. Without rows of ``anchor`` no row of
    another class is kept; a null class is a class like any other.
    """

    def quotas(sizes: DataFrame) -> DataFrame:
        # One row per class: the window over all of them is a window over the class list.
        size = F.max(F.when(F.col("grp") == anchor, F.col("size"))).over(Window.partitionBy(F.lit(0)))
        return sizes.withColumn("quota", F.least(F.coalesce(size, F.lit(0)), F.col("size")))

    return rk.smallest_per_group(df, group, quotas, seed)


def union_slices(slices: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; duplicates stay."""
    return reduce(DataFrame.unionByName, slices)


def stratified_sample(
    df: DataFrame, fraction: float, seed: int = fixed.DEFAULT_SEED, group: str = "label"
) -> DataFrame:
    """Half-even ``round(fraction * size)`` rows of every class; rows without a class are left out."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    return rk.smallest_per_group(
        df.where(F.col(group).isNotNull()),
        group,
        lambda sizes: sizes.withColumn("quota", F.bround(F.lit(float(fraction)) * F.col("size")).cast("bigint")),
        seed,
    )


def train_test_split(
    df: DataFrame,
    test_fraction: float = 0.2,
    seed: int = fixed.DEFAULT_SEED,
    group: str | None = "label",
    allow_single: bool = False,
) -> DataFrame:
    """Add ``split``: ``test`` for ceil(fraction * rows) rows, ``train`` for the rest.

    With a group, each class gets its share of the test rows by largest remainder, ties by class; a null
    class is a class of its own. Both parts are filters of the same scan. A class of one row, which cannot be in both
    parts, is an error unless ``allow_single``.
    """

    def quotas(sizes: DataFrame) -> DataFrame:
        if group is not None and not allow_single:
            single = sizes.where("size < 2").limit(5).collect()
            if single:
                raise ValueError(f"classes of a single row: {[r['grp'] for r in single]}")
        # One row per class: the window over all of them is a window over the class list.
        all_classes = Window.partitionBy(F.lit(0))
        total = F.sum("size").over(all_classes)
        wanted = F.ceil(F.lit(float(test_fraction)) * total)
        # Whole part and remainder of wanted * size / total, in integers.
        share = wanted.cast("decimal(38,0)") * F.col("size")
        shared = sizes.select(
            "grp", "size", wanted.alias("wanted"),
            ((share - share % total) / total).cast("bigint").alias("base"),
            (share % total).cast("decimal(38,0)").alias("rest"),
        )
        ranked = shared.withColumn(
            "place", F.row_number().over(all_classes.orderBy(F.desc("rest"), F.asc_nulls_last("grp")))
        ).withColumn("missing", F.col("wanted") - F.sum("base").over(all_classes))
        extra = F.when(F.col("place") <= F.col("missing"), 1).otherwise(0)
        return ranked.select("grp", "size", (F.col("base") + extra).alias("quota"))

    marked = rk.mark_smallest_per_group(df, group, quotas, seed, flag="__test")
    return marked.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def epoch_order(df: DataFrame, seed: int = fixed.DEFAULT_SEED, epoch: int = 0) -> DataFrame:
    """Add ``pos``, the row's place in the shuffle of this epoch, and ``total``."""
    return rk.with_positions(df, seed=f"{seed}:{epoch}")


def with_natural_order(df: DataFrame) -> DataFrame:
    """Add ``pos``, the row's place by ``row_id``, and ``total``."""
    return rk.with_positions(df)


def shard_rows(df: DataFrame, shards: int, mode: str = "drop") -> DataFrame:
    """Deal positioned rows out to shards: position i goes to shard i mod ``shards``.

    ``drop`` leaves out the remainder so that all shards are equal. ``pad`` repeats leading rows
    instead, as often as needed; a repeated row gets the position it is repeated at.
    """
    pos, total = F.col("pos"), F.col("total")
    if mode == "drop":
        kept = df.where(pos < total - total % shards)
    elif mode == "pad":
        padded = F.ceil(total.cast("double") / shards).cast("bigint") * shards
        kept = df.withColumn("pos", F.explode(F.sequence(pos, padded - 1, total)))
    else:
        raise ValueError("mode is 'drop' or 'pad'")
    return kept.withColumn("shard", F.pmod(F.col("pos"), F.lit(shards)).cast("int"))


def batch_rows(df: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """Add ``batch_id`` for consecutive positions; the short last batch may be dropped."""
    pos, total = F.col("pos"), F.col("total")
    kept = df.where(pos < total - total % size) if drop_last else df
    return kept.withColumn("batch_id", F.floor(F.col("pos") / size).cast("bigint"))


def sample_rows(df: DataFrame, n: int, seed: int = fixed.DEFAULT_SEED, id_col: str = "row_id") -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer: the first ``n`` in the seeded order.

    Every task keeps its first ``n`` rows in a heap and the heaps are merged, in one pass. Ids may repeat; rows that share
    an id lie side by side in the order.
    """
    return df.orderBy(rk.order_key(F.col(id_col), seed), F.col(id_col)).limit(n)
