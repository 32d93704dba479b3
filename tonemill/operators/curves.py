"""ROC and precision-recall curves with their areas.

A curve is a running sum over the distinct scores of a class, highest first. Rows with the same score are
counted map-side before anything is ordered, so a score shared by a third of the rows is one row. The
distinct scores are then cut into buckets at quantiles; only small tables cross buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.operators.metrics import one_vs_rest
from tonemill.operators.ranking import quantile_buckets
from tonemill.session import bucket_count

MICRO = "micro"


def class_points(scored: DataFrame, micro: bool = False) -> DataFrame:
    """``(cls, score, pos)`` to draw curves from: per class, or all pairs pooled under ``micro``.

    A null, NaN or infinite score fails the job, whatever the partitions; ``guard_nan`` keeps such rows out. Rows without
    a class or without scores take no part.
    """
    pairs = one_vs_rest(scored)
    cls = F.lit(MICRO) if micro else F.col("cls").cast("string")
    refused = F.raise_error(F.lit("a score of a curve must be a finite number")).cast("double")
    score = F.when(F.abs("score") < float("inf"), F.col("score")).otherwise(refused)
    return pairs.where(F.col("pos").isNotNull()).select(cls.alias("cls"), score.alias("score"), "pos")


def score_counts(points: DataFrame) -> DataFrame:
    """Positive and negative rows per class and distinct score; counted map-side first."""
    return points.groupBy("cls", "score").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))


def pooled_counts(counts: DataFrame) -> DataFrame:
    """The ``micro`` counts from those of the classes."""
    return counts.groupBy(F.lit(MICRO).alias("cls"), "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def running_counts(counts: DataFrame, sketch: DataFrame | None = None) -> DataFrame:
    """Per class and distinct score: true and false positives at that threshold, and what the curves need.

    ``sketch`` is a table with the scores to find bucket edges from, if that is cheaper to read than
    ``counts``. All four curve functions read this table, so store it to draw more than one.

    Columns: ``cls, score, pos, neg`` (rows at this score), ``tp, fp`` (rows at this score or above),
    ``all_pos, all_neg``, ``first``/``last`` in descending score order, ``next_pos, next_neg`` (rows at the
    next lower score).
    """
    source = counts if sketch is None else sketch
    cutter = quantile_buckets(source, "score", bucket_count(counts.sparkSession), "bucket")
    counts = cutter.transform(counts) if cutter else counts.withColumn("bucket", F.lit(0.0))
    counts = counts.withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(0)))

    # One row per class and bucket: sums, and the first row in descending order for the bucket above it.
    totals = counts.groupBy("cls", "bucket").agg(
        F.sum("pos").alias("b_pos"),
        F.sum("neg").alias("b_neg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("top"),
    )
    per_class = Window.partitionBy("cls")
    down = per_class.orderBy(F.desc("bucket"))
    offsets = totals.select(
        "cls",
        "bucket",
        (F.sum("b_pos").over(down) - F.col("b_pos")).alias("pos_above"),
        (F.sum("b_neg").over(down) - F.col("b_neg")).alias("neg_above"),
        F.sum("b_pos").over(per_class).alias("all_pos"),
        F.sum("b_neg").over(per_class).alias("all_neg"),
        F.lead("top").over(down).alias("below"),
    )
    local = Window.partitionBy("cls", "bucket").orderBy(F.desc("score"))
    placed = counts.select(
        "*",
        F.sum("pos").over(local).alias("tp_in"),
        F.sum("neg").over(local).alias("fp_in"),
        F.lead(F.struct("pos", "neg")).over(local).alias("next_in"),
    ).join(offsets, ["cls", "bucket"])
    following = F.coalesce("next_in", "below")
    return placed.select(
        "cls",
        "score",
        "pos",
        "neg",
        (F.col("pos_above") + F.col("tp_in")).alias("tp"),
        (F.col("neg_above") + F.col("fp_in")).alias("fp"),
        "all_pos",
        "all_neg",
        ((F.col("pos_above") + F.col("neg_above") + F.col("tp_in") + F.col("fp_in")) == F.col("pos") + F.col("neg")).alias("first"),
        following.isNull().alias("last"),
        following["pos"].alias("next_pos"),
        following["neg"].alias("next_neg"),
    )


def _share(part: Column, whole: Column) -> Column:
    """part / whole; null where the class has no such rows and the rate is undefined."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def curve_counts(points: DataFrame) -> DataFrame:
    """``running_counts`` straight from points; the edges come from a scan of the scores, before any shuffle."""
    return running_counts(score_counts(points), points)


def all_curve_counts(points: DataFrame) -> DataFrame:
    """``curve_counts`` of every class and of all pairs pooled, from one count of the points."""
    counts = score_counts(points)
    return running_counts(counts.unionByName(pooled_counts(counts)), points)


def roc_curve(run: DataFrame) -> DataFrame:
    """``(cls, threshold, fpr, tpr)``: corner points only, with (0, 0) at threshold infinity.

    A point inside a straight stretch, where the next step equals the last one, is left out.
    """
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = run.where(F.col("first") | F.col("last") | bend)
    here = F.struct(
        F.col("score").alias("threshold"),
        _share(F.col("fp"), F.col("all_neg")).alias("fpr"),
        _share(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )
    start = F.struct(
        F.lit(float("inf")).alias("threshold"),
        _share(F.lit(0), F.col("all_neg")).alias("fpr"),
        _share(F.lit(0), F.col("all_pos")).alias("tpr"),
    )
    return kept.select("cls", F.inline(F.when(F.col("first"), F.array(start, here)).otherwise(F.array(here))))


def roc_auc(run: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, in exact integers up to one division; null if undefined."""
    wide = "decimal(38,0)"
    # Twice the trapezoid: step width times (height before + height after).
    twice = F.col("neg").cast("decimal(18,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")
    summed = run.groupBy("cls").agg(
        F.sum(twice.cast(wide)).alias("area"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n")
    )
    # Doubles from here on: 2 * p * n passes bigint near 2e9 rows a side.
    whole = 2 * F.col("p").cast("double") * F.col("n").cast("double")
    return summed.select("cls", (F.col("area").cast("double") / F.nullif(whole, F.lit(0.0))).alias("auc"))


def _recall(tp: Column) -> Column:
    """Recall at a threshold; one throughout where the class has no rows."""
    return F.when(F.col("all_pos") == 0, 1.0).otherwise(_share(tp, F.col("all_pos")))


def pr_curve(run: DataFrame) -> DataFrame:
    """``(cls, threshold, precision, recall)`` at every distinct score, and the end point (1, 0) without one."""
    here = F.struct(
        F.col("score").alias("threshold"),
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _recall(F.col("tp")).alias("recall"),
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return run.select("cls", F.inline(F.when(F.col("first"), F.array(here, end)).otherwise(F.array(here))))


def average_precision(run: DataFrame) -> DataFrame:
    """Precision summed over the steps of recall; 0 for a class without rows."""
    step = F.col("pos").cast("double") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    return run.groupBy("cls").agg(
        F.coalesce(F.sum(step) / F.nullif(F.max("all_pos").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("ap")
    )
