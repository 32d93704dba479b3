"""Classification metrics.

Everything that depends on ``(y, pred)`` alone starts from ``confusion_counts``: one pass over the scored
rows with map-side counts, leaving at most classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed
from tonemill.functions import labels as lb
from tonemill.functions import vectors as vx
from tonemill.operators.sampling import sample_rows


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where there is nothing to divide by."""
    return F.when(bottom != 0, top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))).otherwise(0.0)


def confusion_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("y", "pred").agg(F.count("*").alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


def _seen_grid(counts: DataFrame) -> DataFrame:
    """Every pair of the classes seen on either side, from one row with the class list."""
    seen = counts.select(F.explode(F.array("y", "pred")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("classes"))
    return seen.select("classes", F.explode("classes").alias("y")).select("y", F.explode("classes").alias("pred"))


def confusion_matrix(counts: DataFrame, classes: Sequence[int] | int | None = None) -> DataFrame:
    """Every (y, pred) cell with its count, zeros included. Classes default to all labels seen."""
    if classes is None:
        grid = _seen_grid(counts)
    else:
        labels = list(range(classes)) if isinstance(classes, int) else list(classes)
        k = len(labels)
        names = F.lit(labels).cast("array<int>")
        cell = F.col("id")
        grid = counts.sparkSession.range(k * k).select(
            F.get(names, F.floor(cell / k).cast("int")).alias("y"), F.get(names, (cell % k).cast("int")).alias("pred")
        )
    return grid.join(counts, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def wide_confusion(matrix: DataFrame, classes: int) -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = [F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in range(classes)]
    return matrix.groupBy("y").agg(*cells)


def top_confusions(matrix: DataFrame, n: int = fixed.TOP_CONFUSIONS) -> DataFrame:
    """Largest off-diagonal cells, ties by (y, pred); empty cells may be among them."""
    return matrix.where(F.col("y") != F.col("pred")).orderBy(F.desc("n"), "y", "pred").limit(n)


def class_scores(counts: DataFrame) -> DataFrame:
    """Per class: hits, support, predicted, precision, recall, F1. Classes are those seen on either side."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = counts.select(F.inline(sides)).groupBy("cls").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    return per_class.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
            "f1": _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )


def class_report(counts: DataFrame) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``.

    The accuracy row has its value under F1, as printed reports do. Every class row counts towards its own
    line and the summary lines, so the whole report is one small aggregation.
    """
    lines = F.array(F.col("cls").cast("string"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    spread = class_scores(counts).withColumn("line", F.explode(lines))
    support = F.sum("support")
    weighted = F.col("line") == "weighted avg"
    is_accuracy = F.col("line") == "accuracy"

    def score(name: str) -> Column:
        return F.when(weighted, _ratio(F.sum(F.col(name) * F.col("support")), support)).otherwise(F.avg(name))

    return spread.groupBy("line").agg(
        F.when(~is_accuracy, score("precision")).alias("precision"),
        F.when(~is_accuracy, score("recall")).alias("recall"),
        F.when(is_accuracy, _ratio(F.sum("hits"), support)).otherwise(score("f1")).alias("f1"),
        support.alias("support"),
    ).withColumnRenamed("line", "cls")


def weighted_prf(counts: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 in one row."""
    support = F.sum("support")
    return class_scores(counts).agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(m) for m in ("precision", "recall", "f1")]
    )


def metric_table(counts: DataFrame, names: Sequence[str] = fixed.CLASS_NAMES) -> DataFrame:
    """Precision, recall and F1 by class name; classes outside the name list are left out, as are unseen ones."""
    return class_scores(counts).where(F.col("cls").between(0, len(names) - 1)).select(
        lb.class_name(F.col("cls"), names).alias("class_name"), "precision", "recall", "f1"
    )


def class_distribution(counts: DataFrame) -> DataFrame:
    """Rows per class among the true and among the predicted labels."""
    return class_scores(counts).select("cls", F.col("support").alias("true_n"), F.col("predicted").alias("pred_n"))


def row_loss(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", vx.cross_entropy(F.col("logits"), F.col("y")))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean of the batch means, so a short last batch weighs as much as a full one."""
    return losses.groupBy("batch_id").agg(F.avg("loss").alias("m")).agg(F.avg("m").alias("epoch_loss"))


def one_vs_rest(scored: DataFrame) -> DataFrame:
    """One row per scored row and class: the class score, and whether it is the true class."""
    return scored.select("row_id", "y", F.posexplode("probs").alias("cls", "score")).select(
        "row_id", "cls", "score", (F.col("cls") == F.col("y")).cast("int").alias("pos")
    )


def confidence_histogram(scored: DataFrame, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Confidence counts of the correct and of the incorrect predictions, each over its own range.

    The last bin is closed, a constant group is centred in a range of width one, and a group without rows
    has the range 0 to 1. The ranges are two rows (correct or not), so they are broadcast.
    """
    grouped = scored.select(
        F.when(F.col("y") == F.col("pred"), "correct").otherwise("incorrect").alias("grp"),
        vx.confidence(F.col("probs"), F.col("pred")).alias("c"),
    )
    ranges = grouped.groupBy("grp").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("group_size"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "grp",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        "group_size",
    )
    width = (F.col("hi") - F.col("lo")) / bins

    def edge(i: Column) -> Column:
        return i * width + F.col("lo")

    first = F.least(F.floor((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    # The quotient may round across an edge; the edges decide.
    guess = F.col("guess")
    settled = (
        F.when(F.col("c") < edge(guess), guess - 1)
        .when((guess < bins - 1) & (F.col("c") >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counted = (
        grouped.join(F.broadcast(ranges), "grp")
        .withColumn("guess", first)
        .withColumn("bin", settled)
        .groupBy("grp", "bin")
        .agg(F.count("*").alias("n"))
    )
    cell = F.col("id")
    grid = scored.sparkSession.range(2 * bins).select(
        F.when(cell < bins, "correct").otherwise("incorrect").alias("grp"), (cell % bins).cast("int").alias("bin")
    )
    return (
        grid.join(ranges, "grp", "left")
        .join(counted, ["grp", "bin"], "left")
        .withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(1.0))})
        .select(
            "grp",
            "bin",
            edge(F.col("bin")).alias("bin_lo"),
            F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1)).alias("bin_hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("group_size", F.lit(0)).alias("group_size"),
        )
    )


def misclassified(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("y") != F.col("pred"))


def misclassified_sample(scored: DataFrame, n: int = 5, by: str = "random", seed: int = fixed.DEFAULT_SEED) -> DataFrame:
    """Up to ``n`` wrong predictions: a seeded sample, or those with the highest confidence."""
    wrong = misclassified(scored)
    if by == "random":
        return sample_rows(wrong, n, seed)
    if by == "confidence":
        return wrong.orderBy(F.desc(vx.confidence(F.col("probs"), F.col("pred"))), "row_id").limit(n)
    raise ValueError("by is 'random' or 'confidence'")


def error_examples(
    scored: DataFrame,
    texts: DataFrame,
    n: int = 5,
    by: str = "random",
    seed: int = fixed.DEFAULT_SEED,
    names: Sequence[str] = fixed.CLASS_NAMES,
) -> DataFrame:
    """``misclassified_sample`` with the text and the names of both classes; rows without a text are left out."""
    wrong = misclassified_sample(scored, n, by, seed)
    return wrong.join(texts.select("row_id", "text"), "row_id").select(
        "row_id", "text", lb.class_name(F.col("y"), names).alias("true_name"), lb.class_name(F.col("pred"), names).alias("pred_name")
    )
