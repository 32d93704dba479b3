"""Evaluate a scored table: every report table, and the files of an evaluation run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tonemill import fixed_values as fixed
from tonemill.operators import curves as cv
from tonemill.operators import metrics as mt
from tonemill.operators.scoring import spot_check
from tonemill.sources.sinks import report_json, report_lines, store, write_json, write_lines


def evaluation_tables(scored: DataFrame, classes: int, folder: str) -> dict[str, DataFrame]:
    """Report tables of ``(row_id, y, pred, probs)``.

    The (y, pred) counts are one pass, and every table over them is made from the few rows it leaves. The
    threshold counts behind the curves are stored once under ``folder`` and read by all curves; the pooled
    ones are made from those of the classes. Give ``scored`` as a written table: it is scanned for the counts,
    the thresholds and the histogram, and a model should not run again for that.
    """
    counts = store(mt.confusion_counts(scored), f"{folder}/confusion_counts")
    matrix = mt.confusion_matrix(counts, classes)
    per_score = store(cv.score_counts(cv.class_points(scored)), f"{folder}/score_counts")
    every_score = per_score.unionByName(cv.pooled_counts(per_score))
    run = store(cv.running_counts(every_score, per_score), f"{folder}/threshold_counts")
    return {
        "class_report": mt.class_report(counts),
        "confusion_matrix": matrix,
        "top_confusions": mt.top_confusions(matrix),
        "class_distribution": mt.class_distribution(counts),
        "metric_table": mt.metric_table(counts),
        "confidence_histogram": mt.confidence_histogram(scored),
        "roc_curve": cv.roc_curve(run),
        "roc_auc": cv.roc_auc(run),
        "pr_curve": cv.pr_curve(run),
        "average_precision": cv.average_precision(run),
    }


def write_evaluation(
    scored: DataFrame, texts: DataFrame, folder: str, names: Sequence[str] = fixed.CLASS_NAMES
) -> dict[str, DataFrame]:
    """Write scores, report tables, the text and JSON summaries and the error samples under ``folder``."""
    folder = folder.rstrip("/")
    stored = store(scored.select("row_id", "y", "pred", "probs"), f"{folder}/scored")
    tables = evaluation_tables(stored, len(names), folder)
    counts = stored.sparkSession.read.parquet(f"{folder}/confusion_counts")
    tables["misclassified"] = mt.error_examples(stored, texts, names=names)
    tables["spot_check"] = spot_check(stored, texts, names=names)
    written = {name: store(df, f"{folder}/{name}") for name, df in tables.items()}
    write_lines(report_lines(counts, names), f"{folder}/metrics_summary")
    write_json(report_json(counts, len(names)), f"{folder}/evaluation_results")
    return written
