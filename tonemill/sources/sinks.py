"""Write prepared sets, reports and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed
from tonemill.functions import labels as lb
from tonemill.operators import metrics as mt
from tonemill.sources.readers import CSV_OPTIONS

# A CSV file with quoted line breaks is read by one task; this keeps files to a task's size.
CSV_ROWS_PER_FILE = 1_000_000
KEEP_NULLS = {"ignoreNullFields": "false"}


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from what was written: later reads do not run ``df`` again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, path: str, id_col: str = "row_id") -> DataFrame:
    """Add a row number and store the rows, so that every later read sees the same numbers.

    Numbers are unique, as each task numbers within its own range, but not gapless.
    """
    return store(df.select(F.monotonically_increasing_id().alias(id_col), "*"), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS, maxRecordsPerFile=CSV_ROWS_PER_FILE).mode("overwrite").csv(path)


def report_json(counts: DataFrame, classes: int) -> DataFrame:
    """One row: the result document with the scores, the dense matrix and the class report as JSON.

    In the class report, accuracy is a number and every other entry an object.

    ``counts`` is the small (y, pred) table.
    """
    report = mt.class_report(counts)
    scores = F.struct("precision", "recall", F.col("f1").alias("f1-score"), F.col("support").cast("double").alias("support"))
    value = F.when(F.col("cls") == "accuracy", F.coalesce(F.col("f1").cast("string"), F.lit("null"))).otherwise(F.to_json(scores, KEEP_NULLS))
    entry = F.concat(F.lit('"'), F.col("cls"), F.lit('":'), value)
    summary = report.agg(
        F.max(F.when(F.col("cls") == "accuracy", F.col("f1"))).alias("accuracy"),
        *[F.max(F.when(F.col("cls") == "weighted avg", F.col(m))).alias(m) for m in ("precision", "recall", "f1")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cls", entry.alias("text")))), lambda e: e["text"]), ",").alias("entries"),
    )
    matrix = mt.wide_confusion(mt.confusion_matrix(counts, classes), classes).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("y", F.array(*[f"pred_{c}" for c in range(classes)]).alias("row")))),
            lambda r: r["row"],
        ).alias("conf_matrix")
    )
    head = F.to_json(F.struct("accuracy", "precision", "recall", "f1", matrix.scalar().alias("conf_matrix")), KEEP_NULLS)
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"class_report":{'), F.col("entries"), F.lit("}}"))
    return summary.select(whole.alias("value"))


def _four(value: Column) -> Column:
    """Four decimals, half-even on the exact binary value (``format_string`` rounds its decimal text half-up)."""
    return F.call_function("format_number", value, F.lit("0.0000"))


def report_lines(counts: DataFrame, names: Sequence[str] = fixed.CLASS_NAMES) -> DataFrame:
    """The printed summary as ``(line_no, value)``: overall scores, then four lines per class."""
    overall = mt.class_report(counts).agg(
        F.max(F.when(F.col("cls") == "accuracy", F.col("f1"))).alias("accuracy"),
        *[F.max(F.when(F.col("cls") == "weighted avg", F.col(m))).alias(m) for m in ("precision", "recall", "f1")],
    )
    # Wording of the report, in order.
    head = [
        F.lit("EVALUATION RESULTS"),
        F.lit("=" * 40),
        F.concat(F.lit("Accuracy: "), _four(F.col("accuracy"))),
        F.concat(F.lit("Precision: "), _four(F.col("precision"))),
        F.concat(F.lit("Recall: "), _four(F.col("recall"))),
        F.concat(F.lit("F1 Score: "), _four(F.col("f1"))),
        F.lit("=" * 40),
        F.lit(""),
        F.lit("Classification Report:"),
    ]
    body = [
        F.concat(F.lit("Class "), F.col("name"), F.lit(":")),
        F.concat(F.lit("  Precision: "), _four(F.col("precision"))),
        F.concat(F.lit("  Recall: "), _four(F.col("recall"))),
        F.concat(F.lit("  F1-Score: "), _four(F.col("f1"))),
        F.concat(F.lit("  Support: "), F.format_string("%.1f", F.col("support").cast("double"))),
    ]
    per_class = mt.class_scores(counts).where(F.col("cls").between(0, len(names) - 1)).withColumn(
        "name", lb.class_name(F.col("cls"), names)
    )
    top = overall.select(F.posexplode(F.array(*head)).alias("line_no", "value"))
    rest = per_class.select("cls", F.posexplode(F.array(*body)).alias("i", "value")).select(
        (F.lit(len(head)) + F.col("cls") * len(body) + F.col("i")).cast("int").alias("line_no"), "value"
    )
    return top.unionByName(rest)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``(line_no, value)`` as one text file. Reports are a few lines, whatever the data."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(path)


def write_json(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_weights(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cls int, idx int, w double").parquet(path)
