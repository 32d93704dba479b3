"""Views of the given tables in the shapes the operators expect.

The given tables hold no star reviews. These views derive labels, titles and scores from ids by fixed rules,
so that a second engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions import labels as lb

DIMS = 64
VECTOR_CLASSES = 10
TOKENS_PER_ROW = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("row_id"),
        (doc % 5 + 1).cast("int").alias("class_index"),
        F.when(doc % 7 != 0, F.col("source")).alias("review_title"),
        F.when(doc % 11 != 0, F.col("text")).alias("review_text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class_index"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings as ``(row_id, label)`` with sentiment classes."""
    return ratings(spark, sf_dir).select("row_id", lb.sentiment_of_stars(F.col("class_index")).alias("label"))


def score_labels(df: DataFrame) -> DataFrame:
    """Scores for ``(row_id, label, ...)`` from integer weights, so that they are exact everywhere."""
    row, y = F.col("row_id"), F.col("label")

    def weight(factor: int, size: int, lift: int, c: int) -> Column:
        return 1 + (row * factor) % size + F.when(y == c, lift).otherwise(0)

    others = [c for c in df.columns if c not in ("row_id", "label")]
    weighted = df.select(
        "row_id", y.alias("y"), *others,
        weight(7, 97, 60, 0).alias("w0"), weight(11, 89, 40, 1).alias("w1"), weight(13, 83, 60, 2).alias("w2"),
    ).withColumn("total", (F.col("w0") + F.col("w1") + F.col("w2")).cast("double"))
    w = [F.col(f"w{c}") for c in range(3)]
    # Dividing by the common total keeps the order, so the largest weight is the prediction.
    pred = F.when((w[0] >= w[1]) & (w[0] >= w[2]), 0).when(w[1] >= w[2], 1).otherwise(2)
    return weighted.select(
        "row_id", "y", *others,
        F.array(*[x.cast("double") / F.col("total") for x in w]).alias("probs"),
        F.array(*[x.cast("double") / 10.0 for x in w]).alias("logits"),
        pred.alias("pred"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_labels(labelled(spark, sf_dir))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("row_id", lb.sentiment_of_stars((F.col("row_id") % 5 + 1).cast("int")).alias("label"))
    return score_labels(docs)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label"
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").join(quality, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "label")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors as the token vectors of one text; every third text ends in padding."""
    vec = F.col("vec_id")
    row, pos = F.floor(vec / TOKENS_PER_ROW), (vec % TOKENS_PER_ROW).cast("int")
    padding = (row % 3 == 0) & (pos == TOKENS_PER_ROW - 1)
    return table(spark, sf_dir, "embeddings").select(
        row.alias("row_id"), pos.alias("pos"), F.when(padding, 0).otherwise(1).alias("mask"), F.col("embedding").alias("vec")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day of events, standing in for epochs."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2023-12-31").cast("date"))
    return table(spark, sf_dir, "events").groupBy(day.alias("epoch")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / F.count("*").cast("double")).alias("f1")
    )


def rule_weights(rows: int, cols: int, salt: int) -> tuple[list[list[float]], list[float]]:
    """Layer weights from a rule, in tenths."""
    w = [[(((r + salt) * 31 + (c + 1) * 17) % 23 - 11) / 10.0 for c in range(cols)] for r in range(rows)]
    return w, [(r % 3 - 1) / 10.0 for r in range(rows)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns, to compare sums that another engine adds in another order."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
