"""Fit a classification head on pooled vectors or on text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.operators.backprop import Layer

# Number of the bias among the weights of a class.
BIAS_INDEX = -1


def fit_head(vectors: DataFrame, max_iter: int = 50, reg: float = 0.0) -> LogisticRegressionModel:
    """Linear head with softmax cross-entropy on ``(vec, label)``: the convex problem, solved by Spark ML.

    Gradients are summed on the executors in a tree; the driver holds classes x dims weights.
    """
    ready = vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(ready)


def head_weights(spark: SparkSession, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """Weights as ``(cls, idx, w)``; the bias has index -1."""
    rows = [(c, BIAS_INDEX, float(b)) for c, b in enumerate(bias)]
    rows += [(c, i, float(w)) for c, row in enumerate(weights) for i, w in enumerate(row)]
    return spark.createDataFrame(rows, "cls int, idx int, w double")


def weights_from_table(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Read ``(cls, idx, w)`` back; the table is a model, classes x (dims + 1) numbers."""
    wide = table.toPandas().pivot(index="cls", columns="idx", values="w").sort_index()
    return wide.drop(columns=BIAS_INDEX).sort_index(axis=1).to_numpy(), wide[BIAS_INDEX].to_numpy()


def layer_weights(spark: SparkSession, layers: Sequence[Layer]) -> DataFrame:
    """Weights of all layers as ``(layer, cls, idx, w)``; a bias has index -1."""
    parts = [head_weights(spark, w, b).withColumn("layer", F.lit(i)) for i, (w, b) in enumerate(layers)]
    return reduce(DataFrame.unionByName, parts).select("layer", "cls", "idx", "w")


def fit_text(docs: DataFrame, features: int = 1 << 18, max_iter: int = 20, reg: float = 0.01) -> PipelineModel:
    """Fit text to class on ``(text, label)``: tokens, hashed counts, inverse document frequency, linear head.

    Hashing needs no vocabulary pass and bounds the model whatever the corpus holds. Texts are cut and counted
    once; the later passes read the persisted counts.
    """
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+")
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=features)
    ready = docs.select("text", F.col("label").cast("double").alias("label"))
    counts = hashed.transform(words.transform(ready)).select("label", "counts").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weighting = IDF(inputCol="counts", outputCol="features").fit(counts)
        head = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(weighting.transform(counts))
    finally:
        counts.unpersist()
    return PipelineModel(stages=[words, hashed, weighting, head])
