"""Score vectors in batches and describe the predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill import fixed_values as fixed
from tonemill.functions import labels as lb
from tonemill.functions import text as tx
from tonemill.functions import vectors as vx
from tonemill.operators.sampling import sample_rows

Layer = tuple[np.ndarray, np.ndarray]


def layered_scorer(spark: SparkSession, layers: Sequence[Layer]) -> Callable[[], Callable]:
    """A scorer of dense layers with ReLU between them; one layer is a linear head.

    The weights are the model, whose size does not depend on the data; they are broadcast once.
    """
    shipped = spark.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])

    def load():
        model = shipped.value

        def predict(batch: np.ndarray) -> np.ndarray:
            x = np.asarray(batch, float)
            for i, (w, b) in enumerate(model):
                x = x @ w.T + b
                if i < len(model) - 1:
                    x = np.maximum(x, 0.0)
            return x

        return predict

    return load


def score_batches(
    df: DataFrame, load_scorer: Callable[[], Callable], dims: int, batch_size: int = 512, vec: str = "vec"
) -> DataFrame:
    """Add ``logits``. The scorer is loaded once per Python worker and sees whole Arrow batches."""
    score = predict_batch_udf(
        load_scorer, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[dims]]
    )
    return df.withColumn("logits", score(F.col(vec)))


def add_predictions(df: DataFrame, names: Sequence[str] = fixed.CLASS_NAMES) -> DataFrame:
    """From ``logits``: probabilities, predicted class, its name, its number and the confidence."""
    with_probs = df.withColumn("probs", vx.softmax(F.col("logits"))).withColumn("pred", vx.argmax(F.col("logits")))
    pred: Column = F.col("pred")
    return with_probs.withColumns(
        {
            "sentiment": lb.class_name(pred, names),
            "original_class": lb.original_class(pred),
            "confidence": vx.confidence(F.col("probs"), pred),
        }
    )


def predict_texts(df: DataFrame, model: PipelineModel, names: Sequence[str] = fixed.CLASS_NAMES) -> DataFrame:
    """Prediction records of a fitted text model: ``row_id, text, sentiment, prediction, original_class``."""
    pred = F.col("prediction").cast("int")
    return model.transform(df).select(
        "row_id",
        "text",
        lb.class_name(pred, names).alias("sentiment"),
        pred.alias("prediction"),
        lb.original_class(pred).alias("original_class"),
    )


def predict_one(spark: SparkSession, text: str, model: PipelineModel, names: Sequence[str] = fixed.CLASS_NAMES) -> str:
    """Class name of a single text."""
    one = spark.createDataFrame([(0, text)], "row_id long, text string")
    return predict_texts(one, model, names).first()["sentiment"]


def spot_check(
    scored: DataFrame,
    texts: DataFrame,
    n: int = fixed.SPOT_CHECK_ROWS,
    seed: int = fixed.DEFAULT_SEED,
    names: Sequence[str] = fixed.CLASS_NAMES,
) -> DataFrame:
    """Sampled predictions next to a preview of their text; short tables give what they have."""
    picked = sample_rows(scored.select("row_id", "y", "pred", "probs"), n, seed)
    return picked.join(texts.select("row_id", "text"), "row_id").select(
        "row_id",
        tx.preview(F.col("text")).alias("preview"),
        lb.class_name(F.col("y"), names).alias("true_name"),
        lb.class_name(F.col("pred"), names).alias("pred_name"),
        vx.confidence(F.col("probs"), F.col("pred")).alias("confidence"),
    )
