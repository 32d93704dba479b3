"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemill.functions import labels as lb
from tonemill.functions import text as tx
from tonemill.functions import vectors as vx
from tonemill.operators import cleaning as cl
from tonemill.operators import curves as cv
from tonemill.operators import encoding as en
from tonemill.operators import fitting as ft
from tonemill.operators import history as hs
from tonemill.operators import metrics as mt
from tonemill.operators import profiling as pf
from tonemill.operators import sampling as sm
from tonemill.operators import permutation as pm
from tonemill.operators import scoring as sc
from tonemill.operators import training as tr
from tonemill.plans import adapters as ad
from tonemill.plans.adapters import rounded
from tonemill.plans.evaluate import write_evaluation
from tonemill.plans.prepare import cached_fraction, prepare_splits, save_csv
from tonemill.plans.train import save_fit, train_head
from tonemill.session import scratch_dir
from tonemill.sources import readers as rd
from tonemill.sources import sinks as sk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCAB_SIZE = 30_000
MAX_LENGTH = 512
# 50 epochs at most, batches of 64 rows a shard
EPOCHS = tr.EpochSettings(shards=4, learning_rate=0.1, epochs_ahead=5)
HIDDEN = [64, 32]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query
def load_splits(spark, sf):
    test = ad.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return rd.load_splits({"train": ad.documents(spark, sf), "test": test})


@query
def csv_scan(spark, sf):
    path = _scratch(spark, "csv_scan")
    rows = ad.documents(spark, sf).select("row_id", (F.col("row_id") % 3).cast("int").alias("label"), "text")
    sk.write_csv(rows, path)
    return rd.read_csv(spark, path)


@query
def csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv_roundtrip")
    sk.write_csv(ad.reviews(spark, sf), path)
    return rd.read_csv(spark, path, rd.REVIEW_SCHEMA)


@query
def csv_reviews(spark, sf):
    """Reviews as they are published, without row numbers: read, numbered once, and the rows that share a number."""
    path = _scratch(spark, "csv_reviews")
    sk.write_csv(ad.reviews(spark, sf).drop("row_id"), path)
    numbered = sk.number_rows(rd.read_csv(spark, path, rd.RAW_REVIEW_SCHEMA), _scratch(spark, "numbered"))
    alike = F.count("*").over(Window.partitionBy("row_id"))
    return numbered.select("class_index", "review_title", "review_text", alike.alias("rows_of_id"))


@query
def prepared_cache(spark, sf):
    def read():
        splits = {"train": ad.labelled(spark, sf)}
        return cached_fraction(spark, scratch_dir(spark), splits, {"train": sf}, 0.1, version=spark.sparkContext.applicationId)

    read()
    return read()["train"]


REPORT = """accuracy double, precision double, recall double, f1 double, conf_matrix array<array<bigint>>,
    class_report map<string, string>"""
ENTRY = "precision double, recall double, `f1-score` double, support double"


@query
def eval_report_json(spark, sf):
    """The result document, written and read back: overall scores, matrix rows and one row per report entry."""
    path = _scratch(spark, "report")
    sk.write_json(sk.report_json(mt.confusion_counts(ad.scored(spark, sf)), 3), path)
    document = spark.read.text(path).select(F.from_json("value", REPORT).alias("d")).select("d.*")
    rows = F.transform("conf_matrix", lambda row: F.array_join(row.cast("array<string>"), ","))
    entries = document.select(
        "accuracy", "precision", "recall", "f1", F.array_join(rows, ";").alias("conf_matrix"),
        F.explode("class_report").alias("entry", "said"),
    ).withColumn("scores", F.when(F.col("entry") != "accuracy", F.from_json("said", ENTRY)))
    alone = F.when(F.col("entry") == "accuracy", F.expr("try_cast(said AS double)"))
    return rounded(
        entries.select(
            "accuracy", "precision", "recall", "f1", "conf_matrix", "entry",
            F.col("scores.precision").alias("entry_precision"), F.col("scores.recall").alias("entry_recall"),
            F.coalesce(F.col("scores").getField("f1-score"), alone).alias("entry_f1"), F.col("scores.support").alias("entry_support"),
        )
    )


@query
def eval_summary(spark, sf):
    return sk.report_lines(mt.confusion_counts(ad.scored(spark, sf)))


def _text_model(spark, sf):
    return ft.fit_text(ad.labelled_documents(spark, sf))


@query
def model_roundtrip(spark, sf):
    docs, model = ad.labelled_documents(spark, sf), _text_model(spark, sf)
    path = _scratch(spark, "model")
    sk.save_model(model, path)
    loaded = sk.load_model(path)
    once = model.transform(docs).select("text", F.col("prediction").alias("before"))
    both = loaded.transform(once)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("prediction")).alias("mismatches"))


# Profiling


@query
def head_rows(spark, sf):
    return pf.head(ad.ratings(spark, sf), 5)


@query
def split_counts(spark, sf):
    return pf.split_counts(load_splits(spark, sf))


@query
def null_counts(spark, sf):
    return pf.null_counts(ad.reviews(spark, sf))


@query
def column_info(spark, sf):
    return pf.column_info(ad.reviews(spark, sf))


@query
def value_counts(spark, sf):
    return pf.value_counts(ad.ratings(spark, sf), "class_index")


@query
def value_shares(spark, sf):
    return pf.value_shares(ad.reviews(spark, sf), "review_title")


@query
def class_count(spark, sf):
    return pf.class_count(ad.reviews(spark, sf), "review_title")


@query
def max_words(spark, sf):
    return pf.max_words(ad.documents(spark, sf))


# Projection, cleaning, labels


@query
def drop_null_reviews(spark, sf):
    return cl.drop_null_reviews(ad.reviews(spark, sf))


@query
def fill_titles(spark, sf):
    return cl.fill_titles(ad.reviews(spark, sf)).select("row_id", "review_title")


@query
def title_text(spark, sf):
    return cl.add_text(cl.fill_titles(ad.reviews(spark, sf))).select("row_id", "text")


@query
def lower_text(spark, sf):
    return ad.documents(spark, sf).select("row_id", F.lower("text").alias("text"))


@query
def strip_urls(spark, sf):
    """Page addresses in front of page text: the tables' one source of URLs."""
    page = ad.table(spark, sf, "pages")
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" "), F.col("html"))
    return page.select(F.col("page_id").alias("row_id"), tx.strip_urls(text).alias("text"))


@query
def strip_chars(spark, sf):
    return ad.documents(spark, sf).select("row_id", tx.strip_junk(F.col("text")).alias("text"))


@query
def squeeze_spaces(spark, sf):
    return ad.documents(spark, sf).select("row_id", tx.squeeze_blanks(F.col("text")).alias("text"))


@query
def clean_text(spark, sf):
    return ad.documents(spark, sf).select("row_id", tx.clean_text(F.col("text")).alias("text"))


def _with_texts(spark, sf):
    return cl.add_clean_text(cl.add_text(cl.fill_titles(cl.drop_null_reviews(ad.reviews(spark, sf)))))


@query
def drop_columns(spark, sf):
    return cl.drop_raw_columns(_with_texts(spark, sf))


@query
def rename_columns(spark, sf):
    return cl.rename_model_columns(drop_columns(spark, sf))


@query
def cast_columns(spark, sf):
    priorities = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.substring("o_orderpriority", 1, 1).alias("label"),
        F.col("o_custkey").alias("text"),
    )
    return cl.cast_columns(priorities, {"label": "int", "text": "string"})


@query
def map_labels(spark, sf):
    return cl.map_labels(ad.ratings(spark, sf), "class_index")


@query
def zero_base_labels(spark, sf):
    train = ad.ratings(spark, sf).withColumnRenamed("class_index", "label")
    test = ad.reviews(spark, sf).select("row_id", F.col("class_index").alias("label"))
    return rd.load_splits(cl.zero_base_labels(train, {"test": test}))


@query
def class_slice(spark, sf):
    return cl.class_slice(ad.labelled(spark, sf), 1)


@query
def label_guard(spark, sf):
    good, rejected = cl.guard_labels(ad.ratings(spark, sf), 4, "class_index")
    kept = good.groupBy("class_index").agg(F.count("*").alias("n"))
    return kept.unionByName(rejected.select(F.lit(-1).alias("class_index"), F.col("rejected").alias("n")))


@query
def nan_guard(spark, sf):
    nan = F.lit(float("nan"))
    broken = ad.scored(spark, sf).withColumn(
        "logits", F.when(F.col("row_id") % 13 == 0, F.array(nan, F.lit(0.0), F.lit(1.0))).otherwise(F.col("logits"))
    )
    good, rejected = cl.guard_nan(broken)
    kept = good.groupBy("y").agg(F.count("*").alias("n"))
    return kept.unionByName(rejected.select(F.lit(-1).alias("y"), F.col("rejected").alias("n")))


@query
def text_preview(spark, sf):
    return ad.documents(spark, sf).select("row_id", tx.preview(F.col("text")).alias("preview"))


# Sampling, splitting, ordering, batching


@query
def balance_classes(spark, sf):
    return sm.balance_to_class(ad.labelled(spark, sf), 1)


@query
def union_slices(spark, sf):
    rows = ad.labelled(spark, sf)
    return sm.union_slices([cl.class_slice(rows, c) for c in (2, 0, 1)])


@query
def stratified_sample(spark, sf):
    return sm.stratified_sample(ad.labelled(spark, sf), 0.1)


@query
def train_test_split(spark, sf):
    return sm.train_test_split(ad.labelled(spark, sf))


@query
def random_split(spark, sf):
    return sm.train_test_split(ad.labelled(spark, sf), group=None)


@query
def epoch_order(spark, sf):
    return sm.epoch_order(ad.labelled(spark, sf), epoch=1).select("row_id", "label", "pos")


@query
def epoch_permutation(spark, sf):
    """The order of three epochs as a projection of rows that are numbered once."""
    path = _scratch(spark, "numbered")
    rows = sk.store(sm.with_natural_order(ad.labelled(spark, sf)), path).withColumn("epoch", F.explode(F.lit([1, 2, 3])))
    return rows.select("row_id", "epoch", pm.permuted(F.col("pos"), F.col("total"), F.concat(F.lit("42:"), F.col("epoch").cast("string"))).alias("place"))


@query
def shard_rows(spark, sf):
    rows = ad.labelled(spark, sf).select("row_id")
    dropped = sm.shard_rows(sm.epoch_order(rows, epoch=0), 7, "drop").withColumn("mode", F.lit("drop"))
    padded = sm.shard_rows(sm.with_natural_order(rows), 7, "pad").withColumn("mode", F.lit("pad"))
    return sm.union_slices([dropped, padded]).select("mode", "row_id", "pos", "shard")


@query
def batch_rows(spark, sf):
    return sm.batch_rows(sm.epoch_order(ad.labelled(spark, sf)), 64).select("row_id", "pos", "batch_id")


@query
def sample_rows(spark, sf):
    return sm.sample_rows(ad.labelled(spark, sf), 10)


# Encoding and vectors


def _clean_documents(spark, sf):
    return ad.documents(spark, sf).select("row_id", tx.clean_text(F.col("text")).alias("text"))


@query
def build_vocab(spark, sf):
    return en.build_vocab(_clean_documents(spark, sf), VOCAB_SIZE)


@query
def encode_text(spark, sf):
    # Vocabulary and encoding both read the cleaned texts, so these are cleaned once and stored.
    docs = sk.store(_clean_documents(spark, sf), _scratch(spark, "clean"))
    coded = en.encode_text(docs, en.build_vocab(docs, VOCAB_SIZE), MAX_LENGTH)
    return coded.select(
        "row_id", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")]
    )


def _long(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query
def max_pool(spark, sf):
    return rounded(_long(en.max_pool(ad.tokens(spark, sf), ad.DIMS)))


@query
def first_pool(spark, sf):
    return _long(en.first_pool(ad.tokens(spark, sf)))


def _logit_columns(df: DataFrame, n: int) -> DataFrame:
    return rounded(df.select("row_id", *[F.get("logits", F.lit(i)).alias(f"logit_{i}") for i in range(n)]))


@query
def linear_logits(spark, sf):
    w, b = ad.rule_weights(3, ad.DIMS, 1)
    rows = ad.vectors(spark, sf).select("row_id", vx.linear_logits(F.col("vec"), w, b).alias("logits"))
    return _logit_columns(rows, 3)


@query
def mlp_logits(spark, sf):
    layers = [ad.rule_weights(32, ad.DIMS, 1), ad.rule_weights(16, 32, 2), ad.rule_weights(3, 16, 3)]
    return _logit_columns(sc.score_batches(ad.vectors(spark, sf), sc.layered_scorer(spark, layers), ad.DIMS), 3)


# Scoring


@query
def score_batches(spark, sf):
    scorer = sc.layered_scorer(spark, [ad.rule_weights(ad.VECTOR_CLASSES, ad.DIMS, 1)])
    return _logit_columns(sc.score_batches(ad.vectors(spark, sf), scorer, ad.DIMS), ad.VECTOR_CLASSES)


@query
def softmax(spark, sf):
    probs = ad.scored(spark, sf).select("row_id", vx.softmax(F.col("logits")).alias("p"))
    return rounded(probs.select("row_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3)]))


@query
def argmax(spark, sf):
    return ad.scored(spark, sf).select("row_id", vx.argmax(F.col("logits")).alias("pred"))


@query
def class_names(spark, sf):
    stars = ad.ratings(spark, sf)
    return stars.select("row_id", lb.class_name(F.col("class_index") - 1).alias("sentiment"))


@query
def original_class(spark, sf):
    return ad.scored(spark, sf).select("row_id", lb.original_class(F.col("pred")).alias("original_class"))


@query
def confidence(spark, sf):
    return ad.scored(spark, sf).select("row_id", vx.confidence(F.col("probs"), F.col("pred")).alias("confidence"))


@query
def score_one(spark, sf):
    """One sampled document through a model fitted on all labelled ones."""
    model = _text_model(spark, sf)
    one = sm.sample_rows(ad.documents(spark, sf), 1)
    return sc.predict_texts(one, model, ["low", "high"])


@query
def spot_check(spark, sf):
    return sc.spot_check(ad.scored_documents(spark, sf), ad.documents(spark, sf))


# Loss and metrics


@query
def row_loss(spark, sf):
    return rounded(mt.row_loss(ad.scored(spark, sf)).select("row_id", "loss"))


@query
def epoch_loss(spark, sf):
    ordered = sm.batch_rows(sm.epoch_order(ad.scored(spark, sf)), 64, drop_last=False)
    return rounded(mt.epoch_loss(mt.row_loss(ordered)))


def _counts(spark, sf):
    return mt.confusion_counts(ad.scored(spark, sf))


@query
def accuracy(spark, sf):
    return mt.accuracy(ad.scored(spark, sf))


@query
def weighted_prf(spark, sf):
    return rounded(mt.weighted_prf(_counts(spark, sf)))


@query
def class_report(spark, sf):
    return rounded(mt.class_report(_counts(spark, sf)))


@query
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(_counts(spark, sf), 4)


@query
def top_confusions(spark, sf):
    return mt.top_confusions(mt.confusion_matrix(_counts(spark, sf), 3))


@query
def one_vs_rest(spark, sf):
    return mt.one_vs_rest(ad.scored(spark, sf))


def _run(spark, sf, micro=False):
    """Scores are counted once; edges, totals and rows are read from the stored counts."""
    points = cv.class_points(ad.scored(spark, sf), micro)
    return cv.running_counts(sk.store(cv.score_counts(points), _scratch(spark, "counts")))


def _both(spark, sf):
    points = cv.class_points(ad.scored(spark, sf))
    counts = sk.store(cv.score_counts(points), _scratch(spark, "counts"))
    return cv.running_counts(counts.unionByName(cv.pooled_counts(counts)), counts)


@query
def roc_curve(spark, sf):
    return rounded(cv.roc_curve(_run(spark, sf)))


@query
def roc_micro(spark, sf):
    return rounded(cv.roc_curve(_run(spark, sf, micro=True)))


@query
def roc_auc(spark, sf):
    return cv.roc_auc(_both(spark, sf))


@query
def pr_curve(spark, sf):
    return rounded(cv.pr_curve(_both(spark, sf)))


@query
def average_precision(spark, sf):
    return rounded(cv.average_precision(_both(spark, sf)))


@query
def class_distribution(spark, sf):
    return mt.class_distribution(_counts(spark, sf))


@query
def metric_table(spark, sf):
    return rounded(mt.metric_table(_counts(spark, sf)))


@query
def confidence_histogram(spark, sf):
    return rounded(mt.confidence_histogram(ad.scored(spark, sf)))


@query
def misclassified(spark, sf):
    return mt.misclassified(ad.scored(spark, sf)).select("row_id", "y", "pred")


@query
def misclassified_sample(spark, sf):
    return mt.error_examples(ad.scored_documents(spark, sf), ad.documents(spark, sf))


@query
def confident_errors(spark, sf):
    return mt.error_examples(ad.scored_documents(spark, sf), ad.documents(spark, sf), by="confidence")


# Fitting and model selection


@query
def fit_head(spark, sf):
    rows = ad.vectors(spark, sf)
    model = ft.fit_head(rows, max_iter=100)
    head = [(model.coefficientMatrix.toArray(), model.interceptVector.toArray())]
    scored = sc.score_batches(rows, sc.layered_scorer(spark, head), ad.DIMS)
    return scored.select("row_id", F.col("label").alias("y"), vx.argmax(F.col("logits")).alias("pred"))


@query
def fit_text(spark, sf):
    docs, model = ad.labelled_documents(spark, sf), _text_model(spark, sf)
    return model.transform(docs).select("row_id", F.col("label").alias("y"), F.col("prediction").cast("int").alias("pred"))


@query
def fit_epochs(spark, sf):
    result = train_head(ad.vectors(spark, sf), ad.VECTOR_CLASSES, ad.DIMS, EPOCHS)
    return ft.layer_weights(spark, result.best or result.last).drop("layer")


@query
def epoch_history(spark, sf):
    return train_head(ad.vectors(spark, sf), ad.VECTOR_CLASSES, ad.DIMS, EPOCHS).history_table(spark)


@query
def fit_mlp(spark, sf):
    """Hidden layers trained on the stored vectors, with the state of the run kept in the shared folder."""
    state = _scratch(spark, "state")
    settings = replace(EPOCHS, learning_rate=0.02, dropout=0.1)
    result = train_head(ad.vectors(spark, sf), ad.VECTOR_CLASSES, ad.DIMS, settings, hidden=HIDDEN, state_folder=state)
    return ft.layer_weights(spark, result.best or result.last)


@query
def early_stop(spark, sf):
    return hs.early_stop(ad.history(spark, sf), "f1", delta=0.001)


@query
def best_epoch(spark, sf):
    return hs.best_epoch(ad.history(spark, sf))


# Whole jobs


@query
def prepare_job(spark, sf):
    """Reviews of two splits cleaned, mapped to classes, capped, written as CSV and read back."""
    reviews = ad.reviews(spark, sf)
    splits = {"train": reviews, "test": reviews.where(F.col("row_id") % 4 == 0)}
    ready = prepare_splits(splits, {"train": {0: 30, 2: 30}}, allow_short=True)
    folder = _scratch(spark, "prepared")
    save_csv(ready, folder)
    return rd.load_splits({name: rd.read_split(spark, f"{folder}/{name}", rd.MODEL_SCHEMA, "csv") for name in ready})


@query
def evaluate_job(spark, sf):
    """All tables of an evaluation written and read back; the figures of some as ``(name, key, value)``."""
    scored = ad.scored(spark, sf)
    texts = scored.select("row_id", F.concat(F.lit("order "), F.col("row_id").cast("string")).alias("text"))
    written = write_evaluation(scored, texts, _scratch(spark, "evaluation"))
    figures = [
        written["class_report"].select(F.lit("class_report").alias("name"), F.col("cls").alias("key"), F.col("f1").alias("value")),
        written["confusion_matrix"].select(
            F.lit("confusion_matrix").alias("name"),
            F.concat_ws("-", F.col("y").cast("string"), F.col("pred").cast("string")).alias("key"),
            F.col("n").cast("double").alias("value"),
        ),
        written["roc_auc"].select(F.lit("roc_auc").alias("name"), F.col("cls").alias("key"), F.col("auc").alias("value")),
        written["average_precision"].select(F.lit("average_precision").alias("name"), F.col("cls").alias("key"), F.col("ap").alias("value")),
    ]
    return rounded(sm.union_slices(figures))


@query
def train_job(spark, sf):
    """A head trained, saved with its history, read back and used on all vectors."""
    rows, folder = ad.vectors(spark, sf), _scratch(spark, "trained")
    save_fit(train_head(rows, ad.VECTOR_CLASSES, ad.DIMS, replace(EPOCHS, epochs=5)), rows, folder)
    w, b = ft.weights_from_table(spark.read.parquet(f"{folder}/final").drop("layer"))
    scored = sc.score_batches(rows, sc.layered_scorer(spark, [(w, b)]), ad.DIMS)
    return scored.select("row_id", F.col("label").alias("y"), vx.argmax(F.col("logits")).alias("pred"))
