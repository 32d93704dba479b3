import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.functions import text as tx
from tonemill.operators import cleaning as cl
from tonemill.operators import metrics as mt
from tonemill.operators import profiling as pf
from tonemill.operators import sampling as sm
from tonemill.operators import scoring as sc
from tonemill.plans.evaluate import write_evaluation
from tonemill.plans.prepare import cached_fraction, prepare_splits, save_csv
from tonemill.session import bucket_count, scratch_dir
from tonemill.sources import cache
from tonemill.sources import readers as rd
from tonemill.sources import sinks as sk
from tonemill.streaming.scoring import score_stream

CELLS = ["", None, "nan", "null", 'a "q" b', "a,b", "a\nb", "a\\b", "  padded  ", '"', "\\N?", "é"]


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, c) for i, c in enumerate(CELLS)], "row_id long, label int, text string")
    sk.write_csv(df, str(tmp_path / "csv"))
    rows = rd.read_csv(spark, str(tmp_path / "csv")).orderBy("row_id").collect()
    assert [r["text"] for r in rows] == CELLS


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_read_split_with_a_fixed_schema(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, None)], rd.MODEL_SCHEMA)
    path = str(tmp_path / fmt)
    sk.write_csv(df, path) if fmt == "csv" else df.write.format(fmt).save(path)
    back = rd.read_split(spark, path, rd.MODEL_SCHEMA, fmt)
    assert back.schema == rd.MODEL_SCHEMA
    assert sorted(map(tuple, back.collect())) == [(1, 0, "a"), (2, 1, None)]


def test_splits_are_pruned(spark, tmp_path):
    df = wide(spark, tmp_path)
    both = rd.load_splits({"train": df, "test": df.limit(0)})
    assert [(r["split"], r["n"]) for r in pf.split_counts(both).collect()] == [("train", 3000)]
    assert "Union" not in plan(both.where(F.col("split") == "train"))


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "row_id long, v string")
    assert [(r["value"], r["n"]) for r in pf.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    assert {r["value"]: r["share"] for r in pf.value_shares(df, "v").collect()} == {"a": 2 / 3, "b": 1 / 3}
    assert pf.class_count(df, "v").first()["classes"] == 3
    assert {r["column"]: r["nulls"] for r in pf.null_counts(df).collect()} == {"row_id": 0, "v": 1}
    assert {(r["column"], r["non_null"], r["dtype"]) for r in pf.column_info(df).collect()} == {
        ("row_id", 4, "bigint"), ("v", 3, "string")
    }
    assert [r["row_id"] for r in pf.head(df, 2).collect()] == [1, 2]
    assert pf.max_words(df, "v").first()["max_words"] == 1


def reviews(spark, n=90):
    rows = [(i, i % 5 + 1, None if i % 7 == 0 else f"T{i}", None if i % 11 == 0 else f"Text, no. {i}!") for i in range(n)]
    return spark.createDataFrame(rows, rd.REVIEW_SCHEMA)


def test_prepare_and_save(spark, tmp_path):
    kept = [i for i in range(90) if i % 11]
    neutral = sum(i % 5 == 2 for i in kept)
    out = prepare_splits({"train": reviews(spark), "test": reviews(spark, 30)}, {"train": {0: neutral, 2: neutral}})
    assert {r["label"]: r["count"] for r in out["train"].groupBy("label").count().collect()} == dict.fromkeys(range(3), neutral)
    save_csv(out, str(tmp_path))
    back = rd.read_csv(spark, str(tmp_path / "test"), out["test"].schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out["test"].collect()))


def test_cache_is_written_once_and_keyed_by_all_inputs(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    calls = []

    def build():
        calls.append(1)
        return {"train": df}

    key = cache.cache_key(sources=["a"], fraction=0.5, seed=1)
    for _ in range(2):
        assert cache.prepared_set(spark, str(tmp_path), key, build)["train"].count() == 40
    assert len(calls) == 1
    others = [cache.cache_key(sources=["b"], fraction=0.5, seed=1), cache.cache_key(sources=["a"], fraction=0.5, seed=2)]
    assert len({key, *others}) == 3
    half = cached_fraction(spark, str(tmp_path), {"train": df}, {"train": "x"}, 0.5)
    assert half["train"].count() == 20
    assert cached_fraction(spark, str(tmp_path), {"train": df}, {"train": "x"}, None)["train"].count() == 40


def test_scratch_dir_is_the_cluster_setting(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert bucket_count(spark) == 4


def scored(spark, n=300):
    rng = np.random.default_rng(11)
    p = rng.dirichlet(np.ones(3), size=n)
    rows = [(i, int(rng.integers(3)), int(p[i].argmax()), p[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y int, pred int, probs array<double>")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster)


def test_csv_of_single_lines_is_cut_into_tasks(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit(1).alias("label"), F.repeat(F.lit("word "), 40).alias("text"))
    sk.write_csv(rows.coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        whole = rd.read_split(spark, path, rd.MODEL_SCHEMA, "csv")
        cut = rd.read_split(spark, path, rd.MODEL_SCHEMA, "csv", multi_line=False)
        assert whole.rdd.getNumPartitions() == 1 < cut.rdd.getNumPartitions()
        assert cut.exceptAll(whole).count() == 0 and cut.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evaluation_run(spark, tmp_path):
    df = scored(spark)
    texts = df.select("row_id", F.concat(F.lit("text "), "row_id").alias("text"))
    out = write_evaluation(df, texts, str(tmp_path))
    assert out["confusion_matrix"].agg(F.sum("n")).first()[0] == 300
    assert {r["cls"] for r in out["roc_auc"].collect()} == {"0", "1", "2", "micro"}
    wrong = {r["row_id"]: r for r in df.where("y <> pred").collect()}
    examples = out["misclassified"].collect()
    assert len(examples) == 5
    for r in examples:
        names = ["Negative", "Neutral", "Positive"]
        assert (r["text"], r["true_name"], r["pred_name"]) == (f"text {r['row_id']}", names[wrong[r["row_id"]]["y"]], names[wrong[r["row_id"]]["pred"]])
    assert out["spot_check"].count() == 10
    doc = json.loads(spark.read.text(str(tmp_path / "evaluation_results")).first()["value"])
    assert doc["accuracy"] == pytest.approx(mt.accuracy(df).first()["accuracy"])


def test_stream_scores_like_a_table(spark, tmp_path):
    rows = [(i, [float(i % 3 == c) for c in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, vec array<float>")
    df.write.parquet(str(tmp_path / "in"))
    scorer = sc.layered_scorer(spark, [(np.eye(3), np.zeros(3))])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, scorer, 3, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r["row_id"]: r["pred"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: i % 3 for i in range(30)}


# Shape of the plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_has_no_shuffle_and_no_python(spark):
    text = plan(cl.prepare_reviews(reviews(spark)))
    assert "Exchange" not in text and "Python" not in text and "Pandas" not in text


def wide(spark, tmp_path):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"), F.repeat(F.lit("text "), 50).alias("text")
    )
    return sk.store(df, str(tmp_path / "wide"))


@pytest.mark.parametrize("take", [
    lambda df: sm.stratified_sample(df, 0.3),
    lambda df: sm.balance_classes(df, {0: 10}),
    lambda df: sm.train_test_split(df),
])
def test_sampling_only_filters_the_wide_rows(spark, tmp_path, take):
    text = plan(take(wide(spark, tmp_path)))
    assert "Window" not in text and "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert text.count("Exchange") == text.count("BroadcastExchange")


def test_curves_have_no_window_over_a_whole_class(spark):
    by_class_only = [
        line for line in plan(cv_run(scored(spark))).splitlines() if re.search(r"Window .*, \[cls#\d+\](, \[bucket|$)", line)
    ]
    # Only the table of buckets is windowed by class alone.
    assert by_class_only and all("b_pos" in line or "top" in line for line in by_class_only)


def cv_run(df):
    from tonemill.operators import curves as cv

    return cv.curve_counts(cv.class_points(df))


def test_scan_reads_only_needed_columns(spark, tmp_path):
    df = wide(spark, tmp_path)
    text = plan(pf.value_counts(df, "label"))
    assert "ReadSchema: struct<label:int>" in text
    assert "ReadSchema: struct<text:string>" in plan(df.select(tx.clean_text(F.col("text"))))


def test_a_wrong_header_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, "good, or not"), (2, "line\nbreak")], "label int, text string")
    sk.write_csv(rows, str(tmp_path / "csv"))
    with pytest.raises(Exception, match="(?i)header"):
        rd.read_csv(spark, str(tmp_path / "csv")).collect()
    raw = rd.read_csv(spark, str(tmp_path / "csv"), rd.RAW_MODEL_SCHEMA)
    assert raw.count() == 2 and sorted(r["text"] for r in raw.select("text").collect()) == ["good, or not", "line\nbreak"]
    numbered = sk.number_rows(raw, str(tmp_path / "numbered"))
    assert numbered.columns == ["row_id", "label", "text"]
    assert len({r["row_id"] for r in numbered.collect()}) == 2 and numbered.collect() == numbered.collect()


def test_single_line_csv_is_cut_into_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("row_id"), F.lit(1).alias("label"), F.lit("a, b").alias("text"))
    sk.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, rd.read_csv(spark, str(tmp_path / "csv"), multi_line=False).collect())) == [(i, 1, "a, b") for i in range(200)]
