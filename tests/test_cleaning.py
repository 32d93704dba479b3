import re

import pytest
from pyspark.sql import functions as F

from tonemill.functions import labels as lb
from tonemill.functions import text as tx
from tonemill.operators import cleaning as cl

EDGES = [
    "", "   ", "http", "xhttpfoo bar", "see https://a.b/c?d=e\u00a0next",
    "a\u00a0b\u2003c\u0085d\u001ce\u200bf\u3000g\u2028h",
    "a-b", "Caf\u00e9_\u00fc", "\u212aelvin", "\u0130stanbul", " A  B\n\tC ", "http://x http://y z", "\U0001f600 ok",
]


CLEANED = [
    "", "", "http", "x bar", "see next",
    "a b c d ef g h",
    "ab", "caf", "kelvin", "istanbul", "a b c", "z", "ok",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id long, v {kind}")


def mapped(df, expr):
    return [r["o"] for r in df.select("row_id", expr.alias("o")).orderBy("row_id").collect()]


def test_clean_text_reads_blanks_as_unicode(spark):
    got = mapped(column(spark, EDGES), tx.clean_text(F.col("v")))
    assert got == CLEANED


def test_clean_text_is_idempotent_and_keeps_null(spark):
    df = column(spark, [*EDGES, None]).select("row_id", tx.clean_text(F.col("v")).alias("v"))
    assert mapped(df, tx.clean_text(F.col("v"))) == mapped(df, F.col("v"))
    assert mapped(df, F.col("v"))[-1] is None


def test_whole_text_is_cleaned(spark):
    long = "A-b http://q " * 50_000
    assert mapped(column(spark, [long]), tx.clean_text(F.col("v"))) == ["ab " * 49_999 + "ab"]


def test_word_count(spark):
    assert mapped(column(spark, EDGES), tx.word_count(F.col("v"))) == [len(re.findall(r"\w+", t)) for t in EDGES]


def test_preview_marks_only_cut_text(spark):
    got = mapped(column(spark, ["x" * 100, "y" * 101]), tx.preview(F.col("v")))
    assert got == ["x" * 100, "y" * 100 + "..."]


def test_labels(spark):
    df = column(spark, [0, 1, 2, 3, 4, 5, 6, None], "int")
    assert mapped(df, lb.sentiment_of_stars(F.col("v"))) == [0, 0, 0, 1, 2, 2, 0, 0]
    assert mapped(df, lb.class_name(F.col("v"))) == ["Negative", "Neutral", "Positive"] + ["Unknown"] * 5
    assert mapped(column(spark, [-1, -2], "int"), lb.class_name(F.col("v"))) == ["Unknown", "Unknown"]


def test_class_names_from_a_list():
    assert lb.names_from_list("Negative, Neutral,Positive") == ["Negative", "Neutral", "Positive"]


def test_prepare_reviews(spark):
    rows = [(1, 5, None, "Great!"), (2, None, "t", "x"), (3, 1, "T", None), (4, 3, "", "So-So")]
    df = spark.createDataFrame(rows, "row_id long, class_index int, review_title string, review_text string")
    out = cl.prepare_reviews(df)
    assert set(out.columns) == {"row_id", "label", "text"}
    assert sorted((r["row_id"], r["label"], r["text"]) for r in out.collect()) == [(1, 5, "great"), (4, 3, "soso")]


def test_cast_strict_and_lenient(spark):
    df = column(spark, ["1", "x", None])
    lenient = cl.cast_columns(df, {"v": "int"}, strict=False).orderBy("row_id").collect()
    assert [r["v"] for r in lenient] == [1, None, None]
    with pytest.raises(Exception, match="cannot cast v"):
        cl.cast_columns(df, {"v": "int"}).collect()


@pytest.mark.parametrize("train,shift", [([1, 2], 1), ([0, 1], 0), ([2, 3], 0), ([None, 1], 1)])
def test_zero_base_is_decided_on_train(spark, train, shift):
    t = column(spark, train, "int").withColumnRenamed("v", "label")
    o = column(spark, [0, 5], "int").withColumnRenamed("v", "label")
    out = cl.zero_base_labels(t, {"test": o})
    assert [r["label"] for r in out["test"].orderBy("row_id").collect()] == [0 - shift, 5 - shift]


def test_guards(spark):
    good, bad = cl.guard_labels(column(spark, [-1, 0, 2, 3, None], "int"), 3, "v")
    assert (good.count(), bad.first()["rejected"]) == (2, 3)
    good, bad = cl.guard_nan(column(spark, [[1.0], [float("nan")], None], "array<double>"), "v")
    assert (good.count(), bad.first()["rejected"]) == (2, 1)
