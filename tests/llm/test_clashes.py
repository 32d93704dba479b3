"""Columns named like results, ids beyond 2^53 beside null ids, empty tables: through operators and pipeline stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import FOLDER
from tonemill.llm import brown, jaccard, quality, toxicity, winnow
from tonemill.llm.common import table

BIG = (1 << 60) + 1
NAMES = ["score", "held_out", "predicted", "items", "spans", "_words", "_row", "_doc", "_prints", "n_hit", "_id", "row"]


def awkward(spark):
    docs = table(spark, FOLDER, "documents").limit(40)
    odd = spark.createDataFrame(
        [(BIG, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (BIG, "a b c d e f g"), (BIG + 2, ""), (None, "x " * 20_000)], "doc_id long, text string"
    ).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    return docs.unionByName(odd).select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_rows_as_they_are(spark, name, stage):
    docs = awkward(spark)
    got = stage(spark, docs, FOLDER)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    whole = {tuple(r) for r in docs.collect()}
    assert rows and {tuple(r) for r in rows} <= whole
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_last_stage_with_clashing_columns(spark):
    rows = corpus_pipeline.encode(spark, awkward(spark), FOLDER).collect()
    assert len(rows) == 46


def test_operators_with_clashing_columns(spark):
    docs = awkward(spark)
    names = docs.columns
    labels = table(spark, FOLDER, "labels")
    ids = sorted(str(r["doc_id"]) for r in docs.collect())
    found = winnow.find_contamination(docs, table(spark, FOLDER, "benchmark"), names)
    assert set(found.columns) == set(names) | set(winnow.OUTPUTS)
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ids and all(r["_words"] == "own _words" and r["items"] != "own items" for r in rows)
    for scored in (
        quality.score_quality(docs, quality.fit_quality(docs, labels), names),
        toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), names),
    ):
        rows = scored.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == ids
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["_row"] == "own _row" for r in rows)
        by_text = {}
        assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in rows)


def test_ids_keep_their_digits_beside_nulls(spark):
    docs = awkward(spark)
    ids = sorted(str(r["doc_id"]) for r in docs.collect())
    classes = jaccard.jaccard_components(docs).collect()
    assert sorted(str(r["doc_id"]) for r in classes) == ids
    assert {str(r["component_id"]) for r in classes} <= set(ids)
    assert sorted(str(r["doc_id"]) for r in brown.score_brown(docs).collect()) == ids


def test_one_of_each_group_stays_whatever_the_ids(spark):
    same, near = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y 9"
    rows = [(BIG, same), (BIG, same), (None, same), (BIG + 1, near), (None, "one two three"), (None, "one two three"), (None, None), (None, None), (3, ""), (BIG, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(BIG, same), (None, "one two three"), (None, None), (None, None), (3, ""), (BIG, "quite another text")]))
