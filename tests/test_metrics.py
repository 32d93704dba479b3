import json
import math

import pytest
from pyspark.sql import functions as F

from tonemill.operators import curves as cv
from tonemill.operators import metrics as mt
from tonemill.sources import sinks as sk

# The published confusion matrix (row = true class) and the scores that follow from it.
GOLDEN = [[55739, 8351, 910], [13989, 42703, 8308], [955, 8251, 55794]]
GOLDEN_SCORES = {
    "accuracy": 0.7909538461538461, "precision": 0.7889484303620945,
    "recall": 0.7909538461538461, "f1": 0.7889881155312396,
}
GOLDEN_REPORT = {
    "0": (0.7885771684846427, 0.8575230769230769, 0.8216062439657142, 65000),
    "1": (0.7200573307478291, 0.6569692307692307, 0.6870680986283738, 65000),
    "2": (0.8582107918538115, 0.8583692307692308, 0.8582900039996308, 65000),
    "macro avg": (0.7889484303620944, 0.7909538461538462, 0.7889881155312396, 195000),
    "weighted avg": (0.7889484303620945, 0.7909538461538461, 0.7889881155312396, 195000),
}
GOLDEN_TEXT = """EVALUATION RESULTS
========================================
Accuracy: 0.7910
Precision: 0.7889
Recall: 0.7910
F1 Score: 0.7890
========================================

Classification Report:
Class Negative:
  Precision: 0.7886
  Recall: 0.8575
  F1-Score: 0.8216
  Support: 65000.0
Class Neutral:
  Precision: 0.7201
  Recall: 0.6570
  F1-Score: 0.6871
  Support: 65000.0
Class Positive:
  Precision: 0.8582
  Recall: 0.8584
  F1-Score: 0.8583
  Support: 65000.0"""


@pytest.fixture(scope="module")
def golden(spark):
    cells = [(y, p, n) for y, row in enumerate(GOLDEN) for p, n in enumerate(row)]
    wide = spark.createDataFrame(cells, "y int, pred int, n int")
    return wide.select("y", "pred", F.explode(F.sequence(F.lit(1), "n"))).select("y", "pred").cache()


def report(df):
    return {r["cls"]: r for r in mt.class_report(mt.confusion_counts(df)).collect()}


def test_golden_scores(golden):
    assert golden.count() == 195_000
    assert mt.accuracy(golden).first()["accuracy"] == pytest.approx(GOLDEN_SCORES["accuracy"], abs=1e-12)
    prf = mt.weighted_prf(mt.confusion_counts(golden)).first()
    for name in ("precision", "recall", "f1"):
        assert prf[name] == pytest.approx(GOLDEN_SCORES[name], abs=1e-12)


def test_golden_report(golden):
    rows = report(golden)
    assert set(rows) == {*GOLDEN_REPORT, "accuracy"}
    for cls, (p, r, f, n) in GOLDEN_REPORT.items():
        got = rows[cls]
        assert (got["precision"], got["recall"], got["f1"]) == pytest.approx((p, r, f), abs=1e-12)
        assert got["support"] == n
    assert rows["accuracy"]["f1"] == pytest.approx(GOLDEN_SCORES["accuracy"], abs=1e-12)


def test_golden_matrix_and_confusions(golden):
    counts = mt.confusion_counts(golden)
    matrix = mt.confusion_matrix(counts)
    assert {(r["y"], r["pred"]): r["n"] for r in matrix.collect()} == {
        (y, p): n for y, row in enumerate(GOLDEN) for p, n in enumerate(row)
    }
    top = [(r["y"], r["pred"], r["n"]) for r in mt.top_confusions(matrix).collect()]
    assert top == [(1, 0, 13989), (0, 1, 8351), (1, 2, 8308), (2, 1, 8251), (2, 0, 955)]


def test_golden_files(golden, spark, tmp_path):
    counts = mt.confusion_counts(golden)
    sk.write_lines(sk.report_lines(counts), str(tmp_path / "summary"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "summary")).collect()]
    assert "\n".join(lines) == GOLDEN_TEXT
    sk.write_json(sk.report_json(counts, 3), str(tmp_path / "json"))
    doc = json.loads(spark.read.text(str(tmp_path / "json")).first()["value"])
    assert doc["conf_matrix"] == GOLDEN
    for name, value in GOLDEN_SCORES.items():
        assert doc[name] == pytest.approx(value, abs=1e-12)
    assert set(doc["class_report"]) == {*GOLDEN_REPORT, "accuracy"}
    assert doc["class_report"]["accuracy"] == pytest.approx(GOLDEN_SCORES["accuracy"], abs=1e-12)
    assert doc["class_report"]["1"]["f1-score"] == pytest.approx(GOLDEN_REPORT["1"][2], abs=1e-12)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y int, pred int")


def test_class_only_predicted_and_class_never_predicted(spark):
    df = pairs(spark, [(0, 0), (0, 2), (1, 0)])
    rows = report(df)
    assert (rows["2"]["support"], rows["2"]["precision"], rows["2"]["recall"]) == (0, 0.0, 0.0)
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (0.0, 0.0, 0.0)
    spread = {r["cls"]: (r["true_n"], r["pred_n"]) for r in mt.class_distribution(mt.confusion_counts(df)).collect()}
    assert spread == {0: (2, 2), 1: (1, 0), 2: (0, 1)}
    dense = mt.confusion_matrix(mt.confusion_counts(df), 4).collect()
    assert len(dense) == 16 and sum(r["n"] for r in dense) == 3


@pytest.mark.parametrize("rows,value", [([(0, 0), (1, 1)], 1.0), ([(0, 1), (1, 0)], 0.0)])
def test_all_right_all_wrong(spark, rows, value):
    df = pairs(spark, rows)
    assert mt.accuracy(df).first()["accuracy"] == value
    assert mt.weighted_prf(mt.confusion_counts(df)).first()["f1"] == value


def points(spark, rows):
    """Threshold counts of (cls, score, pos) rows."""
    return cv.curve_counts(spark.createDataFrame(rows, "cls string, score double, pos int"))


def brute(rows):
    """Thresholds, counts at or above, and sizes of one class."""
    scores = sorted({s for _, s, _ in rows}, reverse=True)
    at = [(s, sum(p for _, x, p in rows if x >= s), sum(1 - p for _, x, p in rows if x >= s)) for s in scores]
    return at, sum(p for *_, p in rows), sum(1 - p for *_, p in rows)


CASES = {
    "mixed": [("a", ((i * 37) % 50) / 50, int((i * i) % 3 == 0)) for i in range(200)],
    "flat": [("a", 0.5, i % 2) for i in range(30)],
    "perfect": [("a", i / 20, int(i > 9)) for i in range(20)],
    "hot": [("a", 1.0, i % 2) for i in range(100)] + [("a", i / 100, int(i % 3 == 0)) for i in range(90)],
    "one": [("a", 0.3, 1), ("a", 0.2, 0)],
}


@pytest.mark.parametrize("name", CASES)
def test_curves_against_brute_force(spark, name):
    rows = CASES[name]
    df = points(spark, rows)
    at, p, n = brute(rows)
    full = [(0.0, 0.0)] + [(fp / n, tp / p) for _, tp, fp in at]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(full, full[1:]))
    assert cv.roc_auc(df).first()["auc"] == pytest.approx(area, abs=1e-12)

    roc = cv.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert roc[0]["threshold"] == math.inf and (roc[0]["fpr"], roc[0]["tpr"]) == (0, 0)
    steps = [(0, 0)] + [(tp, fp) for _, tp, fp in at]
    moves = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(steps, steps[1:])]
    keep = [i for i in range(len(at)) if i in (0, len(at) - 1) or moves[i] != moves[i + 1]]
    assert [r["threshold"] for r in roc[1:]] == [at[i][0] for i in keep]
    assert [r["tpr"] for r in roc[1:]] == pytest.approx([at[i][1] / p for i in keep])

    pr = cv.pr_curve(df).orderBy(F.asc_nulls_last("threshold")).collect()
    assert [r["threshold"] for r in pr] == [s for s, *_ in reversed(at)] + [None]
    assert [r["precision"] for r in pr] == pytest.approx([tp / (tp + fp) for _, tp, fp in reversed(at)] + [1.0])
    assert [r["recall"] for r in pr] == pytest.approx([tp / p for _, tp, _ in reversed(at)] + [0.0])

    ap = sum((b[1] - a[1]) * tp / (tp + fp) for a, b, (_, tp, fp) in zip(full, full[1:], at))
    assert cv.average_precision(df).first()["ap"] == pytest.approx(ap, abs=1e-12)


def test_auc_depends_on_order_only(spark):
    raw = spark.createDataFrame(CASES["mixed"], "cls string, score double, pos int")

    def auc(df):
        return cv.roc_auc(cv.curve_counts(df)).first()

    assert auc(raw) == auc(raw.withColumn("score", F.exp(F.col("score") * 5)))
    for parts in (1, 7, 64):
        assert auc(raw.repartition(parts)) == auc(raw)


@pytest.mark.parametrize("buckets", [1, 2, 50])
def test_bucketing_does_not_change_the_curve(spark, buckets, monkeypatch):
    monkeypatch.setattr(cv, "bucket_count", lambda _: buckets)
    df = points(spark, CASES["hot"])
    rows = df.orderBy(F.desc("score")).collect()
    at, p, n = brute(CASES["hot"])
    assert [(r["score"], r["tp"], r["fp"]) for r in rows] == at
    assert [r["next_pos"] for r in rows] == [r["pos"] for r in rows[1:]] + [None]
    assert [r["first"] for r in rows] == [True] + [False] * (len(rows) - 1)
    assert {(r["all_pos"], r["all_neg"]) for r in rows} == {(p, n)}


@pytest.mark.parametrize("pos", [0, 1])
def test_one_sided_curves(spark, pos):
    df = points(spark, [("a", i / 4, pos) for i in range(4)])
    assert cv.roc_auc(df).first()["auc"] is None
    assert cv.average_precision(df).first()["ap"] == pytest.approx(float(pos))
    recalls = {r["recall"] for r in cv.pr_curve(df).collect() if r["threshold"] is not None}
    assert recalls == ({1.0} if pos == 0 else {0.25, 0.5, 0.75, 1.0})


def test_binary_scores_have_two_classes(spark):
    df = spark.createDataFrame([(1, 0, [0.9, 0.1]), (2, 1, [0.4, 0.6])], "row_id long, y int, probs array<double>")
    assert {r["cls"]: r["auc"] for r in cv.roc_auc(cv.curve_counts(cv.class_points(df))).collect()} == {"0": 1.0, "1": 1.0}
    counts = cv.score_counts(cv.class_points(df))
    pooled = cv.pooled_counts(counts)
    assert cv.roc_auc(cv.running_counts(pooled)).first() == cv.roc_auc(cv.curve_counts(cv.class_points(df, micro=True))).first()


def confidences(spark, values):
    """(confidence, right?) pairs."""
    rows = [(i, 0, 0 if ok else 1, [c, c]) for i, (c, ok) in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, y int, pred int, probs array<double>")


def test_histogram_matches_numpy(spark):
    import numpy as np

    right = [0.34 + ((i * 61) % 997) / 1511 for i in range(400)]
    wrong = [0.5 + i / 40 for i in range(20)] + [0.5, 1.0]
    df = confidences(spark, [(c, True) for c in right] + [(c, False) for c in wrong])
    out = mt.confidence_histogram(df).orderBy("grp", "bin").collect()
    for name, values in (("correct", right), ("incorrect", wrong)):
        counts, edges = np.histogram(values, bins=20)
        rows = [r for r in out if r["grp"] == name]
        assert [r["n"] for r in rows] == counts.tolist()
        assert [r["bin_lo"] for r in rows] + [rows[-1]["bin_hi"]] == pytest.approx(edges.tolist())
        assert {r["group_size"] for r in rows} == {len(values)}


def test_histogram_constant_and_empty_group(spark):
    out = mt.confidence_histogram(confidences(spark, [(0.7, True)] * 3)).orderBy("grp", "bin").collect()
    right = [r for r in out if r["grp"] == "correct"]
    assert (right[0]["bin_lo"], right[-1]["bin_hi"]) == pytest.approx((0.2, 1.2)) and right[10]["n"] == 3
    wrong = [r for r in out if r["grp"] == "incorrect"]
    assert len(wrong) == 20 and sum(r["n"] for r in wrong) == 0 and wrong[-1]["bin_hi"] == 1.0


def test_epoch_loss_is_the_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "batch_id long, loss double")
    assert mt.epoch_loss(df).first()["epoch_loss"] == 6.0


def test_misclassified_samples(spark):
    df = confidences(spark, [(0.9, True), (0.2, False), (0.8, False), (0.8, False)])
    assert mt.misclassified(df).count() == 3
    assert [r["row_id"] for r in mt.misclassified_sample(df, 2, by="confidence").collect()] == [2, 3]
    assert mt.misclassified_sample(df, 5).count() == 3
    with pytest.raises(ValueError):
        mt.misclassified_sample(df, by="size")


@pytest.mark.parametrize("bad", [None, math.nan, math.inf, -math.inf])
@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_scores_that_are_no_numbers_are_refused(spark, bad, partitions):
    rows = spark.createDataFrame([(i, i % 2, [i / 40, bad if i == 7 else 0.5]) for i in range(40)], "row_id long, y int, probs array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        with pytest.raises(Exception, match="finite number"):
            cv.roc_auc(cv.curve_counts(cv.class_points(rows))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_matrix_of_the_classes_seen(spark):
    counts = spark.createDataFrame([(3, 70000, 2), (3, 3, 1)], "y int, pred int, n long")
    got = {(r["y"], r["pred"]): r["n"] for r in mt.confusion_matrix(counts).collect()}
    assert got == {(3, 3): 1, (3, 70000): 2, (70000, 3): 0, (70000, 70000): 0}
