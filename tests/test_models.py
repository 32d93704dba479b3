import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.functions import vectors as vx
from tonemill.operators import backprop as bp
from tonemill.operators import encoding as en
from tonemill.operators import fitting as ft
from tonemill.operators import history as hs
from tonemill.operators import scoring as sc
from tonemill.sources import sinks as sk

TEXTS = {1: "a b a c", 2: "", 3: "b z a", 4: "a " * 50, 5: "q q q"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "row_id long, text string")


def test_vocab_order_and_ids(spark, docs):
    rows = en.build_vocab(docs, 3).orderBy("id").collect()
    assert [(r["token"], r["n"], r["id"]) for r in rows] == [("a", 53, 4), ("q", 3, 5), ("b", 2, 6)]


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(en, "CHUNK_ROWS", 2)


def test_encode_awkward_rows(spark, docs, small_chunks):
    vocab = en.build_vocab(docs, 3)
    rows = spark.createDataFrame([(1, "a b"), (1, "q"), (None, "a"), (2, None), (3, ""), (3, "a b")], "row_id long, text string")
    got = sorted((str(r["row_id"]), str(r["text"]), str(r["input_ids"])) for r in en.encode_text(rows, vocab, 4).collect())
    assert got == sorted(
        [
            ("1", "a b", "[2, 4, 6, 3]"), ("1", "q", "[2, 5, 3, 0]"), ("None", "a", "[2, 4, 3, 0]"),
            ("2", "None", "None"), ("3", "", "[2, 3, 0, 0]"), ("3", "a b", "[2, 4, 6, 3]"),
        ]
    )
    assert en.encode_text(rows.limit(0), vocab, 4).count() == 0


@pytest.mark.parametrize("length", [2, 3, 8])
def test_encode(spark, docs, length, small_chunks):
    vocab = en.build_vocab(docs, 3)
    known = {"a": 4, "q": 5, "b": 6}
    rows = en.encode_text(docs, vocab, length).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = [2] + [known.get(t, 1) for t in TEXTS[r["row_id"]].split()[: length - 2]] + [3]
        gap = length - len(ids)
        assert r["input_ids"] == ids + [0] * gap
        assert r["attention_mask"] == [1] * len(ids) + [0] * gap
        assert r["token_type_ids"] == [0] * length


def test_encode_with_a_million_tokens(spark):
    vocab = spark.range(1_000_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 4).cast("int").alias("id"))
    # wide rows of other types go through; a third of all tokens is one token
    text = F.concat_ws(" ", F.lit("w7"), F.concat(F.lit("w"), (F.col("id") * 997) % 1_100_000), F.lit("w7"))
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("row_id"), "id", text.alias("text"), F.array(F.lit(1.5)).alias("x"), F.struct("id").alias("s"))
    got = en.encode_text(rows, vocab, 6).collect()
    assert len(got) == 3000
    for r in got:
        n = r["id"] * 997 % 1_100_000
        assert r["input_ids"] == [2, 11, n + 4 if n < 1_000_000 else 1, 11, 3, 0] and r["x"] == [1.5] and r["s"]["id"] == r["id"]


def test_encode_with_an_empty_vocab(spark, docs):
    none = spark.createDataFrame([], "token string, n long, id int")
    ids = {r["row_id"]: r["input_ids"] for r in en.encode_text(docs, none, 5).collect()}
    assert ids[3] == [2, 1, 1, 1, 3] and ids[2] == [2, 3, 0, 0, 0]


def test_pooling(spark):
    rows = [(1, 0, 1, [1.0, -5.0]), (1, 1, 1, [0.0, 7.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 0, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "row_id long, pos int, mask int, vec array<float>")
    assert {r["row_id"]: r["vec"] for r in en.max_pool(df, 2).collect()} == {1: [1.0, 7.0], 2: [-1e9, -1e9]}
    assert {r["row_id"]: r["vec"] for r in en.first_pool(df).collect()} == {1: [1.0, -5.0], 2: [3.0, 3.0]}


def test_pooling_of_one_very_long_row(spark):
    vec = F.array(F.col("id").cast("float"), (-F.col("id")).cast("float"), F.when(F.col("id") == 77, F.lit(float("nan"))).otherwise(0.0).cast("float"))
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 2 == 0, F.col("id")).alias("row_id"),
        F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("mask"), vec.alias("vec"),
    ).repartition(5)
    want = {}
    for i in range(60_000):
        row = 5 if i % 3 else i if i % 2 == 0 else None
        shown = i % 10 != 0
        have = want.setdefault(row, [-1e9, -1e9, -1e9])
        if shown:
            want[row] = [max(have[0], i), max(have[1], -i), math.nan if i == 77 or math.isnan(have[2]) else max(have[2], 0.0)]
    got = {r["row_id"]: r["vec"] for r in en.max_pool(df, 3).collect()}
    assert got.keys() == want.keys()
    assert all(np.array_equal(got[k], want[k], equal_nan=True) for k in got)
    assert en.max_pool(df.limit(0), 3).count() == 0


def test_softmax_argmax_loss(spark):
    logits = [[1.0, 2.0, 3.0], [1000.0, 1000.0, -1000.0], [0.5, 0.5, 0.5]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(logits)], "row_id long, logits array<double>")
    rows = df.select(
        vx.softmax(F.col("logits")).alias("p"), vx.argmax(F.col("logits")).alias("a"),
        vx.cross_entropy(F.col("logits"), F.lit(1)).alias("loss"),
    ).collect()
    for values, r in zip(logits, rows):
        e = np.exp(np.array(values) - max(values))
        assert r["p"] == pytest.approx((e / e.sum()).tolist())
        assert r["loss"] == pytest.approx(-math.log(e[1] / e.sum()))
    assert [r["a"] for r in rows] == [2, 0, 0]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    labels = [i % 3 for i in range(240)]
    rows = [(i, (rng.normal(size=4) + 3 * np.eye(3, 4)[c]).astype("float32").tolist(), c) for i, c in enumerate(labels)]
    return spark.createDataFrame(rows, "row_id long, vec array<float>, label int").repartition(4).cache()


def test_batch_scorer_equals_numpy_and_expression(spark, vectors):
    rng = np.random.default_rng(5)
    w, b = rng.normal(size=(3, 4)), rng.normal(size=3)
    scored = sc.score_batches(vectors, sc.layered_scorer(spark, [(w, b)]), 4, batch_size=7)
    for r in scored.withColumn("plain", vx.linear_logits(F.col("vec"), w.tolist(), b.tolist())).collect():
        assert r["logits"] == pytest.approx((w @ np.array(r["vec"]) + b).tolist())
        assert r["plain"] == pytest.approx(r["logits"])
    v, c = rng.normal(size=(2, 3)), rng.normal(size=2)
    for r in sc.score_batches(vectors, sc.layered_scorer(spark, [(w, b), (v, c)]), 4).collect():
        hidden = np.maximum(w @ np.array(r["vec"]) + b, 0)
        assert r["logits"] == pytest.approx((v @ hidden + c).tolist())


def test_add_predictions(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 5.0])], "row_id long, logits array<double>")
    r = sc.add_predictions(df).first()
    assert (r["pred"], r["sentiment"], r["original_class"]) == (2, "Positive", 3)
    assert r["confidence"] == r["probs"][2]


def test_spot_check_on_a_short_table(spark):
    scored = spark.createDataFrame([(1, 0, 2, [0.1, 0.2, 0.7])], "row_id long, y int, pred int, probs array<double>")
    texts = spark.createDataFrame([(1, "x" * 120), (2, "y")], "row_id long, text string")
    rows = sc.spot_check(scored, texts).collect()
    assert [(r["preview"], r["true_name"], r["pred_name"], r["confidence"]) for r in rows] == [
        ("x" * 100 + "...", "Negative", "Positive", 0.7)
    ]


def fold(scores, patience, delta, mode, compat):
    """Plain reading of the stop rule."""
    worst = math.inf if compat and mode == "min" else -math.inf
    best, where, counter = worst, None, 0
    for epoch, score in enumerate(scores, 1):
        s = -score if mode == "min" else score
        short = s < best + delta
        if not compat and math.isnan(s):
            short = True
        if short:
            counter += 1
            if counter >= patience:
                return epoch, where, counter
        else:
            best, where, counter = s, epoch, 0
    return None, where, counter


NAN = float("nan")


@pytest.mark.parametrize("mode", ["max", "min"])
@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize(
    "scores",
    [[0.1, 0.2, 0.3], [0.5, 0.625, 0.75], [0.5, 0.4, 0.3, 0.2], [0.5, NAN, 0.4, 0.9], [NAN, NAN, 0.2], [0.3, 0.2, 0.6, 0.1, 0.1, 0.1]],
)
def test_early_stop(spark, scores, mode, compat):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores, 1)], "epoch int, m double").repartition(3)
    r = hs.early_stop(df, "m", patience=2, delta=0.125, mode=mode, compat=compat).first()
    assert (r["stop_epoch"], r["best_epoch"], r["counter"]) == fold(scores, 2, 0.125, mode, compat)


def test_best_epoch(spark):
    def best(scores):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(scores, 1)], "epoch int, f1 double")
        return [r["epoch"] for r in hs.best_epoch(df).collect()]

    assert best([0.2, 0.7, 0.7, NAN]) == [2]
    assert best([0.0, 0.0]) == []


def test_fit_head_separates(spark, vectors):
    model = ft.fit_head(vectors)
    head = [(model.coefficientMatrix.toArray(), model.interceptVector.toArray())]
    scored = sc.score_batches(vectors, sc.layered_scorer(spark, head), 4)
    right = scored.where(vx.argmax(F.col("logits")) == F.col("label")).count()
    assert right > 0.9 * 240


def test_fit_head_reaches_the_optimum(spark):
    # overlapping classes: the optimum is finite and its gradient zero
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 4)).astype("float32"), rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "row_id long, vec array<float>, label int")
    model = ft.fit_head(df, max_iter=300)
    flat = bp.flat_layers([(model.coefficientMatrix.toArray(), model.interceptVector.toArray())])
    loss, grad = bp.loss_and_gradient(flat, [4, 3], x.astype(float), y)
    assert np.abs(grad).max() / 300 < 1e-4
    for _ in range(5):
        assert bp.loss_and_gradient(flat + 0.05 * rng.normal(size=len(flat)), [4, 3], x.astype(float), y)[0] > loss


def test_text_model_weights_rare_words_more_and_reaches_the_optimum(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "d", "e"]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 9), p=[0.5, 0.2, 0.15, 0.1, 0.05])) for _ in range(200)]
    y = rng.integers(0, 2, 200)
    docs = spark.createDataFrame([(i, t, int(c)) for i, (t, c) in enumerate(zip(texts, y))], "row_id long, text string, label int")
    model = ft.fit_text(docs, features=1 << 12, max_iter=200, reg=0.05)
    hashed = model.stages[1]
    slot = {w: int(hashed.indexOf(w)) for w in words}
    assert len(set(slot.values())) == 5
    counts = np.array([[t.split().count(w) for w in words] for t in texts], float)
    idf = np.log(201 / ((counts > 0).sum(axis=0) + 1))
    x = counts * idf
    weights = model.stages[3].coefficientMatrix.toArray()[:, [slot[w] for w in words]]
    bias = model.stages[3].interceptVector.toArray()
    z = x @ weights.T + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(200), y] -= 1
    # the penalty is on weights of standardised features
    gradient = p.T @ x / 200 + 0.05 * weights * x.std(axis=0, ddof=1) ** 2
    assert np.abs(gradient).max() < 1e-3 and np.abs(p.mean(axis=0)).max() < 1e-3
    got = {r["row_id"]: r["prediction"] for r in sc.predict_texts(docs, model).collect()}
    assert got == {i: int(z[i].argmax()) for i in range(200)}
    assert sc.predict_one(spark, texts[7], model) == ["Negative", "Neutral"][int(z[7].argmax())]


def test_text_model_roundtrip(spark, tmp_path):
    rows = [(i, "good fine great" if i % 2 else "bad poor awful", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "row_id long, text string, label int")
    model = ft.fit_text(docs, features=256, max_iter=10)
    sk.save_model(model, str(tmp_path / "m"))
    loaded = sk.load_model(str(tmp_path / "m"))
    out = loaded.transform(docs)
    assert sc.predict_one(spark, "a great day", loaded) == "Neutral"
    records = sc.predict_texts(docs, loaded).collect()
    assert {(r["prediction"], r["sentiment"], r["original_class"]) for r in records} == {
        (0, "Negative", 1), (1, "Neutral", 2)
    }
    assert out.where(F.col("prediction") == F.col("label")).count() == 40
