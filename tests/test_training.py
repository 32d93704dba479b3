"""Training by epochs against plain Python, its stored states, and the prepared sets that are published the same way."""

import hashlib
import math
import random
import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.operators import backprop as bp
from tonemill.operators import history as hs
from tonemill.operators import metrics as mt
from tonemill.operators import training as tr
from tonemill.operators.permutation import MAX_WALKS, ROUNDS, permuted
from tonemill.plans.train import save_fit, train_head
from tonemill.sources import cache
from tonemill.sources.manifest import entries


def place(pos, n, key):
    """The keyed bijection, read plainly."""
    a = max(1, math.ceil(math.sqrt(n)))
    b = max(1, -(-n // a))
    draw = lambda i, v, size: int(hashlib.md5(f"{key}:{i}:{v}".encode()).hexdigest()[:15], 16) % size
    x = pos
    for walk in range(1 + min(a, MAX_WALKS)):
        if walk and x < n:
            break
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + draw(i, right, a)) % a
            else:
                right = (right + draw(i, left, b)) % b
        x = left * b + right
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 11, 30, 64, 257, 1001])
def test_order_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("place"))
    got = {r["id"]: r["place"] for r in rows.collect()}
    assert sorted(got.values()) == list(range(n))
    assert got == {i: place(i, n, "k") for i in range(n)}


def test_order_moves_no_row_and_depends_on_the_key(spark):
    rows = spark.range(500).select(*[permuted(F.col("id"), F.lit(500).cast("long"), F.lit(k)).alias(k) for k in ("a", "b")])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    both = rows.collect()
    assert sum(r["a"] == r["b"] for r in both) < 20
    # neighbours do not stay neighbours
    assert sum(abs(x["a"] - y["a"]) == 1 for x, y in zip(both, both[1:])) < 20


@pytest.mark.parametrize("sizes", [[4, 3], [4, 6, 3], [4, 5, 7, 2]])
def test_gradient_equals_finite_differences(sizes):
    rng = np.random.default_rng(1)
    x, y, ids = rng.normal(size=(9, 4)), rng.integers(0, sizes[-1], 9), np.arange(9)
    flat = rng.normal(size=len(bp.bias_mask(sizes)))
    for rate in (0.0, 0.4):
        loss, grad = bp.loss_and_gradient(flat, sizes, x, y, ids, 5, rate)
        for i in range(len(flat)):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            up, down = (bp.loss_and_gradient(flat + s, sizes, x, y, ids, 5, rate)[0] for s in (step, -step))
            assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_dropout_keeps_its_share_and_depends_on_the_row_alone():
    kept = bp.kept_units(np.arange(2000), 50, 3, 0.3)
    assert abs(kept.mean() - 0.7) < 0.01
    assert np.array_equal(bp.kept_units(np.array([1999, 5]), 50, 3, 0.3), kept[[1999, 5]])
    assert not np.array_equal(bp.kept_units(np.arange(2000), 50, 4, 0.3), kept)


def points(spark, n, seed=3, parts=4):
    rng = np.random.default_rng(seed)
    rows = [(i * 7 + 1, (rng.normal(size=4) + 2 * np.eye(3, 4)[i % 3]).astype("float32").tolist(), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, vec array<float>, label int").repartition(parts)


def test_sums_do_not_depend_on_tasks(spark):
    rows, df = points(spark, 240)
    sizes = [4, 5, 3]
    flat = np.random.default_rng(7).normal(size=len(bp.bias_mask(sizes)))
    x, y, ids = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    loss, grad = bp.loss_and_gradient(flat, sizes, x, y, ids, 2, 0.2)
    seen = []
    for parts in (1, 3, 8):
        shard = F.pmod("row_id", F.lit(5)).cast("int").alias("shard")
        dealt = df.select("*", shard).repartition(parts, "shard").sortWithinPartitions("shard", "row_id")
        seen.append(tr.gradient(dealt, flat, sizes, 2, 0.2))
        assert seen[-1][0] == pytest.approx(grad, rel=1e-12, abs=1e-12) and seen[-1][1] == pytest.approx(loss) and seen[-1][2] == 240
    assert all(np.array_equal(seen[0][0], s[0]) and seen[0][1] == s[1] for s in seen)
    empty = tr.gradient(df.select("*", F.lit(0).alias("shard")).limit(0), flat, sizes)
    assert empty[1:] == (0.0, 0) and not empty[0].any()


def unrolled(rows, val, sizes, s):
    """The whole run in plain Python: order, batches, clip, AdamW with warm-up and decay, validation, stop."""
    rows = sorted(rows)
    n = len(rows)
    steps = n // s.shards // s.batch_size
    total = max(1, s.epochs * steps // s.accumulate)
    warm = int(total * s.warmup_ratio)
    w = bp.start_weights(sizes, s.seed)
    bias = bp.bias_mask(sizes)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    history, best_f1, best, top, bad = [], 0.0, None, -math.inf, 0
    for epoch in range(1, s.epochs + 1):
        order = sorted(range(n), key=lambda i: place(i, n, f"{s.seed}:{epoch}"))
        pending, losses = np.zeros_like(w), []
        for step in range(steps):
            batch = [rows[i] for i in order[step * s.batch_size * s.shards : (step + 1) * s.batch_size * s.shards]]
            key = ((s.seed * 1_000_003 + epoch) * 1_000_003 + step) % (1 << 62)
            ids, x, y = (np.array(c) for c in zip(*batch))
            loss, grad = bp.loss_and_gradient(w, sizes, np.array(x, float), y, ids, key, s.dropout)
            losses.append(loss / len(batch))
            pending = pending + grad / len(batch) / s.accumulate
            if (step + 1) % s.accumulate == 0 or step == steps - 1:
                norm = math.sqrt(float((pending**2).sum()))
                g = pending * min(1.0, s.clip_norm / norm)
                rate = s.learning_rate * (t / max(1, warm) if t < warm else max(0.0, (total - t) / max(1, total - warm)))
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * s.weight_decay * np.where(bias, 0, w) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                pending = np.zeros_like(w)
        logits = np.array([r[1] for r in sorted(val)], float)
        layers = bp.split_layers(w, sizes)
        for i, (a, b) in enumerate(layers):
            logits = logits @ a.T + b
            if i < len(layers) - 1:
                logits = np.maximum(logits, 0)
        y = np.array([r[2] for r in sorted(val)])
        loss = np.log(np.exp(logits).sum(1)) - logits[np.arange(len(y)), y]
        scores = tr.scores_of_counts({(a, b): int(((y == a) & (logits.argmax(1) == b)).sum()) for a in range(3) for b in range(3)})
        val_loss = np.mean([loss[i : i + s.batch_size].mean() for i in range(0, len(y), s.batch_size)])
        history.append((epoch, float(np.mean(losses)), float(val_loss), scores["accuracy"], scores["precision"], scores["recall"], scores["f1"]))
        if scores["f1"] > best_f1:
            best_f1, best = scores["f1"], w.copy()
        score = -val_loss if s.stop_metric == "loss" else scores[s.stop_metric]
        bad, top = (bad + 1, top) if score < top + s.delta else (0, score)
        if bad >= s.patience:
            break
    return history, best, w


SETTINGS = tr.EpochSettings(epochs=5, batch_size=8, shards=3, learning_rate=0.1, patience=3)


@pytest.mark.parametrize(
    "sizes, settings",
    [
        ([4, 3], SETTINGS),
        ([4, 3], replace(SETTINGS, accumulate=2, clip_norm=0.05, epochs_ahead=4, stop_metric="loss", seed=9)),
        ([4, 6, 5, 3], replace(SETTINGS, dropout=0.3, epochs_ahead=2, weight_decay=0.2)),
    ],
)
def test_training_equals_plain_python(spark, monkeypatch, sizes, settings):
    monkeypatch.setattr(tr, "SLOT_STEPS", 2)
    rows, df = points(spark, 130)
    val, held = points(spark, 37, seed=5)
    got = tr.fit_layers(df, held, sizes, settings)
    history, best, last = unrolled(rows, val, sizes, settings)
    assert len(got.history) == len(history)
    for a, b in zip(got.history, history):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert bp.flat_layers(got.last) == pytest.approx(last, rel=1e-9, abs=1e-9)
    assert bp.flat_layers(got.best) == pytest.approx(best, rel=1e-9, abs=1e-9)


def test_a_step_reads_its_own_slot(spark, tmp_path):
    _, df = points(spark, 400)
    settings = replace(SETTINGS, batch_size=4, epochs=3, epochs_ahead=2)
    store = tr.EpochStore(df, settings, str(tmp_path))
    assert store.steps == 33
    seen = set()
    for step in range(store.steps):
        rows = store.step(2, step).collect()
        assert len(rows) == 12 and {r["shard"] for r in rows} == {0, 1, 2}
        seen |= {r["row_id"] for r in rows}
    assert len(seen) == 396
    plan = store.step(2, 20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan and "EqualTo(step,20)" in plan


def test_early_stop_acts_and_the_rule_equals_the_fold(spark):
    _, df = points(spark, 90)
    for metric in ("accuracy", "loss"):
        settings = replace(SETTINGS, epochs=20, learning_rate=0.0, patience=2, stop_metric=metric)
        assert len(tr.fit_layers(df, df, [4, 3], settings).history) == 3
    rng = random.Random(4)
    for _ in range(6):
        scores = [rng.choice([0.1, 0.2, 0.3, 0.4, float("nan")]) for _ in range(8)]
        rule = tr.StopRule(2, 0.05)
        stop = next((i for i, s in enumerate(scores, 1) if rule.stops(s)), None)
        table = spark.createDataFrame(list(enumerate(scores, 1)), "epoch int, m double")
        assert hs.early_stop(table, "m", 2, 0.05).first()["stop_epoch"] == stop


def test_too_few_rows_for_a_step(spark):
    _, df = points(spark, 10)
    result = tr.fit_layers(df, df, [4, 3], replace(SETTINGS, epochs=2, patience=5))
    assert [h[1] for h in result.history] == [None, None] and not bp.flat_layers(result.last).any()


def same(a, b):
    return a.history == b.history and all(np.array_equal(bp.flat_layers(x), bp.flat_layers(y)) for x, y in ((a.last, b.last), (a.best, b.best)))


@pytest.mark.parametrize("stop", [1, 3])
def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path, stop):
    _, df = points(spark, 130)
    _, held = points(spark, 37, seed=5)
    settings = replace(SETTINGS, dropout=0.2, accumulate=2)
    whole = tr.fit_layers(df, held, [4, 6, 3], settings)
    folder = str(tmp_path)
    broken = tr.fit_layers(df, held, [4, 6, 3], settings, folder, stop_after=stop)
    assert len(broken.history) == stop and entries(spark, folder)
    # a writer that broke before it published, and a run with other settings, are not resumed from
    spark.createDataFrame([("params", 0, 9.0)], tr.STATE_SCHEMA).write.parquet(f"{folder}/broken")
    other = tr.fit_layers(df, held, [4, 6, 3], replace(settings, seed=1), folder, stop_after=1)
    assert [h[0] for h in other.history] == [1]
    resumed = tr.fit_layers(df.repartition(7), held.repartition(2), [4, 6, 3], settings, folder)
    assert same(resumed, whole)
    if stop == 1:
        assert same(tr.fit_layers(df, held, [4, 6, 3], settings, folder), whole)


@pytest.mark.parametrize("n, size, shards", [(37, 8, 3), (37, 100, 4), (36, 6, 3), (2, 4, 5), (1, 1, 1), (40, 7, 1)])
def test_validation_in_both_readings(spark, n, size, shards):
    rows, df = points(spark, n)
    rng = np.random.default_rng(2)
    w, b = rng.normal(size=(3, 4)), rng.normal(size=3)
    got = tr.validate(tr.validation_rows(df, size, shards), [(w, b)], 4)
    z = np.array([r[1] for r in sorted(rows)]) @ w.T + b
    y = np.array([r[2] for r in sorted(rows)])
    loss = np.log(np.exp(z).sum(1)) - z[np.arange(n), y]
    means = lambda v: [v[i : i + size].mean() for i in range(0, len(v), size)]
    assert got["val_loss"] == pytest.approx(np.mean(means(loss)))
    assert got["accuracy"] == pytest.approx((z.argmax(1) == y).mean())
    share = -(-n // shards)
    dealt = [[(k * shards + r) % n for k in range(share)] for r in range(shards)]
    flat = [i for d in dealt for i in d]
    assert got["padded_val_loss"] == pytest.approx(np.mean([np.mean(means(loss[d])) for d in dealt]))
    assert got["padded_accuracy"] == pytest.approx((z.argmax(1) == y)[flat].mean())
    counts = spark.createDataFrame([(int(y[i]), int(z[i].argmax())) for i in flat], "y int, pred int")
    want = mt.weighted_prf(mt.confusion_counts(counts)).first()
    assert all(got[f"padded_{m}"] == pytest.approx(want[m]) for m in ("precision", "recall", "f1"))


def test_hidden_layers_learn_what_a_linear_head_cannot(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (400, 2)).astype("float32")
    rows = [(i, v.tolist(), int(v[0] * v[1] > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, vec array<float>, label int")
    settings = tr.EpochSettings(epochs=8, batch_size=16, shards=2, learning_rate=0.1, epochs_ahead=8, patience=20)
    linear = train_head(df, 2, 2, settings)
    hidden = train_head(df, 2, 2, settings, hidden=[16, 8])
    assert hidden.history[-1][1] < 0.7 * linear.history[-1][1]
    assert max(h[3] for h in hidden.history) > 0.85
    save_fit(hidden, df, str(tmp_path))
    table = spark.read.parquet(str(tmp_path / "best")).collect()
    stored = {(r["layer"], r["cls"], r["idx"]): r["w"] for r in table}
    assert len(stored) == len(bp.flat_layers(hidden.best))
    assert all(stored[k, c, i] == w[c, i] for k, (w, _) in enumerate(hidden.best) for c in range(len(w)) for i in range(w.shape[1]))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 8


def test_two_writers_of_a_prepared_set(spark, tmp_path):
    root, barrier = str(tmp_path), threading.Barrier(2)
    results = {}

    def writer(name):
        def build():
            barrier.wait()  # both have seen an empty place
            return {"train": spark.range(10).withColumn("by", F.lit(name)), "test": spark.range(3).withColumn("by", F.lit(name))}

        results[name] = cache.prepared_set(spark, root, "k", build)

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = cache.prepared_set(spark, root, "k", lambda: pytest.fail("built again"))
    kept = {r["by"] for s in now.values() for r in s.collect()}
    assert len(kept) == 1 and {s: df.count() for s, df in now.items()} == {"test": 3, "train": 10}
    again = cache.prepared_set(spark, root, "k", lambda: pytest.fail("built again"))
    assert {r["by"] for r in again["train"].collect()} == kept


def test_a_broken_writer_is_never_seen(spark, tmp_path):
    def broken():
        raise OSError("lost")

    with pytest.raises(OSError):
        cache.prepared_set(spark, str(tmp_path), "k", broken)
    # one that broke between its splits and its entry
    spark.range(99).write.parquet(str(tmp_path / "prepared" / "k" / "0000" / "train"))
    assert cache.prepared_set(spark, str(tmp_path), "k", lambda: {"train": spark.range(4)})["train"].count() == 4


def test_small_steps_share_a_job_and_large_ones_give_the_same_bits(spark, monkeypatch):
    _, df = points(spark, 230)
    _, held = points(spark, 37, seed=5)
    settings = replace(SETTINGS, batch_size=4, epochs=2, dropout=0.2, accumulate=5)
    apart, calls = tr.gradient, []
    monkeypatch.setattr(tr, "gradient", lambda *a: calls.append("step") or apart(*a))
    slots = tr.train_slot
    monkeypatch.setattr(tr, "train_slot", lambda *a: calls.append("slot") or slots(*a))
    whole = tr.fit_layers(df, held, [4, 6, 3], settings)
    assert calls == ["slot"] * 2  # 19 steps an epoch
    monkeypatch.setattr(tr, "SLOT_STEPS", 4)  # gradients wait for their update across slots
    assert same(tr.fit_layers(df.repartition(7), held, [4, 6, 3], settings), whole)
    assert calls == ["slot"] * 12
    monkeypatch.setattr(tr, "STEP_ROWS", 11)
    assert same(tr.fit_layers(df, held, [4, 6, 3], settings), whole)
    assert calls[12:] == ["step"] * 38
