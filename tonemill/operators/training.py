"""Synchronous data-parallel training of a head on stored vectors, by epochs of mini-batches.

The order of every epoch is a keyed bijection of gapless row numbers, so it needs no sort. Epochs are written ahead to a
store in which the rows of a step lie together. Small steps follow each other inside a task: a job streams the rows of
``SLOT_STEPS`` steps, sums the gradient of every shard and hands the weights on to the next job. A step of more than
``STEP_ROWS`` rows is a job of its own, in which every shard sends one summed gradient and the driver updates the weights.
Sums of gradients are exact, so a run gives the same bits either way and on whatever tasks, and a run resumed from a
stored state equals an unbroken one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import asdict, dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed
from tonemill.functions import vectors as vx
from tonemill.operators import backprop as bp
from tonemill.operators.permutation import permuted
from tonemill.operators.ranking import with_positions
from tonemill.operators.scoring import layered_scorer, score_batches
from tonemill.session import scratch_dir
from tonemill.sources.manifest import attempt_name, entries, put_entry

HISTORY_COLUMNS = ("epoch", "train_loss", "val_loss", "accuracy", "precision", "recall", "f1")
HISTORY_SCHEMA = "epoch int, train_loss double, val_loss double, accuracy double, precision double, recall double, f1 double"
STATE_SCHEMA = "part string, idx int, value double"
# Steps whose rows share a folder of the epoch store; inside it they lie in order of their step. Small steps of a slot
# run in one task: a bounded number of rows, however large the table.
SLOT_STEPS = 128
# Rows of a step from which its shards are worth a task each: below, a job takes far longer than its gradient.
STEP_ROWS = 2048
# Rows multiplied at a time; fixed, so that a shard's sum does not depend on Arrow batches.
CHUNK_ROWS = 1024
COARSE, FINE = 2.0**20, 2.0**60


@dataclass(frozen=True)
class EpochSettings:
    """Settings of the training loop. ``batch_size`` rows a shard and ``shards`` shards make a step."""

    epochs: int = 50
    batch_size: int = 64
    shards: int = 8
    learning_rate: float = 0.05
    weight_decay: float = 0.01
    warmup_ratio: float = 0.1
    clip_norm: float = 1.0
    accumulate: int = 1
    dropout: float = 0.0
    seed: int = fixed.DEFAULT_SEED
    patience: int = fixed.DEFAULT_PATIENCE
    delta: float = fixed.DEFAULT_DELTA
    # One of loss, accuracy, precision, recall, f1.
    stop_metric: str = "accuracy"
    # Epochs written to the store at a time: disk against the number of jobs.
    epochs_ahead: int = 1


@dataclass
class FitResult:
    sizes: list[int]
    history: list[tuple] = field(default_factory=list)
    best: list[bp.Layer] | None = None
    last: list[bp.Layer] | None = None

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY_SCHEMA)


class StopRule:
    """The early-stop fold of ``history.early_stop``, an epoch at a time."""

    def __init__(self, patience: int, delta: float):
        self.patience, self.delta = patience, delta
        self.best, self.counter = float("-inf"), 0

    def stops(self, score: float) -> bool:
        if score < self.best + self.delta or np.isnan(score):
            self.counter += 1
        else:
            self.best, self.counter = score, 0
        return self.counter >= self.patience and self.counter > 0


class AdamW:
    """Weight update of the flat parameters, with clipping, warm-up from zero and linear decay; biases do not decay."""

    def __init__(self, sizes: Sequence[int], settings: EpochSettings, total_steps: int):
        biases = bp.bias_mask(sizes)
        self.m, self.v, self.t = np.zeros(len(biases)), np.zeros(len(biases)), 0
        self.s, self.total = settings, max(total_steps, 1)
        self.warmup = int(self.total * settings.warmup_ratio)
        self.decay = np.where(biases, 0.0, settings.weight_decay)

    def rate(self) -> float:
        if self.t < self.warmup:
            return self.s.learning_rate * self.t / max(1, self.warmup)
        return self.s.learning_rate * max(0.0, (self.total - self.t) / max(1, self.total - self.warmup))

    def update(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        norm = float(np.linalg.norm(grad))
        if norm > self.s.clip_norm:
            grad = grad * (self.s.clip_norm / norm)
        rate = self.rate()
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        step = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return params * (1 - rate * self.decay) - rate * step


def steps_of(rows: int, settings: EpochSettings) -> int:
    """Steps of an epoch: every shard gets equally many rows, and of these only whole batches."""
    return rows // settings.shards // settings.batch_size


class EpochStore:
    """Training rows, numbered once, and the steps of the epochs written so far."""

    def __init__(self, train: DataFrame, settings: EpochSettings, folder: str):
        self.spark, self.settings, self.folder = train.sparkSession, settings, folder
        numbered = with_positions(train.select("row_id", "vec", F.col("label").cast("int").alias("label")))
        numbered.write.parquet(f"{folder}/rows")
        self.rows = self.spark.read.parquet(f"{folder}/rows")
        self.total = self.rows.count()
        self.steps = steps_of(self.total, settings)
        self.small = settings.batch_size * settings.shards <= STEP_ROWS
        self.written: DataFrame | None = None
        self.until = 0

    def _write(self, first: int, last: int) -> DataFrame:
        s = self.settings
        rows = self.rows.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(last))))
        key = F.concat_ws(":", F.lit(s.seed).cast("string"), F.col("epoch").cast("string"))
        rows = rows.withColumn("place", permuted(F.col("pos"), F.lit(self.total).cast("long"), key))
        rows = rows.select(
            "row_id", "vec", "label", "epoch", "place",
            F.floor(F.col("place") / (s.batch_size * s.shards)).cast("int").alias("step"),
            (F.col("place") % s.shards).cast("int").alias("shard"),
        ).where(F.col("step") < self.steps).withColumn("slot", F.floor(F.col("step") / SLOT_STEPS).cast("int"))
        path = f"{self.folder}/epochs-{first}"
        # What a task reads lies in one file, in order: a slot, or a shard of a large step.
        near = ["slot"] if self.small else ["step", "shard"]
        dealt = rows.repartition("epoch", *near).sortWithinPartitions("epoch", "slot", "step", "shard", "place")
        dealt.write.partitionBy("epoch", "slot").parquet(path)
        return self.spark.read.parquet(path)

    def _epoch(self, epoch: int) -> DataFrame:
        if epoch > self.until or self.written is None:
            self.until = min(self.settings.epochs, epoch + self.settings.epochs_ahead - 1)
            self.written = self._write(epoch, self.until)
        return self.written.where(F.col("epoch") == epoch)

    def slot(self, epoch: int, slot: int) -> DataFrame:
        """The rows of a slot's steps in order, in one partition."""
        mine = self._epoch(epoch).where(F.col("slot") == slot).coalesce(1)
        return mine.sortWithinPartitions("step", "shard", "place").select("row_id", "vec", "label", "step", "shard")

    def step(self, epoch: int, step: int) -> DataFrame:
        mine = (F.col("slot") == step // SLOT_STEPS) & (F.col("step") == step)
        return self._epoch(epoch).where(mine).select("row_id", "vec", "label", "shard")


def shard_sums(w: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, ids: np.ndarray, key: int, dropout: float) -> np.ndarray:
    """Summed gradient and summed loss of a shard's rows."""
    sums = np.zeros(len(w) + 1)
    for i in range(0, len(y), CHUNK_ROWS):
        part = slice(i, i + CHUNK_ROWS)
        loss, grad = bp.loss_and_gradient(w, sizes, x[part], y[part], ids[part], key, dropout)
        sums += np.r_[grad, loss]
    return sums


def split_sums(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number as a multiple of 2**-20 and the rest as a multiple of 2**-60: partial sums of both are exact."""
    coarse = np.rint(sums * COARSE)
    return coarse, np.rint((sums - coarse / COARSE) * FINE)


def joined_sums(split: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and loss from added ``split_sums``."""
    half = len(split) // 2
    sums = split[:half] / COARSE + split[half:] / FINE
    return sums[:-1], float(sums[-1])


def batch_columns(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and ids of an Arrow batch as numpy arrays."""
    x = batch.column("vec").flatten().to_numpy().astype(float).reshape(batch.num_rows, dims)
    return x, batch.column("label").to_numpy(), batch.column("row_id").to_numpy()


def gradient(rows: DataFrame, params: np.ndarray, sizes: Sequence[int], key: int = 0, dropout: float = 0.0, shards: int = 8) -> tuple[np.ndarray, float, int]:
    """Summed gradient, summed loss and number of ``(row_id, vec, label, shard)`` rows.

    Numbers are sent as ``split_sums``, so the order of tasks does not show. Columns of Arrow batches go into numpy as
    they are.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(params)
    groups = math.isqrt(max(1, shards))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            x, y, ids = batch_columns(batch, sizes[0])
            for s in np.unique(shard):
                here = shard == s
                held.setdefault(int(s), []).append((x[here], y[here], ids[here]))
        for s in sorted(held):
            x, y, ids = (np.concatenate(c) for c in zip(*held.pop(s)))
            flat = np.r_[(*split_sums(shard_sums(w, sizes, x, y, ids, key, dropout)), float(len(y)))]
            yield pa.RecordBatch.from_arrays([pa.array([s % groups], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], ["g", "parts"])

    def add(table: pa.Table) -> pa.Table:
        flat = table.column("parts").combine_chunks().flatten().to_numpy()
        return pa.table({"parts": pa.array([flat.reshape(table.num_rows, -1).sum(axis=0)], pa.list_(pa.float64()))})

    # a tree of two levels: the driver adds up as many vectors as the square root of the shards
    parts = rows.select("row_id", "vec", "label", "shard").mapInArrow(partial, "g int, parts array<double>")
    sums = parts.groupBy("g").applyInArrow(add, "parts array<double>").toArrow().column("parts")
    shipped.unpersist()
    if not len(sums):
        return np.zeros_like(params), 0.0, 0
    s = np.sum([part.values.to_numpy() for part in sums], axis=0)
    return *joined_sums(s[:-1]), int(s[-1])


def step_batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in the order of step and shard, cut where either changes: step, shard, vectors, labels, ids."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        step, shard = batch.column("step").to_numpy(), batch.column("shard").to_numpy()
        columns = batch_columns(batch, dims)
        cuts = np.flatnonzero((np.diff(step) != 0) | (np.diff(shard) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(step)]):
            here = int(step[lo]), int(shard[lo])
            if held and here != at:
                yield *at, *(np.concatenate(c) for c in zip(*held))
                held = []
            at = here
            held.append(tuple(c[lo:hi] for c in columns))
    if held:
        yield *at, *(np.concatenate(c) for c in zip(*held))


class Progress:
    """Weights and optimizer between steps, the gradient that waits for its update, and the losses of an epoch's steps."""

    def __init__(self, params: np.ndarray, optimizer: AdamW):
        self.params, self.optimizer = params, optimizer
        self.pending, self.losses = np.zeros_like(params), []

    def take(self, grad: np.ndarray, loss: float, n: int, last: bool) -> None:
        """A step's sums over ``n`` rows; ``last`` of its epoch, it is not waited for others."""
        every = self.optimizer.s.accumulate
        self.losses.append(loss / n)
        self.pending += grad / n / every
        if len(self.losses) % every == 0 or last:
            self.params = self.optimizer.update(self.params, self.pending)
            self.pending = np.zeros_like(self.params)


def step_key(settings: EpochSettings, epoch: int, step: int) -> int:
    """The key of a step's dropout."""
    return ((settings.seed * 1_000_003 + epoch) * 1_000_003 + step) % (1 << 62)


def train_slot(rows: DataFrame, progress: Progress, sizes: Sequence[int], epoch: int, steps: int) -> Progress:
    """The steps of ``EpochStore.slot`` rows, one after another in the task that reads them; ``steps`` are those of the epoch.

    The task holds the rows of one step. Its shards are summed apart and added up as ``gradient`` adds those of many tasks.
    """
    context = rows.sparkSession.sparkContext
    shipped = context.broadcast(progress)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = shipped.value, shipped.value.optimizer.s
        now = Progress(now.params, copy(now.optimizer))
        now.pending, now.losses = shipped.value.pending.copy(), list(shipped.value.losses)
        for step, shards in groupby(step_batches(batches, sizes[0]), key=lambda part: part[0]):
            parts, n = [], 0
            for _, _, x, y, ids in shards:
                parts.append(np.r_[split_sums(shard_sums(now.params, sizes, x, y, ids, step_key(s, epoch, step), s.dropout))])
                n += len(y)
            now.take(*joined_sums(np.sum(parts, axis=0)), n, step == steps - 1)
        values = [now.params, now.optimizer.m, now.optimizer.v, now.pending, np.array(now.losses)]
        yield pa.RecordBatch.from_arrays([pa.array([now.optimizer.t], pa.int64()), *(pa.array([v], pa.list_(pa.float64())) for v in values)], ["t", *names])

    names = ["params", "m", "v", "pending", "losses"]
    end = rows.mapInArrow(run, ", ".join(["t long", *(f"{n} array<double>" for n in names)])).toArrow()
    shipped.destroy()
    values = {n: end[n].combine_chunks().flatten().to_numpy() for n in names}
    optimizer = copy(progress.optimizer)
    optimizer.t, optimizer.m, optimizer.v = end["t"][0].as_py(), values["m"], values["v"]
    out = Progress(values["params"], optimizer)
    out.pending, out.losses = values["pending"].copy(), values["losses"].tolist()
    return out


def validation_rows(val: DataFrame, batch_size: int, shards: int = 1) -> DataFrame:
    """``(row_id, vec, y)`` with the weights of a row in two readings of the validation set.

    * ``weight``: in the mean of batch means over batches in the order of ``row_id``.
    * ``copies``, ``padded_weight``: the same when rows are dealt out to ``shards`` and leading rows repeat until all
      shards are equal; then a repeated row counts as often as it is dealt, and each shard has its own batches.
    """
    rows = with_positions(val.select("row_id", "vec", F.col("label").cast("int").alias("y")))
    pos, total = F.col("pos"), F.col("total")
    batches = F.ceil(total / batch_size)
    in_batch = F.least(F.lit(batch_size), total - F.floor(pos / batch_size) * batch_size)
    share = F.ceil(total / shards)  # rows of a shard

    def weight_at(place):
        batch = F.floor(F.floor(place / shards) / batch_size)
        size = F.least(F.lit(batch_size), share - batch * batch_size)
        return 1.0 / (shards * F.ceil(share / batch_size) * size)

    places = F.sequence(pos, share * shards - 1, total)
    return rows.select(
        "row_id", "vec", "y",
        (1.0 / (batches * in_batch)).alias("weight"),
        F.size(places).cast("long").alias("copies"),
        F.aggregate(F.transform(places, weight_at), F.lit(0.0), lambda s, x: s + x).alias("padded_weight"),
    )


def scores_of_counts(counts: dict[tuple[int, int], float]) -> dict[str, float]:
    """Accuracy and support-weighted precision, recall and f1 from counts by (true, predicted)."""
    total = sum(counts.values())
    if not total:
        return {m: 0.0 for m in ("accuracy", "precision", "recall", "f1")}
    out = {"accuracy": sum(n for (y, p), n in counts.items() if y == p) / total, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c in sorted({c for pair in counts for c in pair}):
        hit = counts.get((c, c), 0)
        support = sum(n for (y, _), n in counts.items() if y == c)
        said = sum(n for (_, p), n in counts.items() if p == c)
        precision, recall = hit / said if said else 0.0, hit / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        for name, value in (("precision", precision), ("recall", recall), ("f1", f1)):
            out[name] += value * support / total
    return out


def validate(rows: DataFrame, layers: Sequence[bp.Layer], dims: int) -> dict[str, float]:
    """Loss and scores of both readings of ``validation_rows``, from one pass; the driver gets classes x classes rows."""
    scored = score_batches(rows, layered_scorer(rows.sparkSession, layers), dims)
    loss = vx.cross_entropy(F.col("logits"), F.col("y"))
    # Decimals add up to the same sum in any order; a loss that is no number makes the sum one that is none.
    exact = lambda w: F.col(w).try_cast("decimal(38,18)")
    cells = (
        scored.withColumn("row_loss", loss)
        .select("y", vx.argmax(F.col("logits")).alias("pred"), "copies", *[(F.col("row_loss") * F.col(w)).alias(w) for w in ("weight", "padded_weight")])
        .groupBy("y", "pred")
        .agg(
            F.count("*").alias("n"), F.sum("copies").alias("padded_n"), F.sum(exact("weight")).alias("loss"),
            F.sum(exact("padded_weight")).alias("padded_loss"), F.count_if(exact("weight").isNull()).alias("strange"),
        )
        .collect()
    )
    cells.sort(key=lambda r: (r["y"], r["pred"]))
    broken = any(r["strange"] for r in cells)
    out = {}
    for name, n, part in (("", "n", "loss"), ("padded_", "padded_n", "padded_loss")):
        out[f"{name}val_loss"] = float("nan") if broken else float(sum(r[part] for r in cells))
        scores = scores_of_counts({(r["y"], r["pred"]): r[n] for r in cells})
        out.update({f"{name}{m}": v for m, v in scores.items()})
    return out


class TrainingState:
    """Versions of a run in a shared folder: weights, optimizer, best weights and history after an epoch.

    A version counts once its manifest entry is there; the entry comes after the numbers. Which run a folder belongs to
    is part of the entry, so other settings never resume from it.
    """

    def __init__(self, spark: SparkSession, folder: str, run: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.run = json.loads(json.dumps(run))

    def save(self, epoch: int, arrays: dict[str, np.ndarray], history: list[tuple], scalars: dict[str, float]) -> None:
        attempt = attempt_name()
        tables = [(n, a) for n, a in arrays.items()]
        tables += [(f"history.{c}", np.array([np.nan if h[i] is None else h[i] for h in history], float)) for i, c in enumerate(HISTORY_COLUMNS)]
        tables.append(("scalars", np.array(list(scalars.values()), float)))
        columns = {
            "part": np.concatenate([np.repeat(n, len(a)) for n, a in tables]),
            "idx": np.concatenate([np.arange(len(a), dtype=np.int32) for _, a in tables]),
            "value": np.concatenate([a for _, a in tables]),
        }
        frame = self.spark.createDataFrame(pa.table(columns), STATE_SCHEMA)
        frame.write.parquet(f"{self.folder}/{attempt}")
        put_entry(self.spark, self.folder, attempt, {"epoch": epoch, "run": self.run, "scalars": list(scalars)})

    def load(self) -> tuple[int, dict[str, np.ndarray], list[tuple], dict[str, float]] | None:
        """The last whole version of this run, or None."""
        mine = [e for e in entries(self.spark, self.folder) if e["run"] == self.run]
        if not mine:
            return None
        last = max(mine, key=lambda e: e["epoch"])
        rows = self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/{last['attempt']}").toArrow().to_pandas()
        arrays = {n: g.sort_values("idx")["value"].to_numpy() for n, g in rows.groupby("part")}
        scalars = dict(zip(last["scalars"], arrays.pop("scalars").tolist()))
        columns = [arrays.pop(f"history.{c}") for c in HISTORY_COLUMNS]
        history = [(int(e), None if np.isnan(loss) else float(loss), *map(float, rest)) for e, loss, *rest in zip(*columns)]
        return last["epoch"], arrays, history, scalars


def fit_layers(
    train: DataFrame,
    val: DataFrame,
    sizes: Sequence[int],
    settings: EpochSettings = EpochSettings(),
    state_folder: str | None = None,
    stop_after: int | None = None,
) -> FitResult:
    """Train dense layers of the given widths on ``(row_id, vec, label)`` with validation, early stop and best weights.

    With a ``state_folder`` every epoch with a gain of the best f1 is stored, and a later call with the same settings,
    layers and numbers of rows goes on from the last one stored. ``stop_after`` leaves the run after that epoch.
    """
    spark, sizes = train.sparkSession, list(sizes)
    store = EpochStore(train, settings, f"{scratch_dir(spark)}/epochs-{uuid.uuid4().hex}")
    held_path = f"{store.folder}/validation"
    validation_rows(val, settings.batch_size, settings.shards).write.parquet(held_path)
    held = spark.read.parquet(held_path)

    steps = store.steps
    optimizer = AdamW(sizes, settings, settings.epochs * steps // settings.accumulate)
    params, best, best_f1 = bp.start_weights(sizes, settings.seed), None, 0.0
    rule = StopRule(settings.patience, settings.delta)
    result = FitResult(sizes)
    done = 0
    state = None
    if state_folder:
        state = TrainingState(spark, state_folder, {"settings": asdict(settings), "sizes": sizes, "rows": store.total, "held": held.count()})
        found = state.load()
        if found:
            done, arrays, result.history, scalars = found
            params, best, optimizer.m, optimizer.v = (arrays[n] for n in ("params", "best", "m", "v"))
            best_f1, rule.best = scalars["best_f1"], scalars["rule_best"]
            optimizer.t, rule.counter = int(scalars["t"]), int(scalars["rule_counter"])

    for epoch in range(done + 1, settings.epochs + 1):
        now = Progress(params, optimizer)
        if store.small:
            for slot in range(-(-steps // SLOT_STEPS)):
                now = train_slot(store.slot(epoch, slot), now, sizes, epoch, steps)
        else:
            for step in range(steps):
                sums = gradient(store.step(epoch, step), now.params, sizes, step_key(settings, epoch, step), settings.dropout, settings.shards)
                now.take(*sums, step == steps - 1)
        params, optimizer, losses = now.params, now.optimizer, now.losses
        metrics = validate(held, bp.split_layers(params, sizes), sizes[0])
        train_loss = float(np.mean(losses)) if losses else None
        result.history.append((epoch, train_loss, *[metrics[c] for c in HISTORY_COLUMNS[2:]]))
        gained = metrics["f1"] > best_f1
        if gained:
            best_f1, best = metrics["f1"], params.copy()
        stops = rule.stops(-metrics["val_loss"] if settings.stop_metric == "loss" else metrics[settings.stop_metric])
        if state and gained:
            scalars = {"best_f1": best_f1, "rule_best": rule.best, "t": optimizer.t, "rule_counter": rule.counter}
            state.save(epoch, {"params": params, "best": best, "m": optimizer.m, "v": optimizer.v}, result.history, scalars)
        if stops or epoch == stop_after:
            break
    result.last = bp.split_layers(params, sizes)
    result.best = bp.split_layers(best, sizes) if best is not None else None
    return result
