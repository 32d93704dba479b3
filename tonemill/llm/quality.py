"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's strength is a linear function of text features. Every preference pair (a document labelled good over
one labelled bad) gives the logistic loss of the difference of their features. The accepted range starts at a
quantile of the training scores: the share of bad documents among the labelled ones.

Every labelled document outside the held-out remainder takes part. Its features are worked out once and stored in blocks of
about ``BLOCK_ROWS`` rows, chosen by a hash of the id; pairs are formed inside a block. Moments, Newton steps and the
threshold add up over all blocks; the driver sees sums of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import id_remainder, in_bitmap, in_remainder, key_bitmap, small_batches, stage

ACCEPT = 0.7
PAIRS_PER_DOC = 8
BLOCK_ROWS = 12_000  # labelled rows of a block, about
RARE_ROWS = 50  # a kind of label with fewer rows than this for each block is compared with every block
DIGIT_BITS = 16  # of a value's code that a pass settles when a quantile is looked for
SYMBOLS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{|}~", np.uint8)
FEATURES = 18


def text_features(text: str | None) -> np.ndarray:
    """Shares of character kinds, word shape and repetition of one whole text; zeros for null or empty text."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    n = len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    letters = max(1, upper + lower + kinds[128:].sum() / 2)
    lines = raw.split(b"\n")
    longest = sum(map(len, lines)) or 1
    shingles = len(words) - 3
    symbols = kinds[SYMBOLS].sum()
    out[:] = (
        upper / letters,
        digits / n,
        symbols / n,
        kinds[33] / len(words),
        kinds[124] / len(words),
        kinds[44] / len(words),
        kinds[46] / len(words),
        np.log1p(len(words)),
        np.log1p(n / len(words)),
        len(set(words)) / len(words) ** 0.9,
        sum(map(len, set(lines))) / longest,
        len(set(zip(words, words[1:], words[2:], words[3:]))) / shingles if shingles > 0 else 1.0,
        np.log1p(len(words) / len(lines)),
        symbols > 0.02 * n,
        upper > 0.3 * letters,
        kinds[33] > 0.1 * len(words),
        max(map(len, words)) > 60,
        sum(a == b for a, b in zip(words, words[1:])) / len(words),
    )
    return out


OUTPUTS = ("held_out", "score", "predicted")


@dataclass(frozen=True)
class PairwiseModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; the score at the threshold is ``ACCEPT``."""
        raw = ((features - self.mean) / self.scale) @ self.weights
        z = (raw - self.threshold) / self.spread + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, y, x)`` of all labelled documents whose id remainder modulo 4 is not 2, stored.

    A document with several labels takes the largest; rows with a null id or label take no part.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_remainder("doc_id", 4) != 2))
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("y"))
    )
    # a bitmap of fixed size keeps most texts without a label out; the join decides, and only features are shuffled
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(usable.select(F.xxhash64("doc_id").alias("id_key")), "id_key"))

    # one Python step: a second one in the same tasks would be a second worker for each core
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[in_bitmap(shared.value, b["id_key"].to_numpy(np.int64))]
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "x": [text_features(t) for t in b["text"]]})

    texts = docs.where(id_remainder("doc_id", 4) != 2).select("doc_id", "text", F.xxhash64("doc_id").alias("id_key"))
    return stage(texts.mapInPandas(features, "doc_id long, x array<double>").join(usable, "doc_id"), "features")


def feature_blocks(rows: DataFrame, sizes: dict[int, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(block, x, y, own)``: rows packed into blocks by a hash of the id, so blocks do not depend on order or partitions.

    Where one kind of label is so rare that a block might lack it, its rows are in every block, and ``own`` in one.
    """
    blocks = max(1, sum(sizes.values()) // block_rows)
    rare = [kind for kind in (0, 1) if 0 < sizes.get(kind, 0) < RARE_ROWS * blocks]
    home = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(blocks)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = rows.withColumn("home", home).withColumn("block", F.explode(F.when(F.col("y").isin(rare), everywhere).otherwise(F.array("home"))))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        x = np.array(b["x"].tolist(), float).reshape(-1, FEATURES)
        order = np.lexsort((*x.T, b["y"], b["doc_id"]))
        y, own = b["y"].to_numpy(np.int32)[order], (b["home"] == b["block"]).to_numpy()[order]
        return pd.DataFrame({"block": [b["block"].iloc[0]], "x": [x[order].tobytes()], "y": [y.tobytes()], "own": [own.tobytes()]})

    return stage(dealt.groupBy("block").applyInPandas(pack, "block int, x binary, y binary, own binary"), "blocks", 16)


BlockNumbers = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def of_blocks(blocks: DataFrame, numbers: BlockNumbers) -> np.ndarray:
    """``numbers(x, y, own)`` of every block, a fixed count of numbers each, in the order of the blocks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(y, np.int32), np.frombuffer(o, bool)) for x, y, o in zip(b["x"], b["y"], b["own"])]
            yield pd.DataFrame({"block": b["block"], "v": [np.ravel(numbers(*part)) for part in parts]})

    with small_batches(blocks.sparkSession, 16):
        rows = blocks.mapInPandas(each, "block int, v array<double>").toArrow()
    values = rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return values[np.argsort(rows["block"].to_numpy())]


def block_pairs(y: np.ndarray, pairs_per_doc: int = PAIRS_PER_DOC) -> tuple[np.ndarray, np.ndarray]:
    """Places of the better and the worse document of a block's pairs; every document is in one pair or more."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    rng = np.random.default_rng(7)
    few, many = sorted((good, bad), key=len)
    count = max(len(many), pairs_per_doc * len(few))
    a, b = np.resize(rng.permutation(many), count), np.resize(rng.permutation(few), count)
    return (a, b) if many is good else (b, a)


def ordered_codes(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def block_quantile(blocks: DataFrame, raw: Callable[[np.ndarray], np.ndarray], total: int, q: float) -> float:
    """The exact quantile of ``raw(x)`` over all own rows, as ``np.quantile`` gives it.

    Passes count the values by the leading digits of their code, so the driver sees counts alone, however many are equal.
    """
    at = q * (total - 1)
    rank, found, known = int(at), 0, 0
    while known < 64:
        rest = 64 - known - DIGIT_BITS

        def count(x, y, own, found=found, known=known, rest=rest):
            code = ordered_codes(raw(x)[own])
            if known:
                code = code[code >> np.uint64(64 - known) == np.uint64(found)]
            return np.bincount((code >> np.uint64(rest) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int64), minlength=1 << DIGIT_BITS)

        upto = np.cumsum(sum_of_counts(blocks, count))
        digit = int(np.searchsorted(upto, rank, side="right"))
        rank -= int(upto[digit - 1]) if digit else 0
        found, known = found << DIGIT_BITS | digit, known + DIGIT_BITS
    bits = np.uint64(found)
    low = float((bits ^ np.uint64(1 << 63) if found >> 63 else ~bits).view(np.float64))
    after = of_blocks(blocks, lambda x, y, own: np.array([(raw(x)[own] <= low).sum(), raw(x)[own & (raw(x) > low)].min(initial=np.inf)]))
    high = low if after[:, 0].sum() > int(at) + 1 or int(at) + 1 >= total else float(after[:, 1].min())
    return float(np.quantile([low, high], at - int(at)))


def sum_of_counts(blocks: DataFrame, count: BlockNumbers) -> np.ndarray:
    """Counts of all blocks added up; only those that are not zero are sent, one row for each place."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y, o in zip(b["x"], b["y"], b["own"]):
                n = count(np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(y, np.int32), np.frombuffer(o, bool))
                yield pd.DataFrame({"k": np.flatnonzero(n), "n": n[n > 0]})

    with small_batches(blocks.sparkSession, 16):
        rows = blocks.mapInPandas(each, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << DIGIT_BITS, np.int64)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit_pairwise(blocks: DataFrame, sizes: dict[int, int], pairs_per_doc: int = PAIRS_PER_DOC, ridge: float = 1e-3) -> PairwiseModel:
    """Newton steps on the mean logistic loss of feature differences, good minus bad, summed over all blocks."""
    total = sum(sizes.values())
    if not total:
        return PairwiseModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    add = lambda numbers: of_blocks(blocks, numbers).sum(axis=0)
    mean = add(lambda x, y, own: x[own].sum(0)) / total
    scale = np.sqrt(add(lambda x, y, own: ((x[own] - mean) ** 2).sum(0)) / total) + 1e-9
    weights = np.zeros(FEATURES)
    if not sizes.get(0) or not sizes.get(1):
        return PairwiseModel(mean, scale, weights, 0.0, 1.0)
    for _ in range(25):

        def newton(x, y, own, weights=weights):
            better, worse = block_pairs(y, pairs_per_doc)
            z = (x - mean) / scale
            diff = z[better] - z[worse]
            p = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))  # chance that the pair is ordered wrongly
            return np.r_[diff.T @ p, np.ravel((diff * (p * (1 - p))[:, None]).T @ diff), len(better)]

        sums = add(newton)
        count = sums[-1]
        gradient = sums[:FEATURES] / count - ridge * weights
        hessian = sums[FEATURES:-1].reshape(FEATURES, FEATURES) / count + ridge * np.eye(FEATURES)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    raw = lambda x: ((x - mean) / scale) @ weights
    centre = add(lambda x, y, own: np.sort(raw(x)[own]).sum()) / total
    spread = np.sqrt(add(lambda x, y, own: ((np.sort(raw(x)[own]) - centre) ** 2).sum()) / total)
    threshold = block_quantile(blocks, raw, total, sizes[0] / total)
    return PairwiseModel(mean, scale, weights, threshold, float(spread[0] / 4 + 1e-9))


def fit_quality(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> PairwiseModel:
    """Fit on all labelled documents whose id remainder modulo 4 is not 2.

    Features are computed by Spark and stay there; the driver sees sums over blocks. Without labels of both kinds there is
    no preference: every document then scores ``ACCEPT`` and is kept.
    """
    rows = labelled_features(docs, labels)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return fit_pairwise(feature_blocks(rows, sizes, block_rows), sizes)


def score_quality(docs: DataFrame, model: PairwiseModel, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, held_out, score, predicted.

    Null and empty texts have all-zero features and are scored like any other; a null id is not held out; equal
    texts get equal scores; very long texts are read whole; an empty table gives no rows. Extra columns are dropped unless
    named in ``keep``, where names of the results are left out: pass such columns inside a struct.
    """
    cols = keep or ["doc_id"]

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            x = np.array([text_features(v) for v in t], float).reshape(-1, FEATURES)
            yield pd.Series(model.score(x))

    held_out = in_remainder("doc_id", 4, 2).alias("held_out")
    scored = docs.select(*[c for c in cols if c not in OUTPUTS], held_out, score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
