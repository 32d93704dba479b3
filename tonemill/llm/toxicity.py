"""Toxicity: restore obfuscated words with a noisy-channel Viterbi decoder, then score the restored text.

The source model is a character trigram model counted over all documents. The channel turns letters into look-alike
characters, puts separators or white space between letters and repeats letters. A token that the channel cannot have
changed has a lattice of one path and is its own restoration; every other token is decoded. Punctuation at either end
may be look-alikes or outer punctuation: both are paths, and the character model chooses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import FIT_ROWS, in_remainder, labelled_sample, small_batches

TOXIC = 0.7
MIN_SUPPORT = 4  # toxic training documents with different texts a feature must occur in
MAX_FEATURES = 2048
CACHE_WORDS = 400_000

# Look-alike characters and the letters they may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
SEPARATORS = " .-_*~'^`/"
SUBSTITUTED, DELETED, COLLAPSED, KEPT = -1.0, -0.4, -0.3, -7.0

# Byte classes of the character model: 0 boundary, 1-26 letters, then one class for every four non-ASCII bytes.
ALPHABET = 27 + 32
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128) >> 2)


def trigram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigrams of letter classes of all texts of a partition; what is not a letter is a boundary."""
    total = np.zeros(ALPHABET**3, np.int64)
    for b in batches:
        for t in b["text"]:
            c = _CLASS[np.frombuffer(b"  " + (t or "").encode("utf-8", "replace") + b"  ", np.uint8)]
            keys = (c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:]
            total += np.bincount(keys[(c[1:-1] > 0) | (c[2:] > 0)], minlength=len(total))
    found = np.flatnonzero(total)
    yield pd.DataFrame({"key": found, "n": total[found]})


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(third | first two) of letter classes over all documents; a table of 59^3 numbers at any size."""
    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInPandas(trigram_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    tri = np.zeros(ALPHABET**3)
    tri[rows["key"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    tri = tri.reshape(ALPHABET, ALPHABET, ALPHABET)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    base = (uni + 1) / (uni.sum() + ALPHABET)
    two = (bi + 5 * base) / (bi.sum(1, keepdims=True) + 5)
    return np.log((tri + 5 * two[None]) / (tri.sum(2, keepdims=True) + 5)).astype(np.float32)


_RUN = re.compile(r"(.)\1*", re.S)
_TWICE = re.compile(r"(.)\1", re.S)


@lru_cache(4096)
def _classes(piece: str) -> tuple[int, ...]:
    return tuple(int(k) for k in _CLASS[list(piece.encode("utf-8", "replace"))])


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every run of equal characters the strings it may stand for, with their channel log-probability."""
    columns: list[list[tuple[str, float]]] = []
    for m in _RUN.finditer(token):
        c, n = m[1], len(m[0])
        if c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c + c, 0.0)] if n == 2 else [(c, COLLAPSED), (c + c, COLLAPSED)]
            if n == 2:
                options.append((c, COLLAPSED - 1.0))
        else:
            options = [("", DELETED * n)] if c in SEPARATORS else []
            for letter in LOOKALIKE.get(c, ""):
                options.append((letter * min(n, 2), SUBSTITUTED * min(n, 2)))
                if n > 1:
                    options.append((letter, SUBSTITUTED + COLLAPSED))
            options.append((" ", KEPT * min(n, 2)))
        columns.append(options)
    return columns


def best_path(columns: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The most likely clear text of a lattice; kept separators come out as blanks."""
    value = model.item
    # a state is the last two classes, as one number
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for options in [*columns, [(" ", 0.0)]]:
        following: dict[int, tuple[float, tuple]] = {}
        for piece, cost in options:
            codes = _classes(piece)
            for state, (score, path) in states.items():
                total = score + cost
                for k in codes:
                    b = state % ALPHABET
                    if b or k:  # a blank after a blank says nothing
                        total += value(state * ALPHABET + k)
                        state = b * ALPHABET + k
                if state not in following or total > following[state][0]:
                    following[state] = (total, (path, piece) if piece else path)
        states = following
    path, out = max(states.values(), key=lambda s: s[0])[1], []
    while path:
        path, piece = path
        out.append(piece)
    return "".join(reversed(out)).strip()


def viterbi(token: str, model: np.ndarray) -> str:
    """The most likely clear text of a token without outer punctuation."""
    return best_path(lattice(token), model)


EDGE = "".join(map(chr, range(33, 48))).replace("@", "") + ":;<=>?[\\]^_`{|}~«»“”‘’…¡¿"
# Look-alikes that are not usual before and behind a word: leaving them out costs as much as keeping a separator.
ODD_BEFORE, ODD_BEHIND = "!|+$", "#|+$("


def edge_lattice(piece: str, odd: str) -> list[list[tuple[str, float]]]:
    """For every run of equal characters around a word: nothing, or the letters it may stand for."""
    columns: list[list[tuple[str, float]]] = []
    for m in _RUN.finditer(piece):
        c, n = m[1], len(m[0])
        options = [("", KEPT * min(n, 2) if c in odd else 0.0)]
        for letter in LOOKALIKE.get(c, ""):
            options.append((letter * min(n, 2), SUBSTITUTED * min(n, 2)))
            if n > 1:
                options.append((letter, SUBSTITUTED + COLLAPSED))
        columns.append(options)
    return columns


def restore(token: str, model: np.ndarray) -> str:
    """Restoration of one lower-case token: its lattice is decoded if it has more than one path."""
    if token.isalpha() and not _TWICE.search(token):
        return token  # letters that differ from their neighbours: one path
    core = token.strip(EDGE)
    if not any(c.isalpha() for c in core):
        return core
    start = token.index(core)
    if core.isalpha() and not _TWICE.search(core) and LOOKALIKE.keys().isdisjoint(token[:start] + token[start + len(core) :]):
        return core
    before, behind = edge_lattice(token[:start], ODD_BEFORE), edge_lattice(token[start + len(core) :], ODD_BEHIND)
    columns = [*before, *lattice(core), *behind]
    if all(len(options) == 1 for options in columns):
        return core
    return best_path(columns, model)


def spaced_piece(token: str) -> str | None:
    """The character of a token of one (repeated) character and outer punctuation; None for any other token."""
    core = token.strip(EDGE) or token
    return core if core == core[0] * len(core) else None


class Restorer:
    """What is found in the restored words of texts: the words themselves, or what ``of`` makes of each.

    Every different token is restored once while it is remembered; tokens in which nothing is found cost one look-up.
    """

    def __init__(self, model: np.ndarray, of: Callable[[str], Iterable[str]] | None = None):
        self.model, self.of = model, of or (lambda word: (word,))
        self.tokens: dict[str, tuple[tuple[str, ...], str | None] | None] = {}

    def items(self, clear: str) -> tuple[str, ...]:
        return tuple(i for w in clear.split() for i in self.of(w))

    def learn(self, raw: str) -> tuple[tuple[str, ...], str | None] | None:
        """Items of a token and its piece of a spaced run; None without either."""
        if len(self.tokens) > CACHE_WORDS:
            self.tokens.clear()
        # most words have two different letters in front and need no closer look
        piece = None if len(raw) > 1 and raw[0] != raw[1] and raw[0].isalpha() and raw[1].isalpha() else spaced_piece(raw)
        items = self.items(restore(raw, self.model))
        self.tokens[raw] = entry = (items, piece) if items or piece is not None else None
        return entry

    def run(self, pieces: list[str], found: set[str]) -> None:
        """Three or more pieces in a row, whatever white space parts them, are one word or several."""
        if len(pieces) > 2 and any(c.isalpha() for piece in pieces for c in piece):
            found.update(self.items(viterbi(" ".join(pieces), self.model)))

    def found(self, text: str | None) -> set[str]:
        """Distinct items of one whole text."""
        found: set[str] = set()
        pieces: list[str] = []
        tokens = self.tokens
        for raw in (text or "").lower().split():
            entry = tokens[raw] if raw in tokens else self.learn(raw)
            if entry is None:
                if pieces:
                    self.run(pieces, found)
                    pieces = []
                continue
            items, piece = entry
            found.update(items)
            if piece is not None:
                pieces.append(piece)
            elif pieces:
                self.run(pieces, found)
                pieces = []
        self.run(pieces, found)
        return found


def word_features(word: str) -> list[str]:
    """The word and its beginnings of four, five and six letters: inflected forms share them."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


@dataclass(frozen=True)
class ToxicityModel:
    characters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0

    def restorer(self) -> Restorer:
        """Finds a text's features that have a weight."""
        return Restorer(self.characters, lambda word: [f for f in word_features(word) if f in self.weights])

    def score(self, texts: list[str | None], restorer: Restorer) -> list[float]:
        out = []
        for text in texts:
            z = self.bias + sum(self.weights[f] for f in sorted(restorer.found(text)))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def _fit(rows: list[list[int]], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse binary features by gradient steps with momentum."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    weights, bias, speed = np.zeros(size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(size + 1)
    start = bias
    common = np.maximum(1, np.bincount(feature, minlength=size))
    for _ in range(300):
        z = bias + np.bincount(doc, weights[feature], len(rows))
        error = y - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gradient = np.append((np.bincount(feature, error[doc], size) - 0.05 * weights) / np.sqrt(common), error.sum() / len(rows))
        speed = 0.9 * speed + 0.1 * gradient
        weights, bias = weights + 0.5 * speed[:-1], min(start, bias + speed[-1])
    return weights, bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Character model over all documents; word weights from about ``fit_rows`` labelled ones outside the held-out third.

    Without labels of both kinds every document scores near 0.
    """
    characters = character_model(docs)
    sample = labelled_sample(docs, labels, "toxic", 3, 1, fit_rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(characters, word_features)
        for b in batches:
            found = [sorted(restorer.found(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "f": found})

    rows = sample.dropDuplicates(["text", "y"]).mapInPandas(features, "doc_id long, y int, f array<string>").persist()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        rows.unpersist()
        return ToxicityModel(characters)
    best = (
        rows.select("y", F.explode("f").alias("f"))
        .groupBy("f")
        .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
        .where(F.col("p") >= MIN_SUPPORT)
        .withColumn("gain", F.col("p") * F.log((F.col("p") + 0.5) / (F.col("n") + 0.5) * (sizes[0] + 1.0) / (sizes[1] + 1.0)))
        .where(F.col("gain") > F.col("p"))
        .orderBy(F.desc("gain"), "f")
        .limit(MAX_FEATURES)
        .select("f")
        .toPandas()["f"]
        .tolist()
    )
    chosen = F.array(*map(F.lit, best)) if best else F.array().cast("array<string>")
    data = rows.select("doc_id", "y", F.array_intersect("f", chosen).alias("f")).toPandas().sort_values(["doc_id", "y"], kind="stable")
    rows.unpersist()
    place = {f: k for k, f in enumerate(best)}
    weights, bias = _fit([[place[f] for f in r] for r in data["f"]], data["y"].to_numpy(float), len(best))
    return ToxicityModel(characters, {f: float(w) for f, w in zip(best, weights) if w}, bias)


OUTPUTS = ("held_out", "score", "predicted")


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, held_out, score, predicted.

    Null and empty texts score the bias alone; a null id is not held out; equal texts get equal scores; very long texts are
    read whole; an empty table gives no rows. Extra columns are dropped unless named in ``keep``, where names of the results
    are left out: pass such columns inside a struct.
    """
    cols = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 59^3 numbers and at most MAX_FEATURES weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = shared.value.restorer()
        for t in texts:
            yield pd.Series(shared.value.score(list(t), restorer), dtype=float)

    held_out = in_remainder("doc_id", 3, 1).alias("held_out")
    scored = docs.select(*[c for c in cols if c not in OUTPUTS], held_out, score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def restore_text(docs: DataFrame, characters: np.ndarray) -> DataFrame:
    """``doc_id`` and the restored words of every text, sorted; null and empty texts give an empty array."""

    @F.pandas_udf("array<string>")
    def restored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(characters)
        for t in texts:
            yield pd.Series([sorted(restorer.found(v)) for v in t], dtype=object)

    return docs.select("doc_id", restored("text").alias("words"))


