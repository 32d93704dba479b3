"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is kept as a fingerprint. Two texts that share a run of
``WINDOW`` words then share a fingerprint inside it, whatever surrounds the run. Fingerprints of documents and
benchmark items are joined, and every hit is extended word by word on both sides; words in a run of ``WINDOW`` equal
words are contaminated. Items of fewer words are looked up as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import in_bitmap, key_bitmap, stage

WINDOW = 10
K = 5
SALTS = 16
PRINTS = pa.list_(pa.struct([("hash", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("near", pa.list_(pa.binary())), ("at", pa.int32())]))
CACHE_WORDS = 100_000

# A-Z to a-z; every other ASCII character that is no letter or digit to a blank
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of one whole text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash (the rightmost of equal ones) of every ``width`` consecutive hashes."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.unique(np.arange(len(windows)) + width - 1 - np.argmin(windows[:, ::-1], axis=1))


def fingerprints(words: list[bytes], hashes: WordHashes, whole: tuple[int, ...] | None) -> list[tuple[int, int, int, int]]:
    """``(hash, place, length, kind)`` of a text: k-grams kept by winnowing (kind 0), and runs for short items.

    ``whole``: lengths of short items to look for at every place of a document; None for an item, which is itself one
    run if it is shorter than ``WINDOW``.
    """
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    if whole is None and 0 < len(words) < WINDOW:
        return [(int(gram_hashes(h, len(words))[0]), 0, len(words), len(words))]
    grams = gram_hashes(h, K)
    kept = [(int(grams[p]), int(p), K, 0) for p in winnow(grams, WINDOW - K + 1)]
    for m in whole or ():
        kept += [(int(g), p, m, m) for p, g in enumerate(gram_hashes(h, m))]
    return kept



def _context(words: list[bytes], place: int, length: int) -> tuple[list[bytes], int]:
    """The run with the words around it that a window can reach, and where the run starts in them."""
    reach = WINDOW - K if length == K else 0
    start = max(0, place - reach)
    return words[start : place + length + reach], place - start


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """Fingerprints of all items that have an id and words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["text"]):
                words = words_of(text)
                for h, place, length, kind in fingerprints(words, hashes, None):
                    near, at = _context(words, place, length) if kind == 0 else (words, 0)
                    rows.append((item, _signed(h), kind, near, at))
            yield pd.DataFrame(rows, columns=["item_id", "hash", "kind", "item_near", "item_at"])

    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    schema = "item_id long, hash long, kind int, item_near array<binary>, item_at int"
    return stage(items.mapInPandas(make, schema).distinct(), "items")


OUTPUTS = ("n_words", "spans", "items", "n_hit", "n_items", "contaminated")


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, n_words, spans, items, n_hit, n_items, contaminated.

    spans are the merged ranges of hit words, ``[start, end)``; items the ids of items with an occurring window, in
    string order. Null and empty texts have no words and no hits. Items with a null id or no words take no part;
    rows that repeat an item id add their windows to it. Repeated documents are each reported, very long ones are read
    whole, ids of any size and null go through unchanged, and an empty table gives no rows. Columns in ``keep`` may have any
    name but those of the results, which are left out: pass such columns inside a struct.
    """
    cols = [c for c in keep or ["doc_id"] if c not in OUTPUTS]
    prints = item_fingerprints(benchmark)
    lengths = tuple(sorted(r["kind"] for r in prints.where("kind > 0").select("kind").distinct().collect()))  # at most WINDOW - 1
    # a bitmap of fixed size keeps hashes that no item has out of the shuffle
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(prints, "hash"))
    # The kept columns are one struct until the end, so their names meet no other, and stay in Arrow.
    doc = F.struct(*cols).alias("_doc")
    doc_type = docs.select(doc).schema["_doc"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), shared.value
        for b in batches:
            counts, found = [], []
            for text in b.column("_text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                rows = []
                if words:
                    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
                    grams = gram_hashes(h, K)
                    places = winnow(grams, WINDOW - K + 1)
                    runs = [(0, K, grams, places[in_bitmap(bits, grams[places])])]
                    for m in lengths:
                        g = gram_hashes(h, m)
                        runs.append((m, m, g, np.flatnonzero(in_bitmap(bits, g))))
                    for kind, length, g, at in runs:
                        for p in at:
                            near, start = _context(words, int(p), length) if kind == 0 else (words[p : p + length], 0)
                            rows.append({"hash": _signed(int(g[p])), "kind": kind, "place": int(p), "near": near, "at": start})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(counts, pa.int64()), pa.array(found, PRINTS)], ["_doc", "_words", "_prints"])

    kind = "array<struct<hash:long,kind:int,place:int,near:array<binary>,at:int>>"
    scanned = docs.select(doc, F.col("text").alias("_text")).mapInArrow(scan, f"_doc {doc_type}, _words long, _prints {kind}")
    scanned = stage(scanned.withColumn("_row", F.monotonically_increasing_id()), "scanned")

    asked = scanned.select("_row", F.explode("_prints").alias("p")).select("_row", "p.*").withColumn("salt", F.pmod(F.xxhash64("_row", "place"), F.lit(SALTS)))
    copies = prints.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = asked.join(copies, ["hash", "kind", "salt"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, kind_, place, near, at, item, other, there in zip(*(b[c] for c in ("_row", "kind", "place", "near", "at", "item_id", "item_near", "item_at"))):
                near, other = list(near), list(other)
                if kind_:
                    if near == other:
                        rows.append((row, item, place, place + len(near)))
                    continue
                if near[at : at + K] != other[there : there + K]:
                    continue
                left, right = 0, K
                while left < min(at, there) and near[at - left - 1] == other[there - left - 1]:
                    left += 1
                while right < min(len(near) - at, len(other) - there) and near[at + right] == other[there + right]:
                    right += 1
                if left + right >= WINDOW:
                    rows.append((row, item, place - left, place + right))
            yield pd.DataFrame(rows, columns=["_row", "item_id", "start", "stop"])

    hits = met.select("_row", "kind", "place", "near", "at", "item_id", "item_near", "item_at").mapInPandas(extend, "_row long, item_id long, start int, stop int")
    ranges = F.array_sort(F.collect_set(F.struct("start", "stop")))
    merged = F.aggregate(
        "ranges",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    found = (
        hits.groupBy("_row")
        .agg(ranges.alias("ranges"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select("_row", merged.alias("spans"), "items")
    )
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    out = scanned.join(found, "_row", "left").select(*[F.col("_doc").getField(c).alias(c) for c in cols], F.col("_words").alias("n_words"), spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
