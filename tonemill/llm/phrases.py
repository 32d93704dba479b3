"""Phrase collocation mining by SON partitioning.

A shard is what one task holds of the texts, at most ``SHARD_BYTES``. Pass one mines every shard completely, length by
length, at the support lowered to the shard's share of the language's bytes: shares add up to one, so a phrase that is
frequent over all is frequent in one shard at least. Where it is not reported it has less than the local support, which
bounds its count over all from above; the union keeps the phrases whose bound reaches the support, and travels as a
bitmap of fixed size. Pass two counts, in every shard, all phrases whose bit is set, and Spark adds the counts up: they
are exact, and a phrase whose bit is set by chance is counted just as exactly and then dropped for its support.

Words become numbers and a phrase of k words the number of its first k - 1 words with its last word, so nothing is
compared by hash. No key holds a language: one language with most of the text is spread like the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.common import LOWER_ASCII, key_bitmap, in_bitmap, small_batches, stage

LONGEST = 5
SUPPORT = 100
TOP = 2000
SHARD_BYTES = 48 << 20  # of text; bounds a task's memory
# Local support is lowered to this part of the proportional one: shards report more, and the bound gets closer.
LOWERED = 0.5
BUCKET_BYTES = 4 << 20  # of text for each bucket of reported phrases
CANDIDATE_BITS = 1 << 26
NO_LANG = "und"

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(10 if b in _SEPARATORS else 32 if b == 9 else LOWER_ASCII[b] for b in range(256))
_GAP = 0  # number of the mark between pieces
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers of words in the order of their first use; the mark between pieces is 0 and nothing is -1."""

    def __init__(self) -> None:
        super().__init__({b"\n": _GAP, b"": -1})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Shard:
    """Texts of one shard as word numbers, by language."""

    def __init__(self) -> None:
        self.numbers, self.texts, self.bytes, self.total = _Numbers(), {}, {}, 0

    def add(self, lang: str, text: bytes) -> None:
        tokens = (text.translate(_TABLE) + b"\n").replace(b"\n", b" \n ").split(b" ")
        numbers = self.numbers
        ids = np.fromiter((numbers[t] for t in tokens), np.int32, len(tokens))
        self.texts.setdefault(lang, []).append(ids[ids >= 0])
        self.bytes[lang] = self.bytes.get(lang, 0) + len(text)
        self.total += len(text)

    def phrases(self, lang: str, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length the kept phrases: ``(place of one occurrence, count, hash)``.

        ``keep(hashes, counts)`` says which distinct phrases stay. A longer phrase is looked at only where both its
        parts, without the last and without the first word, were kept.
        """
        ids = np.concatenate(self.texts[lang])
        salt = xxhash.xxh3_64_intdigest(lang.encode())
        word_hash = np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in self.numbers.words), np.uint64, len(self.numbers.words))
        count = np.bincount(ids, minlength=len(word_hash))
        count[_GAP] = 0
        here = np.flatnonzero(count)
        kept = np.zeros(len(word_hash), bool)
        kept[here[keep(word_hash[here], count[here])]] = True
        first = np.zeros(len(word_hash), np.int64)
        first[ids[::-1]] = np.arange(len(ids))[::-1]
        of = np.flatnonzero(kept)
        yield first[of], count[of], word_hash[of]

        # the phrase at a place: its number, or -1
        renamed = np.full(len(word_hash), -1, np.int64)
        renamed[of] = np.arange(len(of))
        word = renamed[ids]
        now, hashes, words = word, word_hash[of], max(1, len(of))
        for k in range(2, LONGEST + 1):
            at = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
            at = at[at + k - 1 < len(ids)]
            if not len(at):
                return
            key = now[at] * words + word[at + k - 1]
            distinct, where, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            h = (hashes[distinct // words] * _MIX) ^ (word_hash[of][distinct % words] + np.uint64(k))
            h ^= h >> np.uint64(29)
            good = keep(h, n)
            number = np.cumsum(good) - 1
            after = np.full(len(now), -1, np.int64)
            after[at] = np.where(good[inverse], number[inverse], -1)
            now, hashes = after, h[good]
            yield at[where[good]], n[good], hashes

    def spell(self, lang: str, places: np.ndarray, k: int) -> list[str]:
        ids, words = np.concatenate(self.texts[lang]), self.numbers.words
        return [b" ".join([words[i] for i in ids[p : p + k]]).decode("utf-8", "replace") for p in places]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The texts of a task as shards of bounded size; a longer text is a shard of its own."""
    shard = Shard()
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for lang, text in zip(langs, texts):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            if shard.total and shard.total + len(raw) > SHARD_BYTES:
                yield shard
                shard = Shard()
            shard.add(lang, raw)
    if shard.texts:
        yield shard


def local_support(support: int, part: int, whole: int) -> int:
    """The least count that a shard with ``part`` of ``whole`` bytes reports, at most its share of the support."""
    return max(1, ceil(Fraction(support * part, max(1, whole)) * Fraction(LOWERED)))


TOTAL = -1  # the bucket of the numbers of words


def bucket_count(sizes: dict[str, int]) -> int:
    return max(1, -(-sum(b or 0 for b in sizes.values()) // BUCKET_BYTES))


def dealt(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with the places of their hashes."""
    bucket = (h >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edge[b] < edge[b + 1]:
            yield b, order[edge[b] : edge[b + 1]]


def _packed(lang: str, bucket: int, texts: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """Phrases of a shard and bucket as one row; no phrase holds a line end."""
    blob = zstandard.compress("\n".join(texts).encode(), 1)
    values = [pa.array([lang]), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, ["lang", "bucket", "phrases", "counts"])


def candidates(rows: DataFrame, support: int, sizes: dict[str, int]) -> DataFrame:
    """``h``: hashes of phrases whose count may reach ``support``.

    A shard reports a phrase of count c by c less what a phrase it does not report can have at most, and for every
    language the sum of those maxima; what is reported over all shards then has to reach the support less that sum.
    """
    buckets = bucket_count(sizes)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            for lang in shard.texts:
                least = local_support(support, shard.bytes[lang], sizes.get(lang) or 0)
                found = [(h, n) for _, n, h in shard.phrases(lang, lambda _, n: n >= least)]  # noqa: B023
                h, n = (np.concatenate(c) for c in zip(*found))
                bucket = (h >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                h, n, bucket = h[order], np.minimum(n[order] - (least - 1), support).astype(np.int32), bucket[order]
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in range(buckets):  # every bucket hears of the shard, also of one that reports nothing
                    part = slice(edge[b], edge[b + 1])
                    values = [pa.array([lang]), pa.array([b], pa.int32()), pa.array([least - 1]), *[pa.array([a[part].tobytes()], pa.binary()) for a in (h, n)]]
                    yield pa.RecordBatch.from_arrays(values, ["lang", "bucket", "hidden", "h", "over"])

    def union(table: pa.Table) -> pa.Table:
        need = support - sum(table.column("hidden").to_pylist())
        h, over = (np.concatenate([np.frombuffer(v, t) for v in table.column(c).to_pylist()]) for c, t in (("h", np.uint64), ("over", np.int32)))
        order = np.argsort(h)
        h, over = h[order], over[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        total = np.add.reduceat(over, start) if len(h) else over
        return pa.table({"h": h[start][total >= need].view(np.int64)})

    reported = rows.mapInArrow(mine, "lang string, bucket int, hidden long, h binary, over binary")
    return reported.groupBy("lang", "bucket").applyInArrow(union, "h long")


def phrase_counts(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``(lang, phrase, words, f)`` of all phrases of 1 to 5 words with ``f >= support``, and ``(lang, null, 0, n)``.

    ``n`` is the number of word occurrences of the language. All counts are exact.
    """
    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    sizes = {r["lang"]: r["b"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()}

    with small_batches(docs.sparkSession):
        bits = key_bitmap(candidates(rows, support, sizes), F.col("h"), CANDIDATE_BITS)
    shipped = docs.sparkSession.sparkContext.broadcast(bits)
    buckets = bucket_count(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidate = shipped.value
        for shard in shards(batches):
            for lang in shard.texts:
                total = sum(np.count_nonzero(ids) for ids in shard.texts[lang])
                yield _packed(lang, TOTAL, [""], np.array([total], np.int64))
                found: dict[int, tuple[list[str], list[np.ndarray]]] = {}
                for k, (place, n, h) in enumerate(shard.phrases(lang, lambda h, _: in_bitmap(candidate, h)), 1):
                    spelled = shard.spell(lang, place, k)
                    for b, part in dealt(h, buckets):
                        texts, counts = found.setdefault(b, ([], []))
                        texts += [spelled[i] for i in part.tolist()]
                        counts.append(n[part])
                for b, (texts, counts) in found.items():
                    yield _packed(lang, b, texts, np.concatenate(counts))

    def add(table: pa.Table) -> pa.Table:
        lang, bucket = table.column("lang")[0].as_py(), table.column("bucket")[0].as_py()
        total: dict[str, int] = {}
        for texts, counts in zip(table.column("phrases").to_pylist(), table.column("counts").to_pylist()):
            for phrase, n in zip(zstandard.decompress(texts).decode().split("\n"), np.frombuffer(counts, np.int64).tolist()):
                total[phrase] = total.get(phrase, 0) + n
        if bucket == TOTAL:
            return pa.table({"lang": [lang], "phrase": pa.array([None], pa.string()), "words": pa.array([0], pa.int32()), "f": [total[""]]})
        kept = [(p, n) for p, n in total.items() if n >= support]
        texts = [p for p, _ in kept]
        return pa.table(
            {
                "lang": pa.array([lang] * len(kept), pa.string()), "phrase": pa.array(texts, pa.string()),
                "words": pa.array([p.count(" ") + 1 for p in texts], pa.int32()), "f": pa.array([n for _, n in kept], pa.int64()),
            }
        )

    parts = rows.mapInArrow(count, "lang string, bucket int, phrases binary, counts binary")
    counted = stage(parts.groupBy("lang", "bucket").applyInArrow(add, "lang string, phrase string, words int, f long"), "phrases")
    shipped.unpersist()
    return counted


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces and those into words; phrases have 2
    to 5 words. The score of a phrase is that of its weakest cut, ``floor(1000 * a * n / (l * r))``. A phrase that never
    occurs outside a longer one is left out. A null language is ``und`` (one with a language of that name), a null text
    is empty, equal rows count as often as they occur, ids do not matter, and extra columns are not read. An empty table
    gives no rows. Texts are read whole; a very long one is a shard of its own.
    """
    counts = phrase_counts(docs, support)
    phrases = counts.where("phrase IS NOT NULL")
    long = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ", -1)

    inside = long.where("words > 2").select(
        "lang",
        F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"),
        "a",
    )
    cover = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_cover"))
    # A phrase inside a longer one with its count is inside one that is a single word longer, too.
    free = long.join(cover, ["lang", "phrase"], "left").where(F.col("_cover").isNull() | (F.col("_cover") < F.col("a"))).drop("_cover")

    cut = free.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    known = phrases.where(F.col("words") < LONGEST)
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    totals = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    cut = cut.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    weakest = cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("_w")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        weakest.select("lang", "phrase", "_w.a", "_w.l", "_w.r", "_w.n", "_w.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
