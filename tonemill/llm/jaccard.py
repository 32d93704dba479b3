"""N-gram Jaccard join: sets of word shingles that overlap by 80 % or more are linked.

Candidates meet in tiles of one prefix shingle and one size band. Inside a tile, bit counts of hashed bitmap
signatures bound the overlap from above; pairs that pass are decided by exact intersection of sorted arrays.

Equal sets are one entry. Every member of a tile is compared first with one member of it, chosen by a hash, and linked
only after exact verification. That decides tiles of two; larger tiles whose entries then belong to one component need
no comparison. So a large group of near copies costs links in proportion to its size, and nothing is lost: linked sets
share a prefix shingle, and where a tile holds several components its pairs are compared across them.

Shingles have one order, so the first shingle that two sets share has nothing in common before it: what both still hold from
there on bounds their overlap. A tile compares only sets whose places of its shingle leave room for a link; linked sets have it
where they meet first. Frequent shingles come last, so the larger a group, the fewer of its unlinked members meet. Of a run of
shared shingles only the first makes a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.llm.brown import split_words
from tonemill.llm.common import in_bitmap, key_bitmap, small_batches, stage
from tonemill.llm.components import connected_components
from tonemill.llm.winnow import WordHashes, gram_hashes

SHINGLE = 5
PERCENT = 80
SKETCH = 1 << 18  # counters that order shingles from rare to frequent
CENTRES = 4  # orders in which tiles choose the member that others are compared with first
BIT_WORDS = 8  # signature of 512 bits, carried by tiles
WIDE_WORDS = 32  # signature of 2,048 bits, more for sets of over 1,024, for pairs that pass the first


def shingle_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of a text's shingles in order; a shorter text is one shingle, an empty one has none."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    return gram_hashes(h, min(SHINGLE, len(words)))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, hashes))


def _sketch_place(shingles: np.ndarray) -> np.ndarray:
    return ((shingles >> np.uint64(20)) % np.uint64(SKETCH)).astype(np.int64)


def prefix_length(n: int) -> int:
    """Shingles of a set, rarest first, of which a linked set must contain one."""
    return n - (n * PERCENT + 99) // 100 + 1


def wide_words(n: int) -> int:
    """Words of a set's wide signature: a power of two, with two bits or more for each shingle."""
    return max(WIDE_WORDS, 1 << (2 * n - 1).bit_length() >> 6)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles fall in each of ``SKETCH`` hash classes, over all documents.

    Any order of shingles is right for the prefix; this one keeps frequent passages out of it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = WordHashes(), np.zeros(SKETCH, np.int64)
        held: list[np.ndarray] = []
        waiting = 0
        for b in batches:
            for t in b["text"]:
                held.append(_sketch_place(shingle_hashes(t, hashes)))
                waiting += len(held[-1])
                if waiting > 4 * SKETCH:
                    total += np.bincount(np.concatenate(held), minlength=SKETCH)
                    held, waiting = [], 0
        total += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=SKETCH)
        yield pd.DataFrame({"k": np.arange(0, SKETCH, 1024), "n": [part.tolist() for part in total.reshape(-1, 1024)]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1024, np.int64)
        for f in frames:
            for n in f["n"]:
                total += n
        yield pd.DataFrame({"k": [key[0]], "n": [total.tolist()]})

    parts = docs.select("text").mapInPandas(count, "k long, n array<long>")
    with small_batches(docs.sparkSession):
        rows = parts.groupBy("k").applyInPandas(add, "k long, n array<long>").toArrow()
    out = np.zeros(SKETCH, np.int64)
    for k, n in zip(rows["k"].to_pylist(), rows["n"]):
        out[k : k + 1024] = n.values.to_numpy()
    return out


def describe_sets(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n, set key, signature words and prefix shingles.

    Of equal sets in a task the first has the prefix, so that many copies are not many rows of a shingle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int64))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, met = WordHashes(), set()
        for b in batches:
            for start in range(0, len(b), 1000):
                part = b.iloc[start : start + 1000]
                rows = []
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    s = shingle_set(text, hashes)
                    if not len(s):
                        rows.append((doc_id, 0, None, None, None, None))
                        continue
                    key = xxhash.xxh3_64_intdigest(s.tobytes(), seed=5)
                    wide = np.zeros(wide_words(len(s)) * 64, np.uint8)
                    wide[(s & np.uint64(len(wide) - 1)).astype(np.int64)] = 1
                    bits = wide.reshape(-1, BIT_WORDS * 64).max(0)
                    prefix = None
                    if key not in met:
                        met.add(key)
                        order = np.argsort(shared.value[_sketch_place(s)], kind="stable")  # equal counts: by hash
                        prefix = s[order[: prefix_length(len(s))]].view(np.int64)
                    signature, broad = (np.packbits(v, bitorder="little").view(np.int64) for v in (bits, wide))
                    rows.append((doc_id, len(s), np.uint64(key).astype(np.int64), signature, broad, prefix))
                frame = pd.DataFrame(rows, columns=["doc_id", "n", "set_key", "bits", "wide", "prefix"])
                # a plain column of numbers and nulls would become floating point and lose digits
                frame["set_key"] = pd.array([None if r[2] is None else int(r[2]) for r in rows], dtype="Int64")
                yield frame

    # ids go through Python as text: numbers beside nulls would become floating point and lose digits
    kind = "doc_id string, n long, set_key long, bits array<long>, wide array<long>, prefix array<long>"
    described = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(describe, kind)
    return described.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def may_link(n1: str, n2: str, differing: Column) -> Column:
    """Whether sizes and signatures leave room for a link: differing bits are differing shingles."""
    room = (F.col(n1) + F.col(n2)) * (100 - PERCENT) - differing * (100 + PERCENT) >= 0
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT) & room


def places_leave_room(n1: str, at1: str, n2: str, at2: str) -> Column:
    """Whether two sets, if they share nothing before the places ``at1`` and ``at2``, can still overlap enough."""
    left = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))
    return left * (100 + PERCENT) >= (F.col(n1) + F.col(n2)) * PERCENT


def differing_bits(pairs: list[tuple[str, str]]) -> Column:
    counts = [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in pairs]
    return sum(counts[1:], counts[0])


def verify(pairs: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of set keys whose sets are linked, by intersection of their sorted shingle arrays.

    Of the documents, one that has each set in question is read again.
    """
    wanted = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct()
    held = described.join(wanted, "set_key").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    ids = stage(held.select(F.xxhash64("doc_id").alias("id_key"), "set_key"), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(ids, "id_key"))

    # one Python step: a second one in the same tasks would be a second worker for each core
    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            b = b[in_bitmap(shared.value, b["id_key"].to_numpy(np.int64))]
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                sets = [shingle_set(t, hashes) for t in part["text"]]
                keys = [int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=5)).astype(np.int64)) for s in sets]
                yield pd.DataFrame({"set_key": keys, "grams": [s.tobytes() for s in sets]})

    # both joins below read one shuffle of the arrays
    texts = docs.select(F.xxhash64("doc_id").alias("id_key"), "text")
    grams = texts.mapInPandas(arrays, "set_key long, grams binary").join(ids.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])

    def intersect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    left = pairs.join(grams.select(F.col("set_key").alias("a"), F.col("grams").alias("x")), "a")
    whole = left.join(grams.select(F.col("set_key").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
    return whole.mapInPandas(intersect, "a long, b long")


_BITS = [f"w{k}" for k in range(BIT_WORDS)]


def near_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes and wide signatures leave room for a link."""
    side = lambda k: signatures.select(F.col("set_key").alias(k), F.col("n").alias("n" + k), F.col("wide").alias("w" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("na", "nb", F.lit(0)))

    def folded(w: str, other: str) -> Column:
        """A signature at the length of a shorter one; sizes that may link are at most one doubling apart."""
        half = F.size(w).cast("int") / 2
        lower, upper = F.slice(w, F.lit(1), half.cast("int")), F.slice(w, half.cast("int") + 1, half.cast("int"))
        return F.when(F.size(w) > F.size(other), F.zip_with(lower, upper, lambda x, y: x.bitwiseOR(y))).otherwise(F.col(w))

    bits = F.zip_with(folded("wa", "wb"), folded("wb", "wa"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return both.where(may_link("na", "nb", F.aggregate(bits, F.lit(0), lambda x, y: x + y))).select("a", "b")


def shared_shingles(described: DataFrame) -> DataFrame:
    """``(shingle, set_key, n, at, before)`` of prefix shingles that occur in the prefixes of two sets or more.

    at: the shingle's place in the set's order; before: the set's last one ahead of it that others may hold, too.
    """
    described = described.where(F.col("prefix").isNotNull())
    everywhere = described.select("set_key", F.explode("prefix").alias("shingle"))
    common = everywhere.groupBy("shingle").agg(F.min("set_key").alias("p"), F.max("set_key").alias("q")).where("p < q").select("shingle")
    common = stage(common, "common")
    # a bitmap of fixed size keeps most other shingles out of the shuffle; the join decides
    shared = described.sparkSession.sparkContext.broadcast(key_bitmap(common, "shingle"))

    @F.pandas_udf("array<int>")
    def useful(prefix: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(in_bitmap(shared.value, np.asarray(p, np.int64))).astype(np.int32) for p in prefix], dtype=object)

    places = described.select("set_key", "n", "prefix", useful("prefix").alias("u")).select("*", F.posexplode("u").alias("k", "at"))
    before = F.when(F.col("k") > 0, F.expr("prefix[u[k - 1]]"))
    held = places.select("set_key", "n", F.expr("prefix[at]").alias("shingle"), "at", before.alias("before"))
    return held.join(common, "shingle", "left_semi").distinct()


def tile_centres(members: DataFrame) -> DataFrame:
    """Per shingle one of its sets: centre, centre_n.

    Shingles are dealt over ``CENTRES`` orders, so a group meets a few centres and one odd member cannot part it.
    """
    order = F.xxhash64("set_key", F.pmod("shingle", F.lit(CENTRES)))
    chosen = members.groupBy("shingle").agg(F.min(F.struct(order.alias("o"), "set_key", "n")).alias("c"))
    return chosen.select("shingle", F.col("c.set_key").alias("centre"), F.col("c.n").alias("centre_n"))


def star_pairs(members: DataFrame, centres: DataFrame, signatures: DataFrame) -> DataFrame:
    """Every set with the centres of its tiles, where sizes and signatures leave room for a link."""
    met = members.join(centres, "shingle").where((F.col("centre") != F.col("set_key")) & may_link("n", "centre_n", F.lit(0)))
    return near_pairs(met.select(F.least("centre", "set_key").alias("a"), F.greatest("centre", "set_key").alias("b")).distinct(), signatures)


def mixed_tiles(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the shingles of three sets or more that are of several components; ``part`` is a set's component.

    parts: ``(node, root)`` of sets that are linked already. A shingle of two sets is left out: its pair was compared.
    """
    rows = members.join(parts.withColumnRenamed("node", "set_key"), "set_key", "left")
    rows = stage(rows.withColumn("part", F.coalesce("root", "set_key")).drop("root"), "parted")
    open_ = rows.groupBy("shingle").agg(F.count("*").alias("k"), F.min("part").alias("p"), F.max("part").alias("q")).where("k > 2 and p < q")
    return stage(rows.join(open_.select("shingle"), "shingle", "left_semi"), "mixed")


def tile_pairs(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs of sets of different components that share a tile and pass the bounds. A tile is a prefix shingle and a size band."""
    rows = members.drop("n").join(signatures.drop("wide"), "set_key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    rows = stage(rows.withColumn("band", band), "tiles")
    names = {"set_key": "a", "part": "pa", "n": "na", "at": "ata", "before": "bef"}
    small = rows.select("shingle", "band", *[F.col(c).alias(to) for c, to in names.items()], *[F.col(c).alias("a" + c) for c in _BITS])
    # linked sizes differ by a quarter at most: a set meets smaller sets of its band and of the two below (rounding)
    large = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") - 2)))
    met = small.join(large, ["shingle", "band"]).where(
        (F.col("pa") != F.col("part"))
        & ((F.col("na") < F.col("n")) | ((F.col("na") == F.col("n")) & (F.col("a") < F.col("set_key"))))
        & places_leave_room("na", "ata", "n", "at")
        & ~F.coalesce(F.col("bef") == F.col("before"), F.lit(False))  # they meet there already
        & may_link("na", "n", differing_bits([("a" + c, c) for c in _BITS]))
    )
    return near_pairs(met.select(F.least("a", "set_key").alias("a"), F.greatest("a", "set_key").alias("b")).distinct(), signatures)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links. Null and empty texts have no shingles and link with
    nothing, not even each other. Repeated rows and rows with a null id stay; a null id is never a component's id
    unless nothing else is in it. Very long texts are read whole; an empty table gives no rows. Extra columns are left out.
    """
    rows = docs.select("doc_id", "text")
    described = describe_sets(rows, shingle_counts(rows))
    described = stage(described.select("doc_id", "n", "set_key", "wide", "prefix", *[F.col("bits")[k].alias(c) for k, c in enumerate(_BITS)]), "sets")
    full = described.where("n > 0")
    signatures = stage(full.select("set_key", "n", "wide", *_BITS).distinct(), "signatures")
    members = stage(shared_shingles(full), "members")
    linked = lambda pairs: verify(stage(pairs, "pairs"), rows, full)
    parts = stage(connected_components(linked(star_pairs(members, tile_centres(members), signatures))), "parts")
    tiles = linked(tile_pairs(mixed_tiles(members, parts), signatures))
    roots = connected_components(stage(parts.select(F.col("root").alias("a"), F.col("node").alias("b")).union(tiles), "links"))
    smallest = full.groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rooted = smallest.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("set_key", "component_id")
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(named, "set_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
