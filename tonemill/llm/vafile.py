"""Exact top-k inner-product search with a vector-approximation file.

Every vector is stored as one small cell number per dimension. Scanning the cells gives an upper and a lower bound
of each score; exact vectors are then read in the order of their upper bounds until no unread one can enter the
result. Equal vectors share one entry of the file, which keeps the smallest ids that a result could need.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.common import stage

CELLS = 64  # per dimension
SAMPLE = 8192  # vectors the cell borders are taken from; borders only balance the cells
BLOCK, QUERY_BLOCK = 8192, 256
SALTS = 32


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * component), once per id and vector.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part.
    """
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


def distinct_vectors(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``(vid, v, ids, asked)``: each distinct vector, its k + 1 smallest ids, and whether any of its rows is a query."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = best.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("v").distinct().withColumn("asked", F.lit(True))
    whole = ids.join(asked, "v", "left").select("v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    return stage(whole.select(F.monotonically_increasing_id().alias("vid"), "*", F.size("v").alias("dim")), "vectors")


class Cells:
    """Borders of the cells of each dimension, and the smallest and largest value a cell can hold."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int):
        cuts = np.linspace(0, 1, cells + 1)[1:-1]
        self.edges = [np.unique(np.ceil(np.quantile(sample[:, d], cuts)).astype(np.int64)) for d in range(len(low))]
        self.low, self.high = np.zeros((2, len(low), cells))
        for d, e in enumerate(self.edges):
            self.low[d, : len(e) + 1] = np.append(low[d], np.maximum(e, low[d]))
            self.high[d, : len(e) + 1] = np.append(np.minimum(e - 1, high[d]), high[d])

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, d], side="right") for d, e in enumerate(self.edges)], 1).astype(np.uint8)

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(codes.shape[1])
        return self.low[at, codes], self.high[at, codes]


def learn_cells(vectors: DataFrame, dim: int, total: int, cells: int) -> Cells:
    """Borders from a sample of about ``SAMPLE`` vectors; the outermost values are those of all vectors."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = high = None
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy())
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pd.DataFrame({"d": np.arange(dim), "low": low, "high": high})

    ranges = vectors.select("v").mapInPandas(ends, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("d")
    part = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= ceil(SAMPLE / max(1, total) * (1 << 20))).select("v").toPandas()["v"]
    sample = np.stack(part.to_numpy()) if len(part) else ranges["low"].to_numpy()[None]
    return Cells(sample, ranges["low"].to_numpy(), ranges["high"].to_numpy(), cells)


def scan_cells(vectors: DataFrame, cells: Cells, total: int, asked: int, k: int) -> DataFrame:
    """``(qid, vid, upper, floor)``: entries that can be among the best k + 1 of their block, by bounds alone.

    floor is the (k + 1)th best lower bound of the block (null if it has fewer entries): no result of the query is worse.
    Queries and file meet block by block; a task holds one block of each.
    """
    blocks, query_blocks = ceil(total / BLOCK), ceil(asked / QUERY_BLOCK)
    shared = vectors.sparkSession.sparkContext.broadcast(cells)  # dimensions x cells numbers

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = shared.value.codes(np.stack(b["v"].to_numpy()))
                yield pd.DataFrame({"vid": b["vid"], "code": [c.tobytes() for c in codes]})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")
    file = vectors.select("vid", "v").mapInPandas(encode, "vid long, code binary")
    file = file.select("vid", "code", part(blocks).alias("b"), every(query_blocks).alias("q"))
    queries = vectors.where("asked").select(F.col("vid"), "v", part(query_blocks).alias("q"), every(blocks).alias("b"))

    def bound(data: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "vid": [], "upper": [], "floor": []})
        if not len(data) or not len(query):
            return empty
        codes = np.frombuffer(b"".join(data["code"]), np.uint8).reshape(len(data), -1)
        low, high = shared.value.bounds(codes)
        q = np.stack(query["v"].to_numpy()).astype(float)
        above, below = np.maximum(q, 0), np.minimum(q, 0)
        upper = above @ high.T + below @ low.T
        least = above @ low.T + below @ high.T
        floor = np.partition(least, -k - 1, axis=1)[:, -k - 1] if len(data) > k else np.full(len(q), np.nan)
        row, col = np.nonzero(~(upper < floor[:, None]))
        vids, qids = data["vid"].to_numpy(), query["vid"].to_numpy()
        return pd.DataFrame({"qid": qids[row], "vid": vids[col], "upper": upper[row, col], "floor": floor[row]})

    return file.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInPandas(bound, "qid long, vid long, upper double, floor double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, cells: int = CELLS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query row the k best other rows, ties to the smaller vec_id.

    Rows that repeat id and vector count once; rows that share an id but not the vector are different rows. Vectors are
    compared with those of their own length. Fewer than k others: all of them.
    """
    rows = integer_vectors(vectors)
    entries = distinct_vectors(rows, is_query, k)
    sizes = entries.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("q")).collect()
    parts = []
    for s in sorted(sizes):
        if s["q"]:
            same = entries.where(F.col("dim") == s["dim"])
            parts.append(scan_cells(same, learn_cells(same, s["dim"], s["n"], cells), s["n"], s["q"], k))
    if not parts:
        return entries.select(F.col("vid").alias("query_id"), F.lit(1).alias("rank"), F.col("vid").alias("vec_id"), F.col("vid").alias("score")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = stage(found, "cells")
    floors = found.where(~F.isnan("floor")).groupBy("qid").agg(F.max("floor").alias("best"))
    near = found.join(floors, "qid", "left").where(F.col("best").isNull() | (F.col("upper") >= F.col("best"))).select("qid", "vid", "upper")

    asked = entries.where("asked").select(F.col("vid").alias("qid"), F.col("v").alias("qv"))
    stored = entries.select("vid", "v", "ids")
    score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)

    def read(wanted: DataFrame) -> DataFrame:
        return wanted.join(stored, "vid").join(asked, "qid").select("qid", "vid", "ids", score.alias("score"))

    order = Window.partitionBy("qid").orderBy(F.desc("upper"), "vid")
    ranked = stage(near.withColumn("r", F.row_number().over(order)), "ranked")
    head = read(ranked.where(F.col("r") <= k + 1)).groupBy("qid").agg(F.count("*").alias("c"), F.min("score").alias("kth"))
    # the rest is read only where its bound does not rule it out
    open_ = ranked.join(head, "qid").where((F.col("c") <= k) | (F.col("upper") >= F.col("kth"))).select("qid", "vid")
    best = read(open_).select("qid", "vid", F.explode("ids").alias("vec_id"), "score")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "vid"))).alias("found"))
    answers = entries.select(F.col("vid").alias("qid"), "v").join(lists, "qid").select("v", "qid", "found")
    each = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(answers, "v").select("query_id", "qid", "found")
    others = F.filter("found", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["vid"] == F.col("qid"))))
    each = each.withColumn("others", F.slice(others, 1, k))
    return each.select("query_id", F.posexplode("others").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
