import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tonemill.operators import ranking as rk
from tonemill.operators import sampling as sm


def key(row_id, seed):
    return hashlib.md5(f"{row_id}:{seed}".encode()).hexdigest()


def table(spark, sizes):
    """One third or more of the rows may be in a single class."""
    labels = [c for c, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame(list(enumerate(labels)), "row_id long, label int"), labels


def first_of(labels, quota, seed=42):
    by = defaultdict(list)
    for i, c in enumerate(labels):
        by[c].append((key(i, seed), i))
    return {i for c, rows in by.items() for _, i in sorted(rows)[: quota(c, len(rows))]}


def ids(df):
    got = [r["row_id"] for r in df.select("row_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


SIZES = {0: 1500, 1: 1, 2: 301, 3: 15}


@pytest.fixture
def deep_search(monkeypatch):
    """Make the cut search refine its buckets on small data."""
    monkeypatch.setattr(rk, "MAX_CUT_ROWS", 2)
    monkeypatch.setattr(rk, "DIGITS_PER_LEVEL", 1)


def sample_cases(spark):
    df, labels = table(spark, SIZES)
    for fraction in (0.0, 0.1, 0.5, 1.0):
        want = first_of(labels, lambda c, n: round(fraction * n))
        assert ids(sm.stratified_sample(df, fraction)) == want


def test_stratified_sample(spark):
    sample_cases(spark)


def test_stratified_sample_refined(spark, deep_search):
    sample_cases(spark)


def test_steps_are_the_same_for_few_and_many_groups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rk, "scratch_dir", lambda _: str(tmp_path))
    steps = []
    for groups in (3, 5000):
        df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % groups).cast("int").alias("label"))
        assert sm.stratified_sample(df, 0.5).count() == sum(round(0.5 * len(range(c, 20_000, groups))) for c in range(groups))
        newest = max(tmp_path.iterdir(), key=lambda p: p.stat().st_mtime)
        steps.append(sorted(p.name for p in newest.iterdir()))
    assert steps[0] == steps[1] == ["cut", "goals", "histogram", "limits"]


def test_refined_cut_with_many_groups(spark, deep_search):
    labels = [i % 7 if i % 3 else 0 for i in range(900)]
    df = spark.createDataFrame(list(enumerate(labels)), "row_id long, label int")
    assert ids(sm.stratified_sample(df, 0.3)) == first_of(labels, lambda c, n: round(0.3 * n))


def test_balance_to_class(spark):
    df, labels = table(spark, SIZES)
    assert ids(sm.balance_to_class(df, 2)) == first_of(labels, lambda c, n: min(n, 301))
    assert sm.balance_to_class(df, 9).count() == 0
    nulls, _ = table(spark, {0: 10, None: 50, 1: 20})
    assert Counter(r["label"] for r in sm.balance_to_class(nulls, 1).collect()) == {0: 10, 1: 20, None: 20}


def test_split_refuses_a_class_of_one_row(spark):
    df, _ = table(spark, {0: 5, 1: 1})
    with pytest.raises(ValueError, match="single row"):
        sm.train_test_split(df)
    assert sm.train_test_split(df, group=None).count() == 6


def test_sample_rows_with_repeated_ids(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(40)], "row_id long, x int").repartition(6)
    got = [r["row_id"] for r in sm.sample_rows(df, 10).collect()]
    assert sorted(got) == sorted(sorted([i % 10 for i in range(40)], key=lambda i: (key(i, 42), i))[:10])
    assert sm.sample_rows(df, 0).count() == 0 and sm.sample_rows(df, 99).count() == 40


def test_sample_drops_null_labels_and_ignores_partitioning(spark):
    df, labels = table(spark, {0: 40, 1: 30, None: 20})
    want = ids(sm.stratified_sample(df, 0.5))
    assert len(want) == 35
    for parts in (1, 7, 64):
        assert ids(sm.stratified_sample(df.repartition(parts), 0.5)) == want


def test_balance(spark):
    df, labels = table(spark, SIZES)
    out = ids(sm.balance_classes(df, {0: 200, 2: 301}))
    assert out == first_of(labels, lambda c, n: min(n, {0: 200, 2: 301}.get(c, n)))
    with pytest.raises(ValueError):
        sm.balance_classes(df, {3: 16})
    assert len(ids(sm.balance_classes(df, {3: 16, 0: 0, 2: 0}, allow_short=True))) == 16


def test_balance_keeps_uncapped_null_class(spark):
    df, _ = table(spark, {0: 10, None: 5})
    assert Counter(r["label"] for r in sm.balance_classes(df, {0: 3}).collect()) == {0: 3, None: 5}


def split_quota(sizes, fraction):
    total = sum(sizes.values())
    wanted = math.ceil(fraction * total)
    base = {c: wanted * n // total for c, n in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(wanted * sizes[c] % total), c))
    for c in order[: wanted - sum(base.values())]:
        base[c] += 1
    return base


@pytest.mark.parametrize("sizes", [SIZES, {0: 3, 1: 3, 2: 4}, {0: 2, 1: 2, 2: 1}])
def test_train_test_split(spark, sizes):
    df, labels = table(spark, sizes)
    rows = sm.train_test_split(df, allow_single=True).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(len(labels)))
    quota = split_quota(sizes, 0.2)
    assert {r["row_id"] for r in rows if r["split"] == "test"} == first_of(labels, lambda c, n: quota[c])


def test_split_without_classes(spark):
    df, labels = table(spark, {0: 11})
    rows = sm.train_test_split(df, group=None).collect()
    want = {i for _, i in sorted((key(i, 42), i) for i in range(11))[:3]}
    assert {r["row_id"] for r in rows if r["split"] == "test"} == want


def test_epoch_order_is_a_permutation_that_changes(spark):
    df, labels = table(spark, {0: 500})
    orders = []
    for epoch in (0, 1):
        rows = sm.epoch_order(df, epoch=epoch).orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(500)) and rows[0]["total"] == 500
        orders.append([r["row_id"] for r in rows])
        assert orders[-1] == [i for _, i in sorted((key(i, f"42:{epoch}"), i) for i in range(500))]
    assert orders[0] != orders[1]


def test_natural_order_with_uneven_ids(spark):
    values = [1, 2, 3, 10**12, 5, 10**15, -7] + list(range(100, 150))
    df = spark.createDataFrame([(v,) for v in values], "row_id long")
    rows = sm.with_natural_order(df).orderBy("pos").collect()
    assert [r["row_id"] for r in rows] == sorted(values)


@pytest.mark.parametrize("n,shards", [(10, 3), (2, 5), (9, 3), (1, 4)])
def test_shards(spark, n, shards):
    df = sm.with_natural_order(spark.range(n).withColumnRenamed("id", "row_id"))
    dropped = sm.shard_rows(df, shards, "drop").collect()
    assert sorted((r["pos"], r["shard"]) for r in dropped) == [(i, i % shards) for i in range(n - n % shards)]
    padded = sm.shard_rows(df, shards, "pad").collect()
    total = math.ceil(n / shards) * shards
    assert sorted((r["pos"], r["row_id"], r["shard"]) for r in padded) == [(i, i % n, i % shards) for i in range(total)]


def test_batches(spark):
    df = sm.with_natural_order(spark.range(10).withColumnRenamed("id", "row_id"))
    assert Counter(r["batch_id"] for r in sm.batch_rows(df, 4).collect()) == {0: 4, 1: 4}
    assert Counter(r["batch_id"] for r in sm.batch_rows(df, 4, drop_last=False).collect()) == {0: 4, 1: 4, 2: 2}


def test_sample_rows(spark):
    df, _ = table(spark, {0: 300})
    want = {i for _, i in sorted((key(i, 42), i) for i in range(300))[:50]}
    assert ids(sm.sample_rows(df, 50)) == want
    assert len(ids(sm.sample_rows(df, 1000))) == 300


def test_union_keeps_duplicates(spark):
    df = spark.range(3)
    assert sm.union_slices([df, df]).count() == 6


def test_order_key_matches_md5(spark):
    row = spark.range(5, 6).select(rk.order_key(F.col("id"), 1).alias("k")).first()
    assert row["k"] == key(5, 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, label int")
    assert sm.stratified_sample(df, 0.5).count() == 0
    assert sm.train_test_split(df).count() == 0
    assert sm.epoch_order(df).count() == 0
    assert sm.shard_rows(sm.with_natural_order(df), 3, "pad").count() == 0


def test_large_sample_of_text_labels(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("label"))
    assert Counter(r["label"] for r in sm.stratified_sample(df, 0.3).collect()) == {"c0": 15, "c1": 15}
