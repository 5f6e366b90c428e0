"""First-seen and first-N against brute force, hot groups included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators.ordering import (
    content_digest,
    first_n,
    first_n_by_bounds,
    first_n_per_group,
    first_seen,
    nth_key,
)
from codeloom.sources.sinks import write_bucketed


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    ids = list(range(3_000))
    rng.shuffle(ids)
    # one content holds a third of all rows
    return [(i, "hot" if rng.random() < 0.34 else f"text {rng.randrange(900)}", f"p{i % 50:02d}") for i in ids]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, content string, part string").repartition(7)


def first_by(rows, key):
    seen = {}
    for row in sorted(rows, key=key):
        seen.setdefault(row[1], row)
    return sorted(seen.values())


def test_first_seen(df, rows):
    got = first_seen(df, content_digest(F.col("content")), "id")
    assert sorted(map(tuple, got.collect())) == first_by(rows, lambda r: r[0])


def test_first_seen_compound_key(df, rows):
    got = first_seen(df, content_digest(F.col("content")), ["part", "id"])
    assert sorted(map(tuple, got.collect())) == first_by(rows, lambda r: (r[2], r[0]))


def test_first_seen_with_shared_keys(df, rows):
    got = first_seen(df, content_digest(F.col("content")), "part", unique_key=False).collect()
    best = {}
    for _, content, part in rows:
        best[content] = min(part, best.get(content, part))
    assert sorted((r.content, r.part) for r in got) == sorted(best.items())


def test_first_seen_is_idempotent(df):
    same = content_digest(F.col("content"))
    once = first_seen(df, same, "id")
    assert sorted(first_seen(once, same, "id").collect()) == sorted(once.collect())


@pytest.mark.parametrize("n", [0, 1, 17, 1_000, 2_999, 3_000, 5_000])
def test_first_n(df, rows, n):
    got = first_n(df, n, "id")
    assert sorted(map(tuple, got.collect())) == sorted(rows)[:n]


def test_first_n_compound_key(df, rows):
    got = first_n(df, 777, ["part", "id"])
    assert sorted(map(tuple, got.collect())) == sorted(sorted(rows, key=lambda r: (r[2], r[0]))[:777])


ODD = [(1, "a", 1.0), (1, "b", None), (2, "a", float("nan")), (None, "c", 2.0), (None, "c", 2.0), (None, "a", 0.5), (2, "a", 1.0), (3, "d", None)]


@pytest.mark.parametrize("n", range(10))
def test_null_and_shared_keys(spark, n):
    odd = spark.createDataFrame(ODD, "k bigint, content string, v double").repartition(3)
    order = sorted(k if k is not None else -1 for k, _, _ in ODD)
    got = sorted(r.k if r.k is not None else -1 for r in first_n(odd, n, "k").collect())
    assert got == order[:n]
    pairs = first_n(odd, n, ["v", "k"]).collect()
    assert len(pairs) == min(n, len(ODD)) and sum(r.v is None for r in pairs) == min(n, 2)


def test_one_row_a_content(spark):
    odd = spark.createDataFrame(ODD, "k bigint, content string, v double").repartition(3)
    got = sorted((r.content, r.k) for r in first_seen(odd, content_digest(F.col("content")), "k").collect())
    assert got == [("a", None), ("b", 1), ("c", None), ("d", 3)]


def test_shared_keys_of_a_large_table(spark, small):
    items = spark.read.parquet(f"{small}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber"]
    order = sorted(map(tuple, items.select(*key).collect()))
    for n in (1, 1_500, 4_000):
        assert sorted(map(tuple, first_n(items, n, key).select(*key).collect())) == order[:n]
    bound, below, equal = nth_key(items.select(*key), 1_500)
    assert tuple(bound) == order[1_499] and below == order.index(order[1_499]) and equal == order.count(order[1_499])


@pytest.mark.parametrize("n", [1, 5, 1_000, 1_001])
def test_first_n_per_group(df, rows, n):
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1], []).append(r)
    want = sorted(r for g in groups.values() for r in g[:n])
    assert sorted(map(tuple, first_n_per_group(df, n, "content", "id").collect())) == want


@pytest.mark.parametrize("n", [0, 1, 5, 900, 1_000, 1_001, 5_000])
def test_bounds_of_groups(df, rows, n):
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1], []).append(r)
    want = sorted(r for g in groups.values() for r in g[:n])
    assert sorted(map(tuple, first_n_by_bounds(df, n, ["content"], ["id"]).collect())) == want


@pytest.mark.parametrize("n", [1, 2, 30, 299, 700])
def test_bounds_of_groups_with_null_and_shared_keys(spark, n):
    rows = [(i, None if i % 3 == 0 else f"g{i % 2}", None if i % 7 < 3 else float(i % 5)) for i in range(2_100)]
    df = spark.createDataFrame(rows, "id int, part string, k double").repartition(5)
    got = first_n_by_bounds(df, n, ["part"], ["k"]).collect()
    assert len({r.id for r in got}) == len(got)

    def placed(found):
        by = {}
        for _, part, k in found:
            by.setdefault(part, []).append(-1.0 if k is None else k)
        return {part: sorted(ks)[:n] for part, ks in by.items()}

    assert placed(got) == placed(rows)


def test_a_large_limit_ranks_no_whole_group(spark, monkeypatch):
    """One group holds half of 400,000 rows and 100,000 of them are kept; no task holds more than a part of them."""
    half = F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 1000)
    df = spark.range(400_000).select("id", half.alias("part"), F.xxhash64("id").alias("k"))
    monkeypatch.setattr("codeloom.operators.ordering.TASK_ROWS", 100_000)
    got = first_n_per_group(df, 100_000, "part", ["k", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan.replace("SortMergeJoin", "")
    keys = got.where("part = -1").agg(F.count("*").alias("n"), F.max("k").alias("k")).first()
    want = df.where("part = -1").orderBy("k").limit(100_000).agg(F.max("k").alias("k")).first()
    assert (keys.n, keys.k) == (100_000, want.k) and got.count() == 300_000


def test_hot_groups_shrink_before_the_shuffle(df):
    plan = first_n_per_group(df, 20, "content", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    plan = first_seen(df, F.col("content"), "id", unique_key=True)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_order_is_required(df):
    with pytest.raises(ValueError, match="order_by"):
        first_n(df, 5, [])


@pytest.mark.parametrize("n", [10, 2_500])
def test_first_n_is_a_filter(df, n):
    plan = first_n(df, n, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "Join" not in plan


def test_bucketed_contents_stay_where_they_are(spark, df, rows):
    write_bucketed(df, "bucketed_rows", "id", 8, partition_by="part")
    stored = spark.table("bucketed_rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = first_seen(stored, content_digest(F.col("content")), "id", unique_key=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # one exchange groups the digests, one brings the keys to the buckets
        assert plan.count("Exchange hashpartitioning") == 2
        assert sorted((r.id, r.content, r.part) for r in got.collect()) == first_by(rows, lambda r: r[0])
        pruned = stored.where(F.col("part") == "p07")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in pruned
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contents_without_a_twin_are_not_shuffled(spark, df):
    got = first_seen(df, content_digest(F.col("content")), ["part", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The wide rows are scanned once for those that pass and once for those that meet; only the latter move, after a partial aggregation.
    assert plan.count("partial_min_by") == 1 and "Window" not in plan
    assert "SortMergeJoin" not in plan and "BroadcastExchange" in plan


def jobs_of(spark, name, work):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("n", [1, 30_000, 59_999, 60_001])
def test_bound_of_many_rows_takes_few_jobs(spark, n):
    """Three looks at the table: a count, a sample, a pass (a job of the adaptive planner is a stage)."""
    keys = spark.range(0, 60_000, 1, 4).select((F.col("id") % 7).cast("double").alias("a"), F.concat(F.lit("k"), F.col("id") * 7919 % 60_000).alias("b"))
    (bound, below, equal), jobs = jobs_of(spark, f"bound-{n}", lambda: nth_key(keys, n))
    order = sorted((r.a, r.b) for r in keys.collect())
    assert jobs <= 7
    if n > len(order):
        assert bound is None
    else:
        assert (tuple(bound), below, equal) == (order[n - 1], n - 1, 1)


def test_bound_among_ties(spark):
    """A key that two thirds of the rows share is counted, not gathered."""
    keys = spark.range(0, 90_000, 1, 4).select(F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    order = sorted((-1 if r.k is None else r.k) for r in keys.collect())
    for n in (1, 15_000, 15_001, 15_002, 40_000, 75_000, 75_001, 90_000):
        bound, below, equal = nth_key(keys, n)
        key = -1 if bound.k is None else bound.k
        assert key == order[n - 1] and below == order.index(key) and equal == order.count(key)
