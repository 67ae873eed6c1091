import random

import pytest
from chronoline.operators import ordered as O
from chronoline.operators import scans as S
from pyspark.sql import functions as F

KEY, ORDER = ["k"], ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows; nulls among keys, values and flags."""
    r = random.Random(8)
    made = []
    for n in range(1500):
        k = "hot" if r.random() < 0.7 else r.choice(["x", "y", None])
        s = n * 0.05 + r.random()
        e = s + r.choice([-0.2, 0.0, 0.01, 0.3, 3.0, 0.05])
        anchored = r.random() < 0.08
        made.append((k, n // 3, n % 3, r.randint(0, 3000), r.randint(1, 4), r.random() < 0.9, s, e, s + r.uniform(-1, 1) if anchored else None, e + 0.5 if anchored else None))
    r.shuffle(made)
    return spark.createDataFrame(made, "k string, a int, b int, beat long, len long, flag boolean, s double, e double, as double, ae double").repartition(7)


def same(got, want, places=9):
    show = lambda df: sorted((repr([round(v, places) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(want.columns)).collect()))
    return show(got) == show(want)


@pytest.mark.parametrize("per_block", [40, 333, 10_000])
def test_scans_equal_the_window_forms(rows, per_block):
    assert same(S.quantize(rows, KEY, ORDER, "beat", "len", per_block), O.quantize(rows, KEY, ORDER, "beat", "len"))
    assert same(S.longest_run(rows, KEY, ORDER, "flag", True, per_block), O.longest_run(rows, KEY, ORDER, "flag", True))
    anchors = (rows, KEY, ORDER, "s", "e", "as", "ae")
    assert same(S.interpolate_anchors(*anchors, per_block), O.interpolate_anchors(*anchors))
    assert same(S.enforce_monotonic(rows, KEY, ORDER, "s", "e", rows_per_block=per_block), O.enforce_monotonic(rows, KEY, ORDER, "s", "e"), 6)


def test_a_hot_key_lies_in_many_blocks(rows):
    counts = S.blocked(rows, KEY, ORDER, 100).groupBy(S.BLOCK).agg(F.count("*").alias("n"), F.max(F.col("k") == "hot").alias("hot")).collect()
    assert max(r["n"] for r in counts) < 400 and sum(bool(r["hot"]) for r in counts) > 6


def test_sums_and_fills_without_values(spark):
    df = spark.createDataFrame([("x", 1, None), ("x", 2, None), ("y", 1, 5)], "k string, i int, v int")
    got = S.running(S.blocked(df, ["k"], ["i"], 1), ["k"], ["i"], total=S.Scan("sum", F.col("v")), top=S.Scan("max", F.col("v")), back=S.Scan("last", F.col("v"), back=True))
    assert sorted(tuple(r) for r in got.select("k", "i", "total", "top", "back").collect()) == [("x", 1, 0, None, None), ("x", 2, 0, None, None), ("y", 1, 5, 5, 5)]
    assert S.quantize(df.limit(0), ["k"], ["i"], "v", "v").count() == 0


def test_small_blocks_grow_before_they_are_too_many():
    asked = [S.block_count(n, 4_000) for n in (0, 600_000, 36_000_000, 216_000_000)]
    assert asked == [1, 150, 400, 1080]
    assert S.block_count(600_000_000, S.ROWS_PER_BLOCK) == 3000 and S.block_count(3_000_000_000, 1_000_000) == 3000


def test_keys_of_a_monotonic_scan_cost_no_call_each(rows):
    """All keys stream through Arrow maps; the one grouped function folds the first and the last key of each block."""
    plan = S.enforce_monotonic(rows, KEY, ORDER, "s", "e", rows_per_block=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInArrow") == 2


@pytest.mark.parametrize("per_block", [1, 7, 5_000])
def test_a_monotonic_scan_of_many_small_keys(spark, per_block):
    small = spark.range(400).select((F.col("id") % 150).alias("k"), (F.col("id") / 7).cast("int").alias("a"), F.col("id").cast("int").alias("b"), (F.col("id") * 0.02 % 3).alias("s"), (F.col("id") * 0.03 % 2).alias("e"))
    assert same(S.enforce_monotonic(small, KEY, ORDER, "s", "e", rows_per_block=per_block), O.enforce_monotonic(small, KEY, ORDER, "s", "e"), 6)
