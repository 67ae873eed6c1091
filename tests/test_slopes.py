"""Median slopes against all pairs, with one block and with many."""

from itertools import combinations

import numpy as np
import pytest
from chronoline.operators import slopes as S


def brute(points):
    found = [(d2 - d1) / (t2 - t1) for (t1, d1), (t2, d2) in combinations(points, 2) if abs(t2 - t1) >= 1e-6]
    return float(np.median(found)) if found else None


@pytest.fixture(scope="module")
def songs():
    rng = np.random.default_rng(5)
    return {
        "noise": [(float(t), float(d)) for t, d in zip(np.sort(rng.uniform(0, 300, 61)), rng.normal(0, 3, 61))],
        "flat": [(float(t), 2.5) for t in range(23)],
        "falling": [(t / 4, -3.25 * t) for t in range(40)],
        "steps": [(float(t), float(t % 3)) for t in range(31)],
        "same time": [(7.0, float(d)) for d in range(20)],
        "repeated": [(float(t // 2), float(t // 2 * t % 5)) for t in range(26)],
        "huge": [(t * 1e-3, (-1.0) ** t * 10.0 ** (t % 300)) for t in range(17)],
        "pair": [(1.0, 2.0), (3.0, 1.0)],
        "one": [(1.0, 2.0)],
    }


@pytest.mark.parametrize("block", [S.BLOCK, 5])
def test_median_slopes_equal_all_pairs(spark, songs, block):
    rows = [(k, t, d) for k, points in songs.items() for t, d in points] + [("noise", None, 1.0), ("noise", 4.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "song string, t double, d double").repartition(3)
    found = {r.song: r.slope for r in S.median_slopes(df, ["song"], "t", "d", block).collect()}
    assert found == {k: v for k, v in ((k, brute(p)) for k, p in songs.items()) if v is not None}


def test_strips_give_every_pair_once():
    points = np.column_stack([np.arange(600.0), np.random.default_rng(1).normal(size=600)])
    assert sum(map(len, S.slopes_of(points, None))) == 600 * 599 // 2
    assert sum(map(len, S.slopes_of(points[:300], points[300:]))) == 300 * 300


def test_no_rows(spark):
    df = spark.createDataFrame([], "song string, t double, d double")
    assert S.median_slopes(df, ["song"], "t", "d").count() == 0
