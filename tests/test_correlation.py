import random

import numpy as np
import pytest
from chronoline.operators import correlation as X
from chronoline.operators import placement as P


def tracks(spark, rows):
    return spark.createDataFrame(rows, "song bigint, i bigint, v bigint")


@pytest.mark.parametrize("max_lag, block", [(1, 4), (7, 8), (40, 16), (200, 64)])
def test_equals_the_join_of_every_lag(spark, monkeypatch, max_lag, block):
    monkeypatch.setattr(X, "SLICE", 5)
    r = random.Random(max_lag)
    made = lambda n: [(k, r.randint(-150, 150), r.randint(-9, 9)) for k in range(3) for _ in range(n)]
    left, right = tracks(spark, made(60)), tracks(spark, made(40) + [(9, 1, 1)])
    got = {tuple(x) for x in X.best_lag_by_blocks(left, right, ["song"], "i", "v", max_lag, block).collect()}
    want = {(x["song"], x["lag"], float(x["score"])) for x in P.best_lag(left, right, ["song"], "i", "v", max_lag).collect()}
    assert got == want and len(want) == 3


def test_twenty_seconds_at_sixteen_kilohertz(spark):
    """A noise track and its copy 3.21 seconds later; rows meet three blocks at the most, not 640,001 lags."""
    rate, n = 16_000, 200_000
    track = spark.range(n).selectExpr("1 as song", "id as i", "cast(pmod(xxhash64(id), 201) - 100 as double) / 7 as v")
    late = track.selectExpr("song", f"i - {int(3.21 * rate)} as i", "v + 0.01 as v")
    (found,) = X.best_lag_by_blocks(track, late, ["song"], "i", "v", 20 * rate).select("lag", X.offset_seconds("lag", rate).alias("s")).collect()
    assert tuple(found) == (int(3.21 * rate), 3.21)


def test_block_sums_equal_numpy():
    r = np.random.default_rng(0)
    left, right = r.normal(size=(2, 20)), r.normal(size=(2, 32))
    got = X._block_sums(left, right, 32, 6)
    want = [[sum(left[a][k] * right[b][k + 6 - lag] for k in range(20)) for lag in range(-6, 7)] for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert np.allclose(got, want)


def test_nulls_and_empty_tracks(spark):
    left = tracks(spark, [(1, 0, 1), (1, 1, None), (1, None, 4), (1, 2, 3)])
    assert X.best_lag_by_blocks(left, left.limit(0), ["song"], "i", "v", 3).collect() == []
    (x,) = X.best_lag_by_blocks(left, left, ["song"], "i", "v", 3).collect()
    assert tuple(x) == (1, 0, 8.0)
