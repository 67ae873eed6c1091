"""Exact medians of the slopes between all rows of a sequence, without a row a pair.

A sequence of up to a block of rows is one group of a grouped function, which holds its slopes alone. Longer ones are dealt to blocks and every two
blocks are one group, so that a hot key spreads over many tasks; these count slopes by the leading bits of their order-preserving image, eleven more
bits a round, until the two middle ranks are single values. What travels is rows and counts, never pairs.

Cases: rows without a time or value have no slopes, nor have two rows closer than 1e-6 in time; a sequence without any slope has no row; equal slopes
count as often as they occur; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from chronoline.session import checkpoint

BLOCK, STRIP = 4096, 256
DIGIT_BITS = 11
#: Bits below the digits of each round.
SHIFTS = (53, 42, 31, 20, 9, 0)
MIN_STEP = 1e-6


def slopes_of(a: np.ndarray, b: np.ndarray | None) -> Iterator[np.ndarray]:
    """Slopes between the rows (time, value) of a and of b, or of a alone, a strip of rows at a time."""
    for k in range(0, len(a), STRIP):
        strip, other = a[k : k + STRIP], a[k:] if b is None else b
        step = other[:, 0][None, :] - strip[:, 0][:, None]
        valid = np.abs(step) >= MIN_STEP
        if b is None:  # every pair once: columns behind the row
            valid &= np.arange(len(other))[None, :] > np.arange(len(strip))[:, None]
        rise = other[:, 1][None, :] - strip[:, 1][:, None]
        yield rise[valid] / step[valid] + 0.0  # -0 becomes 0


def image(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; its own inverse on the bits."""
    bits = np.ascontiguousarray(values).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


@pandas_udf(DoubleType())
def _double(images: pd.Series) -> pd.Series:
    bits = images.to_numpy(np.int64)
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64))


def _keys(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)


def _short(rows: DataFrame, key: list[str]) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.concatenate(list(slopes_of(pdf[["_t", "_d"]].to_numpy(float), None)))
        out = pdf[key].head(1 if len(found) else 0).copy()
        return out.assign(slope=np.median(found) if len(found) else None)

    return rows.groupBy(*key).applyInPandas(one, f"{_keys(rows, key)}, slope double")


def _counts(blocks: DataFrame, key: list[str], state: DataFrame | None, shift: int) -> DataFrame:
    """key, half, bin, n: slopes by the digits down to shift, of those that share the digits found so far for the lower (0) or upper (1) middle rank."""
    opening = state is None
    size = 1 << (64 - shift if opening else min(DIGIT_BITS, SHIFTS[SHIFTS.index(shift) - 1] - shift))
    pair = [*key, "_a", "_b"]
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not to be coalesced
    held = blocks.repartition(parts, *pair)
    if not opening:  # every pair of blocks has its own copy, so that the join is dealt as the groups are
        spread = state.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
        spread = spread.withColumn("_b", F.explode(F.sequence("_a", F.col("_m") - 1))).select(*pair, "bin0", "bin1")
        held = held.join(spread.repartition(parts, *pair), pair)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["_side"].to_numpy() == 0
        points = pdf[["_t", "_d"]].to_numpy(float)
        alone = pdf["_a"].iloc[0] == pdf["_b"].iloc[0]
        starts = [-(size // 2)] * 2 if opening else [int(pdf[c].iloc[0]) * size for c in ("bin0", "bin1")]
        totals = np.zeros((2, size), dtype=np.int64)
        for found in slopes_of(points[first], None if alone else points[~first]):
            digits = image(found) >> shift
            for half, start in enumerate(starts):
                inside = digits[(digits >= start) & (digits <= start + (size - 1))] - start
                totals[half] += np.bincount(inside, minlength=size)
        half, place = np.nonzero(totals)
        out = pd.DataFrame({"half": half.astype("int32"), "bin": np.asarray(starts, dtype=np.int64)[half] + place, "n": totals[half, place]})
        for k in reversed(key):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    counted = held.groupBy(*pair).applyInPandas(one, f"{_keys(blocks, key)}, half int, bin bigint, n bigint")
    return counted.groupBy(*key, "half", "bin").agg(F.sum("n").alias("n"))


def _long(rows: DataFrame, sizes: DataFrame, key: list[str], block: int) -> DataFrame:
    many = checkpoint(sizes.select(*key, F.ceil(F.col("n") / block).cast("long").alias("_m")))
    dealt = rows.join(many, key).withColumn("_own", F.monotonically_increasing_id() % F.col("_m"))
    dealt = checkpoint(dealt)  # the dealing must not change between rounds
    pairs = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    blocks = pairs.select(*key, "_t", "_d", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"))
    state = None
    for shift in SHIFTS:
        counts = _counts(blocks, key, state, shift)
        w = Window.partitionBy(*key, "half")
        upto = counts.withColumns({"_upto": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)})
        if state is None:
            rank = F.floor((F.col("_all") - 1 + F.col("half")) / 2)
        else:
            upto, rank = upto.join(state.select(*key, "rank0", "rank1"), key), F.when(F.col("half") == 0, F.col("rank0")).otherwise(F.col("rank1"))
        hit = upto.withColumn("_rank", rank - (F.col("_upto") - F.col("n"))).where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("n")))
        pick = lambda c, h: F.max(F.when(F.col("half") == h, F.col(c)))
        found = hit.groupBy(*key).agg(pick("bin", 0).alias("bin0"), pick("bin", 1).alias("bin1"), pick("_rank", 0).alias("rank0"), pick("_rank", 1).alias("rank1"))
        state = checkpoint(found.join(many, key))
    return state.select(*key, ((_double("bin0") + _double("bin1")) / 2).alias("slope"))


def median_slopes(rows: DataFrame, key: list[str], t: str, value: str, block: int = BLOCK) -> DataFrame:
    """key, slope: the median slope over all pairs of a sequence's rows. Runs jobs while the query is built: a look for long sequences, and their rounds."""
    points = rows.select(*key, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_d")).where("_t is not null and _d is not null")
    long = checkpoint(points.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block))
    if long.isEmpty():
        return _short(points, key)
    return _short(points.join(long, key, "left_anti"), key).unionByName(_long(points, long, key, block))
