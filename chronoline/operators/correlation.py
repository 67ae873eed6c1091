"""Lags between long sampled sequences by blocks of Fourier transforms (overlap-save)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of the left side in a block, unless the lags ask for more; lags in a slice of partial sums.
BLOCK = 1 << 16
SLICE = 1 << 15
SUMS = ("both", "left", "right", "met")


def _transform_size(max_lag: int, block: int) -> int:
    """A power of two that holds a block and the lags on either side of it."""
    return 1 << (max(block, 2 * max_lag) + 2 * max_lag - 1).bit_length()


def _block_sums(left: np.ndarray, right: np.ndarray, size: int, max_lag: int) -> np.ndarray:
    """left and right: rows of (value sum, row count) by place, right from max_lag places earlier -> for every lag from -max_lag the sums over
    meeting samples of the product, the left value, the right value and one."""
    whole = all((x == np.rint(x)).all() for x in (left, right))
    l, r = np.conj(np.fft.rfft(left, size)), np.fft.rfft(right, size)
    sums = np.stack([np.fft.irfft(l[a] * r[b], size)[: 2 * max_lag + 1][::-1] for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))])
    # sums of whole numbers are whole: where the transform's error is well under a half, they are exact
    error = np.finfo(float).eps * size.bit_length() * np.sqrt((left**2).sum(axis=1).max() * (right**2).sum(axis=1).max())
    return np.rint(sums) if whole and error < 0.05 else sums


def lag_sums(left: DataFrame, right: DataFrame, key: list[str], i: str, value: str, max_lag: int, block: int = BLOCK) -> DataFrame:
    """key, slice, and for the slice's lags the partial sums as packed doubles, of blocks that one task each transforms.

    A left sample goes to its block, a right one to the two or three blocks that it can meet at any lag, so rows do not multiply with the lags;
    a block yields one vector a sum, cut in slices that are added up apart.
    """
    size = _transform_size(max_lag, block)
    room = size - 2 * max_lag
    kinds = [f"`{k}` {left.schema[k].dataType.simpleString()}" for k in key]
    own = left.select(*key, F.lit(True).alias("_left"), F.col(i).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))
    other = right.select(*key, F.lit(False).alias("_left"), F.col(i).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))
    at = lambda shift: F.floor((F.col("_i") + shift) / F.lit(room)).cast("long")
    dealt = own.withColumn("_block", at(0)).union(other.withColumn("_block", F.explode(F.sequence(at(-max_lag), at(max_lag)))))

    def sums(table: pa.Table) -> pa.Table:
        is_left, place, v = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_left", "_i", "_v"))
        begin = table.column("_block")[0].as_py() * room
        held = []
        for mine, first, n in ((is_left, begin, room), (~is_left, begin - max_lag, size)):
            spot = place[mine] - first
            held.append(np.stack([np.bincount(spot, weights=w, minlength=n) for w in (v[mine], np.ones(len(spot)))]))
        heads = np.arange(0, 2 * max_lag + 1, SLICE)
        if not (is_left.any() and (~is_left).any()):
            heads = heads[:0]
        else:
            found = _block_sums(*held, size, max_lag)
        packed = {s: pa.array([found[k, h : h + SLICE].tobytes() for h in heads], pa.binary()) for k, s in enumerate(SUMS)}
        keys = {k: pa.array([table.column(k)[0].as_py()] * len(heads), table.schema.field(k).type) for k in key}
        return pa.table({**keys, "slice": pa.array(heads // SLICE, pa.int64()), **packed})

    fields = ", ".join([*kinds, "slice bigint", *(f"`{s}` binary" for s in SUMS)])
    return dealt.groupBy(*key, "_block").applyInArrow(sums, fields)


def best_lag_by_blocks(left: DataFrame, right: DataFrame, key: list[str], i: str, value: str, max_lag: int, block: int = BLOCK) -> DataFrame:
    """key, lag, score: as placement.best_lag, for long sequences and wide lags.

    Work per key is n log n in its samples; a task holds one block or one slice of lags, whatever the length of the sequence. Whole samples
    give exact sums; others differ from the exact score by the rounding of the transform. Samples at one place add up, missing ones do not count, null values and
    places are left out, and a key without samples that meet has no row.
    """
    given = lambda df: df.where(F.col(i).isNotNull() & F.col(value).isNotNull())
    left, right = given(left), given(right)
    total = lambda df, n, s: df.groupBy(*key).agg(F.count("*").cast("double").alias(n), F.sum(F.col(value).cast("double")).alias(s))
    totals = total(left, "_nl", "_sl").join(total(right, "_nr", "_sr"), key)
    parts = lag_sums(left, right, key, i, value, max_lag, block).join(totals, key)
    kinds = ", ".join([*(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in key), "lag bigint", "score double"])

    def best(table: pa.Table) -> pa.Table:
        add = lambda c: sum(np.frombuffer(b, dtype=float) for b in table.column(c).to_pylist())
        both, l, r, met = map(add, SUMS)
        nl, sl, nr, sr = (table.column(c)[0].as_py() for c in ("_nl", "_sl", "_nr", "_sr"))
        # the centred samples times both counts: (nl * l - sl) * (nr * r - sr), summed over the meeting ones
        score = np.where(met > 0.5, nl * nr * both - nl * sr * l - nr * sl * r + sl * sr * met, -np.inf)
        at = int(np.argmax(score))
        rows = [at] if np.isfinite(score[at]) else []
        keys = {k: table.column(k).slice(0, len(rows)) for k in key}
        return pa.table({**keys, "lag": pa.array([table.column("slice")[0].as_py() * SLICE + x - max_lag for x in rows], pa.int64()), "score": pa.array(score[rows])})

    found = parts.groupBy(*key, "slice").applyInArrow(best, kinds)
    return found.groupBy(*key).agg(F.max_by(F.struct("lag", "score"), F.struct("score", -F.col("lag"))).alias("b")).select(*key, "b.lag", "b.score")


def offset_seconds(lag: Column | str, rate: float) -> Column:
    """Seconds by which the right track starts later, to hundredths."""
    return F.round((F.col(lag) if isinstance(lag, str) else lag) / F.lit(float(rate)), 2)
