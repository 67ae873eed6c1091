"""Scans over sequences that one task cannot hold: blocks of a range partition, their summaries, and a second pass.

``blocked`` cuts all sequences by key and order into contiguous blocks, so a sequence that holds a third of all rows lies in a third of the blocks. A
scan runs inside each block, the blocks' totals are scanned per key (a row a block), and each block takes up what
came before it. The results are those of the window forms in ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.ordered import MIN_DURATION, MIN_GAP
from chronoline.operators.walks import plain
from chronoline.session import checkpoint

ROWS_PER_BLOCK = 200_000
#: Smaller blocks grow up to ROWS_PER_BLOCK before there are more than so many: each costs a task a step, a sample and a report to the driver.
FEW_BLOCKS = 400
BLOCK = "_block"


@dataclass(frozen=True)
class Scan:
    """kind: sum (nulls are 0), max or last (nulls are passed over); own: whether a row counts for itself; back: from the end."""

    kind: str
    value: Column
    own: bool = True
    back: bool = False


def block_count(rows: int, rows_per_block: int) -> int:
    blocks = -(-rows // rows_per_block)
    return max(1, blocks if blocks <= FEW_BLOCKS else min(blocks, max(FEW_BLOCKS, -(-rows // ROWS_PER_BLOCK))))


def blocked(df: DataFrame, key: list[str], order: list[str], rows_per_block: int | None = None) -> DataFrame:
    """df with the number of its block, written once: every later step reads the same blocks. Rows equal in key and order share a block."""
    blocks = block_count(df.count(), rows_per_block or ROWS_PER_BLOCK)
    return checkpoint(df.repartitionByRange(blocks, *key, *order).withColumn(BLOCK, F.spark_partition_id()))


def _sorted(columns: list[str], back: bool) -> list[Column]:
    return [F.desc_nulls_last(c) if back else F.asc_nulls_first(c) for c in columns]


def running(df: DataFrame, key: list[str], order: list[str], **scans: Scan) -> DataFrame:
    """Adds a column for each scan to a blocked df; key may be finer than the blocks' own, if it changes along the order only."""
    whole, named = df, [*key, BLOCK]
    within = lambda s: Window.partitionBy(*named).orderBy(*_sorted(order, s.back)).rowsBetween(Window.unboundedPreceding, 0 if s.own else -1)
    local = {"sum": lambda s: F.coalesce(F.sum(s.value).over(within(s)), F.lit(0)), "max": lambda s: F.max(s.value).over(within(s)), "last": lambda s: F.last(s.value, True).over(within(s))}
    place = F.struct(*order)

    def total(s: Scan) -> Column:
        if s.kind == "last":
            at = F.when(s.value.isNotNull(), place)
            return (F.min_by if s.back else F.max_by)(s.value, at)
        return F.coalesce(F.sum(s.value), F.lit(0)) if s.kind == "sum" else F.max(s.value)

    sums = whole.groupBy(*named).agg(*[total(s).alias(f"_total_{n}") for n, s in scans.items()])
    along = lambda s: Window.partitionBy(*key).orderBy(F.desc(BLOCK) if s.back else F.asc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, True)}
    carries = sums.select(*named, *[carry[s.kind](f"_total_{n}").over(along(s)).alias(f"_carry_{n}") for n, s in scans.items()])
    met = whole.withColumns({f"_local_{n}": local[s.kind](s) for n, s in scans.items()})
    # nulls in a key are a key of their own
    same = reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in named))
    joined = met.alias("l").join(carries.alias("r"), same).select("l.*", *[f"r._carry_{n}" for n in scans])

    def both(n: str, s: Scan) -> Column:
        own, before = F.col(f"_local_{n}"), F.col(f"_carry_{n}")
        return own + F.coalesce(before, F.lit(0)) if s.kind == "sum" else F.greatest(own, before) if s.kind == "max" else F.coalesce(own, before)

    kept = [c for c in df.columns if c not in scans]
    return joined.select(*kept, *[both(n, s).alias(n) for n, s in scans.items()])


def quantize(df: DataFrame, key: list[str], order: list[str], beat: str, length: str, rows_per_block: int | None = None) -> DataFrame:
    """ordered.quantize: a running sum of the lengths, then a running maximum with those taken off."""
    rows = running(blocked(df, key, order, rows_per_block), key, order, _taken=Scan("sum", F.col(length), own=False))
    rows = running(rows, key, order, _from=Scan("max", F.col(beat) - F.col("_taken")))
    return rows.withColumn("start_beat", (F.col("_taken") + F.col("_from")).cast("long")).drop("_taken", "_from", BLOCK)


def longest_run(df: DataFrame, key: list[str], order: list[str], flag: str, value: bool = False, rows_per_block: int | None = None) -> DataFrame:
    """ordered.longest_run: runs are numbered by a running count of changes, and counted with partial sums, however long one is."""
    rows = blocked(df.where(F.col(flag).isNotNull()), key, order, rows_per_block)
    rows = running(rows, key, order, _previous=Scan("last", F.col(flag), own=False))
    change = F.coalesce(F.col(flag) != F.col("_previous"), F.lit(True)).cast("long")
    rows = running(rows, key, order, _run=Scan("sum", change))
    counted = rows.groupBy(*key, "_run").agg(F.sum((F.col(flag) == value).cast("long")).alias("n"))
    return counted.groupBy(*key).agg(F.max("n").alias("longest"))


def interpolate_anchors(df: DataFrame, key: list[str], order: list[str], orig_start: str, orig_end: str, anchor_start: str, anchor_end: str, rows_per_block: int | None = None) -> DataFrame:
    """ordered.interpolate_anchors: fills from both sides, a maximum since the last anchor, and the start of the row behind, each as a scan."""
    is_anchor = F.col(anchor_start).isNotNull()
    at = lambda c: F.when(is_anchor, F.col(c))
    rows = running(
        blocked(df, key, order, rows_per_block), key, order, _b_new=Scan("last", at(anchor_start), own=False), _b_old=Scan("last", at(orig_start), own=False),
        _a_new=Scan("last", at(anchor_start), own=False, back=True), _a_old=Scan("last", at(orig_start), own=False, back=True), _part=Scan("sum", is_anchor.cast("long")),
    )
    span = F.col("_a_old") - F.col("_b_old")
    rate = F.when(span > 1e-6, (F.col("_a_new") - F.col("_b_new")) / span)
    scaled = F.coalesce(rate > 0, F.lit(False))
    shift = F.coalesce(F.col("_b_new") - F.col("_b_old"), F.col("_a_new") - F.col("_a_old"))
    moved = F.when(scaled, F.col("_b_new") + (F.col(orig_start) - F.col("_b_old")) * rate).otherwise(F.col(orig_start) + F.coalesce(shift, F.lit(0.0)))
    duration = F.col(orig_end) - F.col(orig_start)
    length = F.when(shift.isNull(), duration).otherwise(F.greatest(F.lit(0.0), duration) * F.when(scaled, rate).otherwise(F.lit(1.0)))
    placed = F.when(is_anchor, "anchor").when(shift.isNotNull(), "interpolated").otherwise("kept")
    rows = rows.withColumns({"_start": F.coalesce(F.col(anchor_start), moved), "_end": F.when(is_anchor, F.col(anchor_end)).otherwise(moved + length), "placed": placed})
    rows = running(rows, [*key, "_part"], order, _held=Scan("max", F.col("_start")))
    held = F.when(is_anchor, F.col("_start")).otherwise(F.least("_held", "_a_new"))
    rows = running(rows.withColumn("new_start", held), key, order, _following=Scan("last", F.col("new_start"), own=False, back=True))
    end = F.greatest(F.least("_end", "_following"), F.col("new_start"))
    return rows.withColumn("new_end", end).drop("_b_new", "_b_old", "_a_new", "_a_old", "_part", "_start", "_end", "_held", "_following", BLOCK)


def two_passes(rows: DataFrame, key: list[str], order: list[str], inputs: list[str], summary: Callable[..., tuple], kinds: str, carry: Callable[[float | None, tuple], float | None], walk: Callable[..., tuple], outputs: tuple[str, str]) -> DataFrame:
    """A scan that is no sum, maximum or fill: summary of a key's rows in a block (fields of kinds), carry folded over a key's summaries, and the rows again with what came before their block.

    rows are blocked. summary(*lists of inputs) sees a key's rows in order; walk(held, *lists of inputs) gives the lists of outputs and what it holds then, for a part of a key's
    rows at a time. Keys stream through the tasks; only a block's first and last key can go on in another block, so the fold holds two rows a block at the most.
    """
    fields = [k.split()[0] for k in kinds.split(", ")]
    typed = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*key, BLOCK]]
    width = len(key)
    placed = rows.select(*key, BLOCK, *order, *[F.col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(inputs)])
    floats = lambda column: column.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  nulls are NaN

    def runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
        """A key and where its rows lie in the batch."""
        keys = list(zip(*(plain(batch.column(c)) for c in names)))
        at = 0
        for end in [*(i for i, (x, y) in enumerate(zip(keys, keys[1:]), 1) if x != y), len(keys)]:
            if at < end:
                yield keys[at], at, end
            at = end

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Summaries of the first and the last key of each block of a task."""
        held, of, done = None, [], []
        values: tuple[list[float], ...] = tuple([] for _ in inputs)

        def close(last: bool) -> None:
            if held is not None and (last or not done or done[-1][width] != held[-1]):
                done.append((*held, *summary(*values)))

        for batch in batches:
            of = [batch.schema.field(c).type for c in [*key, BLOCK]]
            columns = [floats(batch.column(f"_in{i}")) for i in range(len(inputs))]
            for k, at, end in runs(batch, [*key, BLOCK]):
                if k != held:
                    close(held is not None and held[-1] != k[-1])
                    held = k
                    for v in values:
                        v.clear()
                for v, c in zip(values, columns):
                    v.extend(c[at:end])
        close(True)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [*of, *[pa.float64()] * len(fields)])], names=[*key, BLOCK, *fields])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        held, carries = None, []
        for row in pdf[fields].itertuples(index=False):
            carries.append(held)
            held = carry(held, row)
        return pdf[[*key, BLOCK]].assign(_carry=pd.Series(carries, dtype="float64", index=pdf.index))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None
        for batch in batches:
            columns = [floats(batch.column(f"_in{i}")) for i in range(len(inputs))]
            carried = plain(batch.column("_carry"))
            made: tuple[list[float], list[float]] = [], []
            for k, at, end in runs(batch, [*key, BLOCK]):
                if k != before:
                    before, held = k, carried[at]
                *found, held = walk(held, *(c[at:end] for c in columns))
                for out, f in zip(made, found):
                    out.extend(f)
            kept = [batch.column(c) for c in [*key, *order]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(m, pa.float64(), from_pandas=True) for m in made)], names=[*key, *order, *outputs])

    sort = lambda df: df.sortWithinPartitions(BLOCK, *key, *order)
    summaries = sort(placed).mapInArrow(ends, ", ".join([*typed, kinds]))
    carries = summaries.groupBy(*key).applyInPandas(fold, ", ".join([*typed, "_carry double"])).where("_carry is not null")
    same = reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*key, BLOCK]))
    # two rows a block at the most
    met = placed.alias("l").join(F.broadcast(carries).alias("r"), same, "left").select("l.*", "r._carry")
    out = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*key, *order]] + [f"{c} double" for c in outputs]
    return sort(met).mapInArrow(second, ", ".join(out))


def enforce_monotonic(df: DataFrame, key: list[str], order: list[str], start: str, end: str, min_gap: float = MIN_GAP, min_duration: float = MIN_DURATION, rows_per_block: int | None = None) -> DataFrame:
    """ordered.enforce_monotonic in two passes.

    A row forgets what came before it where that ends min_gap or more before the row's own end (or start, if the end is no later), else it adds
    min_gap + min_duration to it. So a block passes a carry on, with its rows' steps added, unless the carry is under the highest place at which a row of it forgets, less the steps before that row.
    """
    step = min_gap + min_duration
    names = [*key, *order]

    def walk(last: float | None, starts: list[float], ends: list[float]) -> tuple[list[float], list[float], float | None]:
        begins, stops = [], []
        for s, e in zip(starts, ends):
            begin = s if last is None or s >= last + min_gap else last + min_gap
            last = begin + min_duration if e <= begin else e
            begins.append(begin)
            stops.append(last)
        return begins, stops, last

    def summary(starts: list[float], ends: list[float]) -> tuple:
        highest = pd.DataFrame({"s": starts, "e": ends}).max(axis=1)
        forgets = highest.to_numpy(float) - min_gap - step * pd.RangeIndex(len(starts)).to_numpy()
        return walk(None, starts, ends)[2], float(forgets.max()), float(len(starts))

    def carry(held: float | None, block: tuple) -> float:
        last, forgets, n = block
        return last if held is None or held < forgets else held + n * step

    rows = blocked(df.select(*names, start, end) if start not in names and end not in names else df, key, order, rows_per_block)
    return two_passes(rows, key, order, [start, end], summary, "last double, forgets double, n double", carry, walk, ("new_start", "new_end"))
