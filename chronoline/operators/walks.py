"""Walks over the rows of two tables that share a key, one key at a time, inside Arrow maps.

Both sides are dealt by key and sorted inside their tasks, so a task streams through its rows and holds one key's. A grouped pandas function
costs milliseconds a key, which is most of the time where keys are many and small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
ROWS_AT_ONCE = 8192


def plain(column: pa.Array) -> list:
    """to_pylist without a scalar object an element, for numbers, booleans and strings."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        values[i] = None
    return values


def dealt(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """df with each key's rows in one task, in order; small results keep all tasks.

    Dealt by a hash of the key: a union of sides that are joined by the key counts as dealt by it already, and stops being so when such a join turns into a broadcast.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, F.xxhash64(*key)).sortWithinPartitions(*key, *order)


def walk_pairs(left: DataFrame, right: DataFrame, key: list[str], order: tuple[list[str], list[str]], one: Callable[[list[tuple], list[tuple]], Iterable[tuple]], fields: str) -> DataFrame:
    """key and fields of one(left rows, right rows), tuples of the columns besides the key in order, of every key that either side has; nulls in a key are a key of their own."""
    named = [c for c in left.columns if c not in key], [c for c in right.columns if c not in key]
    names, types = zip(*(f.split() for f in fields.split(", ")))
    kinds = [left.schema[k].dataType for k in key]

    def side(n: int) -> DataFrame:
        df, out = (left, right)[n], []
        for m, other in enumerate((left, right)):
            own: Callable[[str], Column] = (lambda c: F.col(f"`{c}`")) if m == n else (lambda c, s=other: F.lit(None).cast(s.schema[c].dataType))
            out += [own(c).alias(f"_{m}_{c}") for c in named[m]]
        return df.select(*[F.col(f"`{k}`").cast(t).alias(f"_k{i}") for i, (k, t) in enumerate(zip(key, kinds))], F.lit(n).alias("_side"), *out)

    keys = [f"_k{i}" for i in range(len(key))]
    rows = dealt(side(0).unionAll(side(1)), keys, ["_side", *[f"_{n}_{c}" for n in (0, 1) for c in order[n]]])
    cut = len(key) + 1, len(key) + 1 + len(named[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        sides: tuple[list[tuple], list[tuple]] = [], []
        done: list[tuple] = []
        of: list[pa.DataType] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(of)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, of)], names=[*key, *names])
            done.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch.schema.field(i).type for i in range(len(key))] + [TYPES[t] for t in types]
            columns = batch.columns
            keys, side = list(zip(*map(plain, columns[: len(key)]))), columns[len(key)].to_numpy()
            # only a side's own columns are read, they are null in the other's rows
            rows_of, taken = [], [0, 0]
            for n, own in enumerate((columns[cut[0] : cut[1]], columns[cut[1] :])):
                mine = pa.array(side == n)
                rows_of.append(list(zip(*(plain(c.filter(mine)) for c in own))) if own else [()] * len(keys))
            changes = set((np.flatnonzero(np.diff(side)) + 1).tolist())
            changes.update(i for i, (x, y) in enumerate(zip(keys, keys[1:]), 1) if x != y)
            at = 0
            for end in [*sorted(changes), len(keys)]:
                if keys[at] != held:
                    if held is not None:
                        done += [(*held, *row) for row in one(*sides)]
                        if len(done) >= ROWS_AT_ONCE:
                            yield table()
                    held, sides = keys[at], ([], [])
                n = int(side[at])
                upto = taken[n] + end - at
                sides[n].extend(rows_of[n][taken[n] : upto])
                taken[n], at = upto, end
        if held is not None:
            done += [(*held, *row) for row in one(*sides)]
            yield table()

    typed = [f"`{k}` {t.simpleString()}" for k, t in zip(key, kinds)]
    return rows.mapInArrow(run, ", ".join([*typed, *(f"`{n}` {t}" for n, t in zip(names, types))]))
