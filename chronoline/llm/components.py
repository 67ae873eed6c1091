"""Connected components of a link table.

Every task first folds its own links into a forest with an array union-find, so
that a clump of copies shrinks where it lies. A table that holds at most
``one_task`` links after that (a checked bound, 16 bytes a link) is finished by one
task; a larger one goes through rounds of alternating large and small stars, each
written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import checkpoint

ONE_TASK_LINKS = 2_000_000


def spanning_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's group under the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node) of the links of one task, folded whenever enough have come together."""
    a, b = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    waiting: list[pa.RecordBatch] = []

    def fold(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([own, *(np.asarray(x.column(i)).astype(np.int64) for x in waiting)]) for i, own in enumerate((a, b)))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = spanning_labels(len(ids), at[: len(a)], at[len(a) :])
        own = np.flatnonzero(label != np.arange(len(ids)))
        return ids[own], ids[label[own]]

    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) > max(500_000, len(a)):
            a, b = fold(a, b)
            waiting = []
    a, b = fold(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = checkpoint(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """edges(a, b) of integers -> (node, root): the smallest node reachable, for every linked node but the roots.

    Self links and nulls are ignored, repeated links count once. The number of rounds grows with the
    logarithm of a component's size.
    """
    linked = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    linked = checkpoint(linked.mapInArrow(_forest, "a bigint, b bigint"))
    state = _state(linked)
    if state[0] <= one_task:
        return checkpoint(linked.coalesce(1).mapInArrow(_forest, "node bigint, root bigint")) if state[0] else linked.toDF("node", "root")
    while state[0]:
        nxt = checkpoint(_small_star(checkpoint(_large_star(linked))))
        before, state = state, _state(nxt)
        linked = nxt
        if state == before:
            break
    return linked.toDF("node", "root")
