"""Operator 7: optimal length buckets, then token-budget batches inside them.

One map gives each document its length, written out with a row number; one narrow job counts
the global histogram over exact lengths (one row a length that occurs, however many
documents there are: at most the longest text's length of them reach the driver). A dynamic programme picks the at most
``n_buckets`` boundaries with the least total padding. The cost of a run of
lengths is a Monge array, so the best cut moves one way only: each layer is solved by halving, O(n log n) for n
lengths, and exactly, in whole numbers. A boundary is always the
largest length that occurs in its bucket. Every document of a bucket is padded
to its boundary, so a batch holds ``budget // boundary`` documents. Rows of a
bucket are dealt by a hash of their row to shards of about ``shard_rows`` documents and batches
are cut inside a shard, so no bucket, and no id that many rows share, meets in one task; a shard leaves at most one
batch that is not full.

``pack_documents`` counts words for tokens; ``pack_lengths`` takes the lengths of any tokenizer, such as operator 9's n_tokens.

Defined cases: null and empty texts have length 0 and join the shortest bucket;
a document longer than the budget is a batch of its own, never cut or dropped;
repeated rows are packed one by one; an empty table gives an empty result; ids
may be null; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.llm.common import checkpoint, words_of

N_BUCKETS = 16
TOKEN_BUDGET = 32768
SHARD_ROWS = 4096


@dataclass(frozen=True)
class Plan:
    """Ascending boundaries and the documents that each bucket holds."""

    boundaries: tuple[int, ...]
    counts: tuple[int, ...]
    padding: int


def best_cuts(before: np.ndarray, edge: np.ndarray, upto: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every end j the first i < j with the least before[i] + padding of lengths i to j - 1 as one bucket, and that sum.

    Ends are solved level by level, each between the cuts of its solved neighbours; a level is one pass over whole arrays.
    """
    n = len(edge)
    cut, least = np.zeros(n + 2, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    cut[n + 1] = n - 1
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        j = np.arange(step, n + 1, 2 * step)
        above = np.minimum(j + step, n + 1)
        low, high = cut[j - step], np.minimum(cut[above], j - 1)
        width = high - low + 1
        begin = np.concatenate([[0], np.cumsum(width)[:-1]])
        i = np.arange(int(width.sum())) - np.repeat(begin - low, width)
        end = np.repeat(j, width)
        cost = before[i] + edge[end - 1] * (upto[end] - upto[i]) - (total[end] - total[i])
        least[j] = np.minimum.reduceat(cost, begin)
        hit = np.flatnonzero(cost == np.repeat(least[j], width))
        cut[j] = i[hit[np.searchsorted(hit, begin)]]
        step //= 2
    return least, cut[: n + 1]


def choose_boundaries(rows: list[int], lengths: list[int], n_buckets: int = N_BUCKETS) -> Plan:
    """Least-padding split of ascending lengths into at most n_buckets runs; on ties the fewest buckets."""
    n = len(rows)
    if not n:
        return Plan((), (), 0)
    count, edge = np.array(rows, dtype=np.int64), np.array(lengths, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([[0], np.cumsum(count * edge)])
    least = np.concatenate([[0], edge * upto[1:] - total[1:]])  # one bucket
    layers, cuts = [int(least[n])], [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(n_buckets, n)):
        least, cut = best_cuts(least, edge, upto, total)
        layers.append(int(least[n]))
        cuts.append(cut)
    k = int(np.argmin(layers))
    ends, j = [], n
    for layer in range(k, -1, -1):
        if j:
            ends.append(j)
        j = int(cuts[layer][j])
    ends = ends[::-1]
    starts = [0, *ends[:-1]]
    return Plan(tuple(int(edge[e - 1]) for e in ends), tuple(int(upto[e] - upto[s]) for s, e in zip(starts, ends)), layers[k])


def plan_buckets(lengths: DataFrame, n_buckets: int = N_BUCKETS) -> Plan:
    found = sorted(lengths.groupBy("n_tokens").agg(F.count("*").alias("rows")).collect(), key=lambda r: r["n_tokens"])  # one row a length
    return choose_boundaries([r["rows"] for r in found], [r["n_tokens"] for r in found], n_buckets)


def pack_lengths(lengths: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lengths(doc_id, n_tokens) -> doc_id, n_tokens, bucket, boundary, batch_id, position, padding."""
    lengths = checkpoint(lengths.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    plan = plan_buckets(lengths, n_buckets)
    bucket, boundary, shards, per_batch = F.lit(0), F.lit(0).cast("long"), F.lit(1), F.lit(1).cast("long")
    for k in reversed(range(len(plan.boundaries))):
        here = F.col("n_tokens") <= plan.boundaries[k]
        bucket = F.when(here, F.lit(k)).otherwise(bucket)
        boundary = F.when(here, F.lit(plan.boundaries[k]).cast("long")).otherwise(boundary)
        shards = F.when(here, F.lit(max(1, math.ceil(plan.counts[k] / shard_rows)))).otherwise(shards)
        per_batch = F.when(here, F.lit(max(1, budget // max(1, plan.boundaries[k]))).cast("long")).otherwise(per_batch)
    dealt = lengths.withColumns({"bucket": bucket, "boundary": boundary, "per_batch": per_batch})
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), shards).cast("int"))
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "row")) - 1
    placed = dealt.withColumn("at", at.cast("long"))
    batch = F.col("bucket").cast("long") * F.lit(1 << 48) + F.col("shard").cast("long") * F.lit(1 << 20) + F.floor(F.col("at") / F.col("per_batch"))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "boundary", batch.cast("long").alias("batch_id"),
        (F.col("at") % F.col("per_batch")).cast("int").alias("position"), (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the whole text stand for its tokens."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return pack_lengths(token_lengths(docs), n_buckets, budget, shard_rows)
