"""Queries of the scans over long sequences: the data and SQL of their window forms, cut into blocks, and line items as three sequences that hold all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.operators import scans as X
from chronoline.plans import sequence_queries as Q
from chronoline.session import table

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: Small, so that the blocks of a test table are many.
BLOCK_ROWS = 4_000


def long_quantize(spark, sf_dir):
    """Three sequences, each of about a third of the line items."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_ORDER, F.floor(F.col("l_extendedprice") / 10).cast("long").alias("beat"), (F.col("l_quantity").cast("long") % 4).alias("len"))
    placed = X.quantize(li, ["l_returnflag"], LINE_ORDER, "beat", "len", BLOCK_ROWS)
    return placed.groupBy("l_returnflag", "l_shipdate").agg(F.count("*").alias("rows"), F.sum("start_beat").alias("beats"), F.max("start_beat").alias("last_beat"))


LONG_QUANTIZE_SQL = f"""
with b as (select *, floor(l_extendedprice / 10)::bigint as beat, l_quantity::bigint % 4 as len from lineitem),
p as (select *, coalesce(sum(len) over (partition by l_returnflag order by {', '.join(LINE_ORDER)} rows between unbounded preceding and 1 preceding), 0)::bigint as taken from b),
q as (select *, (taken + max(beat - taken) over (partition by l_returnflag order by {', '.join(LINE_ORDER)} rows between unbounded preceding and current row))::bigint as start_beat from p)
select l_returnflag, l_shipdate, count(*) as rows, sum(start_beat)::bigint as beats, max(start_beat) as last_beat from q group by all"""


def long_runs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_ORDER, (F.col("l_quantity") > 8).alias("sure"))
    return X.longest_run(li, ["l_returnflag"], LINE_ORDER, "sure", True, BLOCK_ROWS)


LONG_RUNS_SQL = f"""
with f as (select *, l_quantity > 8 as sure from lineitem),
g as (select l_returnflag, sure, sum(case when sure then 0 else 1 end) over (partition by l_returnflag order by {', '.join(LINE_ORDER)} rows between unbounded preceding and current row) as g from f),
n as (select l_returnflag, g, count(*) filter (where sure) as n from g group by all)
select l_returnflag, max(n)::bigint as longest from n group by l_returnflag"""


def long_interpolate(spark, sf_dir):
    out = X.interpolate_anchors(Q._anchors(spark, sf_dir), Q.KEY, Q.ORDER, "s", "e", "a", "ae", BLOCK_ROWS)
    return out.select("user_id", "event_id", "placed", F.round("new_start", 4).alias("new_start"), F.round("new_end", 4).alias("new_end"))


def long_monotonic(spark, sf_dir):
    ev = Q._anchors(spark, sf_dir).select("user_id", "t_us", "event_id", (F.col("s") / 1000).alias("s"), F.when(F.col("event_type") == "error", F.col("s") / 1000 - 1).otherwise(F.col("e") / 1000).alias("e"))
    out = X.enforce_monotonic(ev, Q.KEY, Q.ORDER, "s", "e", rows_per_block=BLOCK_ROWS)
    return out.select("user_id", "event_id", F.round("new_start", 6).alias("new_start"), F.round("new_end", 6).alias("new_end"))


QUERIES = {"long_quantize": long_quantize, "long_runs": long_runs, "long_interpolate": long_interpolate, "long_monotonic": long_monotonic}
ORACLES = {"long_quantize": LONG_QUANTIZE_SQL, "long_runs": LONG_RUNS_SQL, "long_interpolate": Q.ANCHOR_SQL, "long_monotonic": Q.MONOTONIC_SQL}
