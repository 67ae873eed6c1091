"""Range, interval-overlap and nearest joins inside a sequence.

Instead of a theta join, boundaries and rows of a sequence are laid on one time line and counted with
windows, so that a sequence costs a sort and not the product of its sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators.ordered import over, upto


def zone_boundaries(spans: DataFrame, key: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """key, zone, boundary: where zone ``zone`` ends and the next begins, never falling back.

    A boundary is the middle between a span's end and the next start, at least the span's start.
    """
    w = over(key, order)
    raw = (F.col(end) + F.lead(start).over(w)) / 2.0
    zones = spans.withColumn("_raw", F.greatest(raw, F.col(start))).withColumn("zone", (F.row_number().over(w) - 1).cast("long"))
    zones = zones.withColumn("_last", F.lead(start).over(w).isNull()).withColumn("boundary", F.max("_raw").over(upto(key, order)))
    return zones.where(~F.col("_last")).select(*key, "zone", "boundary")


def _count_boundaries(rows: DataFrame, boundaries: DataFrame, key: list[str], at: Column, inclusive: bool, name: str, row_id: str) -> DataFrame:
    """Adds the number of boundaries under ``at`` (or equal to it, if inclusive) to every row."""
    marks = boundaries.select(*key, F.col("boundary").alias("_t"), F.lit(0 if inclusive else 1).alias("_kind"), F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id))
    points = rows.select(*key, at.alias("_t"), F.lit(1 if inclusive else 0).alias("_kind"), row_id)
    w = Window.partitionBy(*key).orderBy("_t", "_kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.unionByName(points).withColumn(name, F.sum(F.col(row_id).isNull().cast("long")).over(w))
    return rows.join(counted.where(F.col(row_id).isNotNull()).select(row_id, name), row_id)


def assign_zones(notes: DataFrame, boundaries: DataFrame, key: list[str], order: list[str], start: str, end: str, row_id: str) -> DataFrame:
    """Adds zone: how many boundaries the middles of the notes so far have reached; the pointer never moves back."""
    middle = (F.col(start) + F.col(end)) / 2.0
    notes = notes.withColumn("_mid", F.max(middle).over(upto(key, order)))
    return _count_boundaries(notes, boundaries, key, F.col("_mid"), True, "zone", row_id).drop("_mid")


def split_by_boundaries(notes: DataFrame, boundaries: DataFrame, key: list[str], start: str, end: str, row_id: str) -> DataFrame:
    """One row a piece: zone, piece_start, piece_end, first_piece; boundaries that repeat inside a note give pieces of no length."""
    low = _count_boundaries(notes, boundaries, key, F.col(start), True, "_low", row_id)
    both = _count_boundaries(low, boundaries, key, F.col(end), False, "_high", row_id).withColumn("_high", F.greatest("_low", "_high"))
    pieces = both.withColumn("zone", F.explode(F.sequence("_low", "_high")))
    at = boundaries.select(*key, F.col("zone").alias("_z"), "boundary")
    left = at.select(*key, (F.col("_z") + 1).alias("zone"), F.col("boundary").alias("_from"))
    right = at.select(*key, F.col("_z").alias("zone"), F.col("boundary").alias("_to"))
    out = pieces.join(left, [*key, "zone"], "left").join(right, [*key, "zone"], "left")
    first, last = F.col("zone") == F.col("_low"), F.col("zone") == F.col("_high")
    return out.withColumns(
        {"piece_start": F.when(first, F.col(start)).otherwise(F.col("_from")), "piece_end": F.when(last, F.col(end)).otherwise(F.col("_to")), "first_piece": first}
    ).drop("_low", "_high", "_from", "_to")


def nearest_note(words: DataFrame, notes: DataFrame, key: list[str], start: str, end: str, pos: str, payload: list[str], row_id: str) -> DataFrame:
    """Adds near_* of the note whose start or end is closest to a word's middle, the first in order on ties.

    Only the edges next to the middle can be closest, so each note gives two edges, and a word reads the last edge up to it and the first edge from it.
    """
    kept = [pos, *payload]
    edge = lambda c: notes.select(*key, F.col(c).alias("_t"), *kept, F.lit(None).cast(words.schema[row_id].dataType).alias(row_id), F.lit(True).alias("_edge"))
    middle = ((F.col(start) + F.col(end)) / 2.0).alias("_t")
    points = words.select(*key, middle, *[F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in kept], row_id, F.lit(False).alias("_edge"))
    line = edge(start).union(edge(end)).union(points)
    # of equal edges the first note in order stands; the last edge up to a row is read in either direction, so that no row looks at all that follow it
    up, down = (Window.partitionBy(*key).orderBy(c) for c in (F.desc("_t"), F.asc("_t")))
    note = F.when(F.col("_edge"), F.struct(F.col("_t").alias("_e"), *kept))
    line = line.withColumn("_note", F.min_by(note, F.when(F.col("_edge"), F.col(pos))).over(up.rangeBetween(Window.currentRow, Window.currentRow))).select(*key, "_t", row_id, "_edge", "_note")
    upto = lambda w: F.last("_note", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("_up", upto(up)).withColumn("_down", upto(down))
    met = line.where(~F.col("_edge"))
    gap = lambda c: F.abs(F.col("_t") - F.col(f"{c}._e"))
    lower = F.col("_up").isNull() | (gap("_down") < gap("_up")) | ((gap("_down") == gap("_up")) & (F.col(f"_down.{pos}") <= F.col(f"_up.{pos}")))
    chosen = met.withColumn("_best", F.when(F.col("_down").isNotNull() & lower, F.col("_down")).otherwise(F.col("_up")))
    return words.join(chosen.select(row_id, *[F.col(f"_best.{c}").alias(f"near_{c}") for c in kept]), row_id)


def line_windows(lines: DataFrame, key: list[str], order: list[str], t: str, tail: float = 5.0) -> DataFrame:
    """Adds t_end: the next line's time, or tail seconds after the last."""
    return lines.withColumn("t_end", F.coalesce(F.lead(t).over(over(key, order)), F.col(t) + tail))


def frames_in_notes(notes: DataFrame, frames: DataFrame, key: list[str], start: str, end: str, t: str, row_id: str, bucket: float) -> DataFrame:
    """Inner range join of frames to the notes that hold their time, on buckets of time, so that a note meets only nearby frames.

    A note of no frame takes the first frame behind its start, if there is one.
    """
    buckets = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    near = notes.withColumn("_b", F.explode(buckets))
    held = frames.withColumn("_b", F.floor(F.col(t) / bucket))
    inside = near.join(held, [*key, "_b"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("_b")
    lone = notes.join(inside.select(row_id).distinct(), row_id, "left_anti")
    marks = frames.select(*key, F.col(t).alias("_t"), F.struct(*[c for c in frames.columns if c not in key]).alias("_f"))
    points = lone.select(*key, F.col(start).alias("_t"), F.col(row_id)).withColumn("_f", F.lit(None).cast(marks.schema["_f"].dataType))
    line = marks.withColumn(row_id, F.lit(None).cast(notes.schema[row_id].dataType)).unionByName(points)
    next_ = F.first("_f", True).over(Window.partitionBy(*key).orderBy("_t").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = line.withColumn("_next", next_).where(F.col(row_id).isNotNull() & F.col("_next").isNotNull())
    extra = lone.join(found.select(row_id, "_next.*"), row_id)
    return inside.unionByName(extra.select(*inside.columns))


def within_windows(points: DataFrame, windows: DataFrame, key: list[str], t: str, low: str, high: str, bucket: float) -> DataFrame:
    """points and windows of a key where low <= t <= high, columns of both; an equi-join on buckets, whatever the windows' lengths.

    A window meets buckets of a size like its own, twice the bucket as often as needed, so it lies in three at the most; a point is in one bucket of each size that its key has.
    Windows without a length or the wrong way round meet nothing.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(bucket)) / bucket))).cast("int")
    at = lambda c, level: F.floor(c / (F.lit(bucket) * F.pow(F.lit(2.0), level))).cast("long")
    sized = windows.where(F.col(low) <= F.col(high)).withColumn("_size", size)
    dealt = sized.withColumn("_bucket", F.explode(F.sequence(at(F.col(low), F.col("_size")), at(F.col(high), F.col("_size")))))
    sizes = sized.groupBy(*key).agg(F.collect_set("_size").alias("_sizes"))
    spread = points.join(sizes, key).withColumn("_size", F.explode("_sizes")).withColumn("_bucket", at(F.col(t), F.col("_size"))).drop("_sizes")
    return spread.join(dealt, [*key, "_size", "_bucket"]).where(F.col(t).between(F.col(low), F.col(high))).drop("_size", "_bucket")
