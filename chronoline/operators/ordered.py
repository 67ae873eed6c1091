"""Ordered-sequence operators: closed forms over windows, folds only where none exists.

Every function takes the key columns of a sequence and the columns that order it
(ties included), and adds columns. A sequence lives in one window partition; sequences are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_GAP, MIN_DURATION = 0.01, 0.06
LINE_GAP, SOFT_GAP, LINE_SYLLABLES = 0.35, 0.15, 8
SLIVER_SECONDS = 0.12


def over(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def before(key: list[str], order: list[str]):
    return over(key, order).rowsBetween(Window.unboundedPreceding, -1)


def upto(key: list[str], order: list[str]):
    return over(key, order).rowsBetween(Window.unboundedPreceding, 0)


def after(key: list[str], order: list[str]):
    """The rows behind a row, the nearest last: read backwards, since a frame that ends with the sequence is read anew for each row."""
    return Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)


def onward(key: list[str], order: list[str]):
    return over(key, order).rowsBetween(0, Window.unboundedFollowing)


def islands(df: DataFrame, key: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 0: a row where ``starts`` holds opens a new one; the first row always does."""
    flag = F.when(F.row_number().over(over(key, order)) == 1, 0).otherwise(F.coalesce(starts, F.lit(False)).cast("int"))
    return df.withColumn("_starts", flag).withColumn(name, F.sum("_starts").over(upto(key, order)).cast("long")).drop("_starts")


def gap_groups(df: DataFrame, key: list[str], order: list[str], start: str, end: str, max_gap, name: str = "grp") -> DataFrame:
    """A group goes on while a row starts at most max_gap after the end of the row before it."""
    gap = F.col(start) - F.lag(end).over(over(key, order))
    return islands(df, key, order, gap > max_gap, name)


def fill_forward(column: str, key: list[str], order: list[str]) -> Column:
    """The last value so far; a leading run of nulls takes the first value."""
    return F.coalesce(F.last(column, True).over(upto(key, order)), F.first(column, True).over(onward(key, order)))


def monotone_anchors(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that are not under any kept row before them."""
    top = F.max(value).over(before(key, order))
    return df.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(value) >= F.col("_top"))).drop("_top")


def quantize(df: DataFrame, key: list[str], order: list[str], beat: str, length: str) -> DataFrame:
    """Adds start_beat: rows never overlap, each starts at its beat or where the row before it ends.

    The recurrence start = max(beat, end of the row before) is a running maximum once the lengths before a row are taken off.
    """
    taken = F.coalesce(F.sum(length).over(before(key, order)), F.lit(0))
    df = df.withColumn("_taken", taken)
    return df.withColumn("start_beat", (F.col("_taken") + F.max(F.col(beat) - F.col("_taken")).over(upto(key, order))).cast("long")).drop("_taken")


def quantize_entries(df: DataFrame, key: list[str], order: list[str], kind: str = "kind", beat: str = "beat", length: str = "len", end_beat: str = "end_beat") -> DataFrame:
    """quantize for syllables and breaks: a break moves behind what is taken and takes nothing itself."""
    is_syl = F.col(kind) == "syl"
    df = df.withColumn("_len", F.when(is_syl, F.greatest(F.lit(1), F.col(length))).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_taken", F.coalesce(F.sum("_len").over(before(key, order)), F.lit(0)))
    df = df.withColumn("_from", F.max(F.when(is_syl, F.col(beat) - F.col("_taken"))).over(upto(key, order)))
    start = F.when(is_syl, F.col("_taken") + F.col("_from")).otherwise(F.greatest(F.col(beat), F.col("_taken") + F.col("_from")))
    df = df.withColumn("start_beat", start.cast("long"))
    out_end = F.when(~is_syl & F.col(end_beat).isNotNull(), F.greatest(F.col(end_beat), F.col("start_beat")))
    return df.withColumn("out_len", F.when(is_syl, F.col("_len"))).withColumn("out_end", out_end.cast("long")).drop("_len", "_taken", "_from")


def merge_tails(df: DataFrame, key: list[str], order: list[str], text: str, pitch: str, beat: str, length: str, tail: str = "~") -> DataFrame:
    """One row a melisma: tails of the same pitch that touch the row before join it. The tail's neighbour is the raw row before it."""
    w = over(key, order)
    joins = (F.btrim(text) == tail) & (F.col(pitch) == F.lag(pitch).over(w)) & (F.col(beat) == F.lag(F.col(beat) + F.col(length)).over(w))
    df = islands(df, key, order, ~F.coalesce(joins, F.lit(False)), "island")
    first = lambda c: F.min_by(c, F.struct(*order)).alias(c)
    return df.groupBy(*key, "island").agg(first(text), first(pitch), first(beat), F.sum(length).cast("long").alias(length), F.count("*").alias("merged"))


def padded_median(df: DataFrame, key: list[str], order: list[str], value: str, voiced: str, window: int = 5, name: str = "smooth") -> DataFrame:
    """Odd-window median inside each voiced run of three or more, edges repeated; other rows keep their value."""
    half = window // 2
    runs = islands(df, key, order, F.col(voiced) != F.lag(voiced).over(over(key, order)), "_run")
    run = [*key, "_run"]
    whole = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = Window.partitionBy(*run).orderBy(*order)
    runs = runs.withColumns({"_n": F.count("*").over(Window.partitionBy(*run)), "_i": F.row_number().over(near), "_first": F.first(value).over(whole), "_last": F.last(value).over(whole)})
    around = [
        F.when(F.col("_i") + d < 1, F.col("_first")).when(F.col("_i") + d > F.col("_n"), F.col("_last")).otherwise(F.lag(value, -d).over(near) if d < 0 else F.lead(value, d).over(near) if d else F.col(value))
        for d in range(-half, half + 1)
    ]
    sorted_ = F.sort_array(F.filter(F.array(*around), lambda x: x.isNotNull()))
    n = F.size(sorted_)
    middle = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    smooth = F.when(F.col(voiced) & (F.col("_n") >= 3) & (n > 0), middle).otherwise(F.col(value))
    return runs.withColumn(name, smooth).drop("_run", "_n", "_i", "_first", "_last")


def interpolate_anchors(df: DataFrame, key: list[str], order: list[str], orig_start: str, orig_end: str, anchor_start: str, anchor_end: str) -> DataFrame:
    """Adds new_start, new_end, placed: rows without an anchor (null anchor_start) move with the anchors around them.

    Between two anchors by their rate, beside one by its shift, without any not at all; then rows without an anchor
    are held between the starts around them, and an end never passes the next start.
    """
    up, down = before(key, order), after(key, order)
    is_anchor = F.col(anchor_start).isNotNull()
    at = lambda c: F.when(is_anchor, F.col(c))
    # backwards first: the windows that follow share the other order
    df = df.withColumns({"_a_new": F.last(at(anchor_start), True).over(down), "_a_old": F.last(at(orig_start), True).over(down)})
    df = df.withColumns({"_b_new": F.last(at(anchor_start), True).over(up), "_b_old": F.last(at(orig_start), True).over(up)})
    span = F.col("_a_old") - F.col("_b_old")
    rate = F.when(span > 1e-6, (F.col("_a_new") - F.col("_b_new")) / span)
    both = F.col("_b_new").isNotNull() & F.col("_a_new").isNotNull()
    duration = F.greatest(F.lit(0.0), F.col(orig_end) - F.col(orig_start))
    scaled = both & (rate > 0)
    shift = F.coalesce(F.col("_b_new") - F.col("_b_old"), F.col("_a_new") - F.col("_a_old"))
    start = F.when(is_anchor, F.col(anchor_start)).when(scaled, F.col("_b_new") + (F.col(orig_start) - F.col("_b_old")) * rate)
    start = start.when(shift.isNotNull(), F.col(orig_start) + shift).otherwise(F.col(orig_start))
    length = F.when(scaled, duration * rate).when(shift.isNotNull(), duration).otherwise(F.col(orig_end) - F.col(orig_start))
    placed = F.when(is_anchor, "anchor").when(shift.isNotNull(), "interpolated").otherwise("kept")
    df = df.withColumns({"_start": start, "_end": F.when(is_anchor, F.col(anchor_end)).otherwise(start + length), "placed": placed})
    # forward clamp: the maximum since the last anchor; then down to the next anchor
    df = df.withColumn("_block", F.sum(is_anchor.cast("int")).over(upto(key, order)))
    df = df.withColumn("_held", F.when(is_anchor, F.col("_start")).otherwise(F.max("_start").over(upto([*key, "_block"], order))))
    df = df.withColumn("new_start", F.when(is_anchor, F.col("_held")).otherwise(F.least("_held", "_a_new")))
    following = F.lead("new_start").over(over(key, order))
    end = F.greatest(F.least("_end", following), F.col("new_start"))
    return df.withColumn("new_end", end).drop("_b_new", "_b_old", "_a_new", "_a_old", "_start", "_end", "_block", "_held")


def longest_run(df: DataFrame, key: list[str], order: list[str], flag: str, value: bool = False) -> DataFrame:
    """longest: length of the longest run of rows where flag equals value, 0 if none does."""
    runs = islands(df, key, order, F.col(flag) != F.lag(flag).over(over(key, order)), "_run")
    counted = runs.groupBy(*key, "_run").agg(F.sum((F.col(flag) == value).cast("long")).alias("n"))
    return counted.groupBy(*key).agg(F.max("n").alias("longest"))


def word_ids(df: DataFrame, key: list[str], order: list[str], is_word_start: str, name: str = "word_id") -> DataFrame:
    return islands(df, key, order, F.col(is_word_start), name)


def collect_words(df: DataFrame, key: list[str], order: list[str], is_word_start: str, text: str, start: str, end: str) -> DataFrame:
    """One row a word: concatenated text, first start, last end."""
    numbered = word_ids(df, key, order, is_word_start)
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda s: s[text]), "")
    return numbered.groupBy(*key, "word_id").agg(pieces.alias("word"), F.min_by(start, F.struct(*order)).alias("start"), F.max_by(end, F.struct(*order)).alias("end"))


def drop_leading_slivers(df: DataFrame, key: list[str], order: list[str], start: str, end: str, protected: str, limit: float = SLIVER_SECONDS) -> DataFrame:
    """Without the leading rows that are short and unprotected; the last row always stays."""
    sliver = ((F.col(end) - F.col(start)) < limit) & ~F.col(protected)
    df = df.withColumn("_lead", F.min(sliver.cast("int")).over(upto(key, order))).withColumn("_left", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])))
    return df.where((F.col("_lead") == 0) | (F.col("_left") == 1)).drop("_lead", "_left")


def reposition_breaks(df: DataFrame, key: list[str], order: list[str], kind: str, start: str, end: str) -> DataFrame:
    """Breaks start where the syllable before them ends and, if they had an end, end where the next one starts."""
    syl = F.col(kind) == "syl"
    before_end = F.last(F.when(syl, F.col(end)), True).over(before(key, order))
    next_start = F.first(F.when(syl, F.col(start)), True).over(onward(key, order))
    new_start = F.when(syl, F.col(start)).otherwise(F.coalesce(before_end, next_start, F.col(start)))
    new_end = F.when(syl | F.col(end).isNull(), F.col(end)).otherwise(F.coalesce(next_start, before_end, F.col(start)))
    return df.withColumns({"new_start": new_start, "new_end": new_end})


def spread_in_word(start: Column, end: Column, low: Column, high: Column, new_low: Column, new_high: Column, k: Column, n: Column) -> Column:
    """struct(start, end) of a syllable when its word moves from [low, high] to [new_low, new_high]."""
    width, span = high - low, new_high - new_low
    moved = lambda t: new_low + (t - low) / width * span
    even = lambda i: new_low + i * span / n
    wide = width > 0
    return F.struct(F.when(wide, moved(start)).otherwise(even(k)).alias("start"), F.when(wide, moved(end)).otherwise(even(k + 1)).alias("end"))


# folds: one array a sequence, for recurrences that have no closed form


def _fold(df: DataFrame, key: list[str], order: list[str], fields: list[str], zero: Column, step, finish) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return df.groupBy(*key).agg(rows.alias("_rows")).select(*key, F.aggregate("_rows", zero, step, finish).alias("_out"))


def enforce_monotonic(df: DataFrame, key: list[str], order: list[str], start: str, end: str, min_gap: float = MIN_GAP, min_duration: float = MIN_DURATION) -> DataFrame:
    """new_start, new_end in the given order: a row starts min_gap after the end before it, and an end that is not behind its start moves min_duration behind it."""
    item = "struct<" + ", ".join(f"{c}: {df.schema[c].dataType.simpleString()}" for c in order) + ", new_start: double, new_end: double>"
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        pushed = F.coalesce(F.greatest(row[start], acc["last"] + min_gap), row[start])
        begin = F.when(acc["last"].isNotNull() & (row[start] < acc["last"] + min_gap), pushed).otherwise(row[start]).cast("double")
        stop = F.when(row[end] <= begin, begin + min_duration).otherwise(row[end]).cast("double")
        made = F.struct(*[row[c].alias(c) for c in order], begin.alias("new_start"), stop.alias("new_end"))
        return F.struct(stop.alias("last"), F.concat(acc["out"], F.array(made)).alias("out"))

    return _fold(df, key, order, [start, end], zero, step, lambda acc: acc["out"]).select(*key, F.inline("_out"))
