"""Placing words and lines in time, and judging such placements: cuts by weights, seeds, windows, lags, reference texts.

All of it is window algebra or a keyed join; a sequence is one song, as in ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import ordered as O

MIN_SPAN = 1e-6
ANCHOR_TOLERANCE = 0.5
WINDOW_SECONDS, WINDOW_STEP, WINDOW_GAIN = 10.0, 1.0, 0.1
LINE_GAP_SECONDS = 0.35
ALIGN_BASE, ALIGN_PER_WORD, ALIGN_SLOP = 0.1, 0.08, 0.5


def _upto(weights: Column, i: Column) -> Column:
    """Sum of the first i weights."""
    return F.aggregate(F.slice(weights, 1, i), F.lit(0.0), lambda acc, w: acc + w)


def _running(values: Column, first: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """first, and every fold of the values so far."""
    return F.aggregate(values, F.array(first.cast(kind)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x).cast(kind))))


def slice_text(text: Column, weights: Column) -> Column:
    """One piece of text a weight, cut at half-even rounded shares of its length, each piece a character or more; null if it is too short.

    A cut is pushed past the one before it and held back for the pieces to come; both bounds move one a piece, so cut i is
    ``i + least(length - n, running maximum of (share - i))``.
    """
    n, size = F.size(weights), F.length(text)
    # one-element arrays hold what is worked out once a row: an expression that a lambda repeats is evaluated anew each time
    sums = _running(weights, F.lit(0.0), lambda acc, w: acc + w, "double")

    def bounds(upto: Column) -> Column:
        whole = F.element_at(upto, -1)
        divisor = F.when(whole == 0, n).otherwise(whole)
        shares = F.transform(upto, lambda s, i: F.bround(s / divisor * size).cast("int") - i)
        highest = _running(F.slice(shares, 2, n), F.get(shares, F.lit(0)), lambda acc, x: F.greatest(acc, x), "int")
        return F.transform(highest, lambda top, i: F.when(i == n, size).otherwise(i + F.least(size - n, top)))

    cuts = F.flatten(F.transform(F.array(sums), bounds))
    cut = lambda c: F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: F.substring(text, x + 1, y - x))
    pieces = F.flatten(F.transform(F.array(cuts), cut))
    return F.when((n > 0) & (size >= n), pieces)


def slice_span(start: Column, duration: Column, weights: Column) -> Column:
    """Ends of the spans that share a duration by weight; each is at least a millionth of a second long."""
    n = F.size(weights)
    whole = _upto(weights, n)
    at = lambda j: F.when(j == n, start + duration).otherwise(start + duration * (_upto(weights, j) / F.when(whole == 0, n).otherwise(whole)))
    end = lambda i: F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: at(j) + (i - j) * F.lit(MIN_SPAN)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), end))


def seed_line_starts(words: DataFrame, key: list[str], order: list[str], line: str, line_start: str, start: str, end: str, anchor: str) -> DataFrame:
    """Adds seed_start and seed_end: the line's start, with the word's own length, for the first word of a line that has no anchor."""
    first = F.col(line).isNotNull() & ~F.col(line).eqNullSafe(F.lag(line).over(O.over(key, order)))
    seeds = first & F.col(anchor).isNull()
    length = F.greatest(F.lit(0.0), F.col(end) - F.col(start))
    return words.withColumns({"seed_start": F.when(seeds, F.col(line_start)), "seed_end": F.when(seeds, F.col(line_start) + length)})


def override_first_line(lines: DataFrame, candidates: DataFrame, key: list[str], tolerance: float = ANCHOR_TOLERANCE) -> DataFrame:
    """lines(key, line_no, t): line 0 takes its own heard start (t + delta of candidates) where the calibrated one is further off than the tolerance."""
    direct = candidates.where("line_no = 0").select(*key, "line_no", (F.col("t") + F.col("delta")).alias("_direct"))
    far = F.abs(F.col("t") - F.col("_direct")) > tolerance
    return lines.join(direct, [*key, "line_no"], "left").withColumn("t", F.when(far, F.col("_direct")).otherwise(F.col("t"))).drop("_direct")


def lines_of_entries(entries: DataFrame, key: list[str], order: list[str], kind: str = "kind", text: str = "text", is_word_start: str = "is_word_start") -> DataFrame:
    """Syllables with line_no; a break counts only after a syllable."""
    w = O.over(key, order)
    closes = (F.col(kind) == "break") & F.lag(kind).over(w).eqNullSafe("syl")
    numbered = entries.withColumn("line_no", F.coalesce(F.sum(closes.cast("long")).over(O.upto(key, order)), F.lit(0)))
    return numbered.where(F.col(kind) == "syl")


def line_texts(entries: DataFrame, key: list[str], order: list[str], text: str = "text", is_word_start: str = "is_word_start") -> DataFrame:
    """key, line_no, line: the syllables of lines_of_entries joined up, with a space before every later word."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.concat(F.when(F.col(is_word_start), " ").otherwise(""), F.col(text)).alias("piece"), F.col(text).alias("bare"))))
    joined = F.concat(F.get("rows", F.lit(0))["bare"], F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: r["piece"]), ""))
    return entries.groupBy(*key, "line_no").agg(rows.alias("rows")).select(*key, "line_no", joined.alias("line"))


def notes_as_entries(notes: DataFrame, key: list[str], order: list[str], start: str, end: str, pitch: str, gap: float = LINE_GAP_SECONDS) -> DataFrame:
    """A chart of the bare notes: each note a word named by its pitch, a break over every silence of at least the gap."""
    prev = F.lag(end).over(O.over(key, order))
    note = F.struct(F.lit("syl").alias("kind"), F.lit(1).alias("part"), F.col(start).alias("start"), F.col(end).alias("end"), S.pitch_name(F.col(pitch)).alias("text"), S.note_type(F.col(end) - F.col(start)).alias("note_type"))
    rest = F.struct(F.lit("break").alias("kind"), F.lit(0).alias("part"), F.col("_prev").alias("start"), F.col(start).alias("end"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("note_type"))
    both = notes.withColumn("_prev", prev)
    entries = F.when(F.col(start) - F.col("_prev") >= gap, F.array(rest, note)).otherwise(F.array(note))
    return both.select(*key, *order, F.explode(entries).alias("e")).select(*key, *order, "e.*")


def changed_words(before: DataFrame, after: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Words of before whose text changed or that after drops or lacks, matched by their span; of several with one span the last of after counts.

    Both have key, order, start, end and text, after also dropped; the new text is null for a dropped word.
    """
    latest = after.groupBy(*key, "start", "end").agg(F.max_by(F.struct(F.col("text").alias("new_text"), "dropped"), F.struct(*order)).alias("_a"))
    both = before.join(latest, [*key, "start", "end"], "left")
    gone = F.col("_a").isNull() | F.coalesce(F.col("_a.dropped"), F.lit(False))
    return both.where(gone | (F.col("text") != F.col("_a.new_text"))).select(*key, *order, "start", "end", "text", F.when(~gone, F.col("_a.new_text")).alias("new_text"))


def apply_reference(words: DataFrame, text: str = "text", reference: str = "reference_text") -> DataFrame:
    """Adds new_text and replaced: the reference's text where the two do not even contain each other."""
    differs = F.col(reference).isNotNull() & ~F.coalesce(S.loosely_equal(S.normalize_edges(F.col(text)), S.normalize_edges(F.col(reference))), F.lit(False))
    return words.withColumns({"new_text": F.when(differs, F.col(reference)).otherwise(F.col(text)), "replaced": differs})


def windows_of(segments: DataFrame, start: str, end: str, least: float = WINDOW_SECONDS, width: float = WINDOW_SECONDS, step: float = WINDOW_STEP) -> DataFrame:
    """One row for each window that starts a whole number of steps into a segment of at least the given length; windows end with the segment."""
    length = F.col(end) - F.col(start)
    steps = F.sequence(F.lit(0), F.ceil(length / step).cast("int") - 1)
    rows = segments.where(length >= least).withColumn("window_no", F.explode(steps))
    begin = F.col(start) + F.col("window_no") * F.lit(step)
    return rows.withColumns({"window_start": begin, "window_end": F.least(begin + width, F.col(end))})


def best_windows(windows: DataFrame, key: list[str], start: str, end: str, baseline: str, score: str, gain: float = WINDOW_GAIN) -> DataFrame:
    """key, new_start, new_end, moved: the best window of a segment, the earliest on ties, where it beats the segment's own score by the gain."""
    best = windows.groupBy(*key, start, end, baseline).agg(F.max_by(F.struct("window_start", "window_end", score), F.struct(score, -F.col("window_no"))).alias("w"))
    moved = (F.col(f"w.{score}") > F.col(baseline)) & (F.col(f"w.{score}") >= F.col(baseline) + gain)
    at = lambda inner, own: F.when(moved, F.col(f"w.{inner}")).otherwise(F.col(own))
    return best.select(*key, at("window_start", start).alias("new_start"), at("window_end", end).alias("new_end"), moved.alias("moved"))


def best_lag(left: DataFrame, right: DataFrame, key: list[str], i: str, value: str, max_lag: int) -> DataFrame:
    """key, lag, score: the lag of at most max_lag samples at which right, moved later by it, follows left best; the least lag on ties.

    The score is the sum of products of the centred samples, times both counts; whole numbers stay exact. Each right sample meets 2 * max_lag + 1
    left ones through an equi-join on the sample, and sums are partial before the shuffle.
    """
    centred = lambda df: df.withColumn("_c", F.col(value) * F.count("*").over(Window.partitionBy(*key)) - F.sum(value).over(Window.partitionBy(*key)))
    l = centred(left).select(*key, F.col(i).alias("_at"), F.col("_c").alias("_l"))
    r = centred(right).select(*key, F.col(i).alias("_i"), F.col("_c").alias("_r"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    met = l.join(r.withColumn("_at", F.col("_i") + F.col("lag")), [*key, "_at"])
    scores = met.groupBy(*key, "lag").agg(F.sum(F.col("_l") * F.col("_r")).alias("score"))
    return scores.groupBy(*key).agg(F.max_by(F.struct("lag", "score"), F.struct("score", -F.col("lag"))).alias("b")).select(*key, "b.lag", "b.score")


def placed_as_asked(words: DataFrame, key: list[str], order: list[str], start: str, end: str, window_start: str, window_end: str, asked: str) -> DataFrame:
    """key, ok: every asked word has a span, starts never go back, all lie in the window with some slop, and the window was long enough."""
    prev = F.coalesce(F.lag(start).over(O.over(key, order)), F.col(window_start) - 0.001)
    fine = (F.col(start) >= F.col(window_start) - ALIGN_SLOP) & (F.col(end) <= F.col(window_end) + ALIGN_SLOP) & (F.col(start) >= prev)
    judged = words.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    room = F.max(F.col(window_end) - F.col(window_start)) >= F.lit(ALIGN_BASE) + F.lit(ALIGN_PER_WORD) * F.max(asked)
    return judged.groupBy(*key).agg((F.every("_fine") & (F.count("*") == F.max(asked)) & room).alias("ok"))


def still_frames(frames: DataFrame, key: list[str], order: list[str], pixels: str, limit: float = 2.0) -> DataFrame:
    """key, difference, still: the largest mean absolute difference of a later frame from the first; fewer than two frames give nulls."""
    first = F.first(pixels).over(O.upto(key, order))
    gap = F.aggregate(F.zip_with(first, F.col(pixels), lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda acc, d: acc + d) / F.size(pixels)
    later = frames.withColumns({"_n": F.row_number().over(O.over(key, order)), "_gap": gap})
    largest = later.groupBy(*key).agg(F.max(F.when(F.col("_n") > 1, F.col("_gap"))).alias("difference"))
    return largest.withColumn("still", F.col("difference") <= limit)


def phase_report(runs: DataFrame, phase: str, seconds: str, failed: Column) -> DataFrame:
    """Runs, failures, total and mean seconds of each phase."""
    return runs.groupBy(phase).agg(F.count("*").alias("runs"), F.count_if(failed).alias("failed"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"))
