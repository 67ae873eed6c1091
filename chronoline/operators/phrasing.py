"""Line breaks of a chart. Strict mode is a window; else the length of the open line is state, and songs stream through their tasks in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.operators import ordered as O
from chronoline.operators.walks import dealt, plain

SYLLABLES, HARD = 8, 12
GAP, SOFT_GAP = 0.35, 0.15


def strict_breaks(syllables: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds break_before: a word start whose line differs from the last known line of a word start."""
    starts = F.when(F.col("is_word_start"), F.col("line_id"))
    last = F.last(starts, True).over(O.before(key, order))
    return syllables.withColumn("break_before", F.coalesce(F.col("is_word_start") & (F.col("line_id") != last), F.lit(False)))


def overflow_breaks(syllables: DataFrame, key: list[str], order: list[str], least: int = HARD) -> DataFrame:
    """key and order of at most one break in each run of one line with ``least`` syllables or more: the inner word start behind a comma or point nearest to the middle."""
    w = O.over(key, order)
    changed = ~F.coalesce(F.col("line_id").eqNullSafe(F.lag("line_id").over(w)), F.lit(False))
    runs = O.islands(syllables, key, order, changed, "_run").where("line_id is not null")
    run = [*key, "_run"]
    from pyspark.sql import Window

    inside = Window.partitionBy(*run)
    runs = runs.withColumns({"_i": F.row_number().over(O.over(run, order)) - 1, "_n": F.count("*").over(inside), "_w": F.sum(F.col("is_word_start").cast("int")).over(O.upto(run, order)), "_ws": F.sum(F.col("is_word_start").cast("int")).over(inside), "_before": F.rtrim(F.lag("text").over(O.over(run, order)))})
    inner = F.col("is_word_start") & (F.col("_w") > 1) & (F.col("_w") < F.col("_ws")) & (F.col("_ws") >= 3) & F.col("_before").rlike("[,.]$")
    ranked = runs.where((F.col("_n") >= least) & inner)
    rank = F.row_number().over(Window.partitionBy(*run).orderBy(F.abs(F.col("_i") - F.col("_n") / 2), "_i"))
    return ranked.withColumn("_r", rank).where("_r = 1").select(*key, *order)


def free_breaks(syllables: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds break_before: by known lines, gaps, and the syllables of the open line."""
    extra = overflow_breaks(syllables, key, order).withColumn("_extra", F.lit(True))
    marked = syllables.join(extra, [*key, *order], "left").withColumn("_extra", F.coalesce("_extra", F.lit(False)))

    kept = [c for c in marked.columns if c != "_extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Songs stream through a task in order; what is open goes on from batch to batch."""
        song: tuple | None = None
        length, line, last_end = 0, None, None
        for batch in batches:
            times = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist() for c in ("start", "end")]  # nulls are NaN
            keys = zip(*(plain(batch.column(c)) for c in key))
            out = []
            for k, start, end, opens, own, forced in zip(keys, *times, *(plain(batch.column(c)) for c in ("is_word_start", "line_id", "_extra"))):
                if k != song:
                    song, length, line, last_end = k, 0, None, None
                own = None if own != own else own
                cut = False
                if opens and last_end is not None:
                    gap, known = start - last_end, line is not None and own is not None
                    if known and own == line:
                        cut = forced
                    else:
                        cut = (known and own != line) or gap >= GAP or (not known and (length >= HARD or (length >= SYLLABLES and gap >= SOFT_GAP)))
                out.append(bool(cut))
                length = 1 if cut else length + 1
                line = own if opens and own is not None else line
                last_end = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.bool_())], names=[*kept, "break_before"])

    schema = ", ".join(f"{c} {marked.schema[c].dataType.simpleString()}" for c in kept) + ", break_before boolean"
    return dealt(marked.select(*kept, "_extra"), key, [F.asc_nulls_last(c) for c in order]).mapInArrow(run, schema)


def with_breaks(syllables: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Entries: each syllable, and before those with break_before a break from the end of the syllable before to the start."""
    w = O.over(key, order)
    timed = syllables.withColumns({"_from": F.lag("end").over(w), "kind": F.lit("syl")})
    breaks = timed.where("break_before").withColumns({"kind": F.lit("break"), "end": F.col("start"), "start": F.col("_from"), "text": F.lit(None).cast("string"), "is_word_start": F.lit(None).cast("boolean")})
    both = timed.withColumn("_o", F.lit(1)).unionByName(breaks.withColumn("_o", F.lit(0)))
    return both.withColumn("entry", F.row_number().over(O.over(key, [*order, "_o"])) - 1).drop("_from", "_o", "break_before")
