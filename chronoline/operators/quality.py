"""Quality records of placed words, the rules that read them, and small decisions of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.operators import ordered as O

#: Kinds of a word's place that rest on the recording.
ANCHORS = ("asr", "lrc", "forced")
MIN_ANCHOR_RATE = 0.5
MIN_UNANCHORED_RUN = 5
WINDOW_SLACK = 0.5


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def realign_quality(words: DataFrame, key: list[str], order: list[str], kind: str) -> DataFrame:
    """One row a song: words by kind (asr, lrc, forced, interpolated, original), share of anchored ones, longest run without an anchor.

    Nulls and other kinds count as words without an anchor.
    """
    named = {"n_asr": "asr", "n_lrc": "lrc", "n_forced": "forced", "n_interpolated": "interpolated", "n_kept": "original"}
    counts = [F.count_if(F.col(kind) == k).alias(name) for name, k in named.items()]
    marked = words.withColumn("_anchored", F.coalesce(F.col(kind).isin(*ANCHORS), F.lit(False)))
    runs = O.longest_run(marked, key, order, "_anchored").withColumnRenamed("longest", "longest_unanchored")
    got = marked.groupBy(*key).agg(F.count("*").alias("n_words"), *counts)
    return got.withColumn("anchor_rate", _rate(F.col("n_asr") + F.col("n_lrc") + F.col("n_forced"), F.col("n_words"))).join(runs, key)


def retry_reason(anchor_rate: Column, longest_unanchored: Column, min_rate: float = MIN_ANCHOR_RATE, min_run: int = MIN_UNANCHORED_RUN) -> Column:
    """Why a song should be heard again: few anchors in all ('rate'), else one long passage without any ('run'), else null."""
    return F.when(anchor_rate < min_rate, "rate").when(longest_unanchored >= min_run, "run")


def retry_is_better(old_rate: Column, old_run: Column, new_rate: Column, new_run: Column) -> Column:
    """A second hearing is kept if either signal got better."""
    return F.coalesce((new_rate > old_rate) | (new_run < old_run), F.lit(False))


def placement_quality(words: DataFrame, key: list[str], order: list[str], placed: str, start: str) -> DataFrame:
    """One row a song: words placed by what was heard, others, their share, and words that had to move behind the one before."""
    late = F.col(start) < F.max(start).over(O.before(key, order))
    got = words.withColumn("_late", F.coalesce(late, F.lit(False))).groupBy(*key).agg(
        F.count("*").alias("n_words"), F.count_if(placed).alias("n_placed"), F.count_if(~F.coalesce(F.col(placed), F.lit(False))).alias("n_fallback"), F.count_if("_late").alias("n_moved")
    )
    return got.withColumn("placement_rate", _rate(F.col("n_placed"), F.col("n_words")))


def alignment_stats(words: DataFrame, key: list[str], notes: str, syllables: str) -> DataFrame:
    """One row a song: words with and without notes, with more notes than syllables and the reverse, and notes used."""
    n, s = F.coalesce(F.col(notes), F.lit(0)), F.coalesce(F.col(syllables), F.lit(0))
    return words.groupBy(*key).agg(
        F.count("*").alias("total_words"), F.count_if(n > 0).alias("words_with_notes"), F.count_if(n == 0).alias("words_with_fallback"),
        F.count_if((n > 0) & (s < n)).alias("words_with_melisma"), F.count_if((n > 0) & (s > n)).alias("words_with_syllable_merge"), F.sum(n).alias("total_notes"),
    )


def mean_score(score: Column) -> Column:
    """Mean of the known scores, 0 if there is none."""
    return F.coalesce(F.avg(score), F.lit(0.0))


def in_window(start: Column, low: Column, high: Column, slack: float = WINDOW_SLACK) -> Column:
    return start.between(low - slack, high + slack)


def line_chunks(words: DataFrame, key: list[str], order: list[str], line: str) -> DataFrame:
    """chunk, first, stop of each run of words on one line, as half-open positions."""
    at = words.withColumn("_at", F.row_number().over(O.over(key, order)) - 1)
    changed = ~F.col(line).eqNullSafe(F.lag(line).over(O.over(key, order)))
    return O.islands(at, key, order, changed, "chunk").groupBy(*key, "chunk").agg(F.min("_at").cast("long").alias("first"), (F.max("_at") + 1).cast("long").alias("stop"))


def earliest_release(releases: DataFrame, key: list[str], ident: str, date: str, pos: str) -> DataFrame:
    """The dated release that sorts first, else the first one met; releases without an id are left out."""
    known = releases.where(F.col(ident).isNotNull() & (F.col(ident).cast("string") != ""))
    dated = F.when(F.coalesce(F.col(date).cast("string"), F.lit("")) != "", F.struct(F.col(date), F.col(pos)))
    return known.groupBy(*key).agg(F.coalesce(F.min_by(ident, dated), F.min_by(ident, pos)).alias(ident))


def without_duet(title: Column) -> Column:
    return F.replace(title, F.lit(" [DUET]"), F.lit(""))


def batch_summary(results: DataFrame, key: list[str], problem: str) -> DataFrame:
    """Songs done and failed, and the first problem by name; one failure never hides another song."""
    return results.groupBy(*key).agg(F.count_if(F.col(problem).isNull()).alias("n_ok"), F.count_if(F.col(problem).isNotNull()).alias("n_failed"), F.min(problem).alias("first_problem"))
