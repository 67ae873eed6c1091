"""Choices between answers: lyrics for a score, an aligner for a song, results of several tries, and what a verification finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import calibration as K
from chronoline.sources import charts as C
from chronoline.sources.listings import loudness_plausible

#: How far durations may differ, and the least likeness of the words.
MOST_SECONDS, LEAST_RATIO = 15.0, 0.3
CORRECTED_CONFIDENCE = 0.75
DURATION_TOLERANCE, LOUDNESS_TOLERANCE, PEAK_TOLERANCE = 0.05, 1.0, 0.5
TARGET_LUFS, TARGET_PEAK = -14.0, -1.0


def words_of(text: Column) -> Column:
    """Normalized words of a text, empty ones left out."""
    return F.filter(F.transform(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")), r"\s+"), S.normalize_word), lambda w: w != "")


def judged_lyrics(candidates: DataFrame, songs: DataFrame, key: str) -> DataFrame:
    """candidates with timed (has a timed line), seconds (effective duration), gap (from the song's), same_artist, ratio (of the song's words and the plain lyrics) and refused (why one is not chosen unless forced, null if it may be).

    candidates(key, pos, track_name, artist_name, duration, instrumental, plain_lyrics, synced_lyrics), songs(key, artist, seconds, words).
    Of candidates with one track, artist and duration the first by pos counts, the others are repeats.
    """
    row = candidates.withColumn("_id", F.concat_ws("|", F.col(key).cast("string"), F.col("pos").cast("string")))
    last = C.parse_timed_lines(row.select("_id", "synced_lyrics"), "_id", "synced_lyrics").groupBy("_id").agg(F.max("t").alias("_last"))
    met = row.join(last, "_id", "left").join(songs.select(key, F.col("artist").alias("_artist"), F.col("seconds").alias("_seconds"), F.col("words").alias("_words")), key)
    seconds = S.effective_duration(F.col("duration"), F.col("synced_lyrics"), F.col("_last"))
    met = met.withColumns({"timed": F.col("_last").isNotNull(), "seconds": seconds, "gap": F.abs(seconds - F.col("_seconds")), "same_artist": S.artist_matches(F.col("_artist"), F.col("artist_name")), "_theirs": words_of(F.col("plain_lyrics"))})
    same = Window.partitionBy(key, "track_name", "artist_name", "duration").orderBy("pos")
    early = (
        F.when(F.row_number().over(same) > 1, "repeat").when(F.coalesce("instrumental", F.lit(False)), "instrumental").when(F.coalesce("synced_lyrics", F.lit("")) == "", "not synced")
        .when(F.col("duration").isNull(), "no duration").when(F.col("gap") > MOST_SECONDS, "duration").when(F.size("_theirs") == 0, "no words")
    )
    met = met.withColumn("refused", early)
    ratio = A.sequence_ratio(F.col("_words"), F.col("_theirs"))
    met = met.withColumn("ratio", ratio)
    return met.withColumn("refused", F.coalesce("refused", F.when(F.col("ratio") < LEAST_RATIO, "words"))).drop("_id", "_last", "_artist", "_seconds", "_words", "_theirs")


def choose_lyrics(candidates: DataFrame, songs: DataFrame, key: str, forced: str | None = None) -> DataFrame:
    """key, pos, ratio, gap, forced: the lyric to time a song by; songs without one have no row.

    A forced candidate (a true boolean column of candidates) is taken as it is, if it has a timed line; else the candidates that pass all gates rank by artist, then duration, then words, and the first of them
    is taken if it has a timed line.
    """
    judged = judged_lyrics(candidates, songs, key).withColumn("forced", F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False))
    any_forced = F.max("forced").over(Window.partitionBy(key))
    may = judged.withColumn("_any", any_forced).where(F.when(F.col("_any"), F.col("forced")).otherwise(F.col("refused").isNull()))
    order = [F.col("same_artist").desc(), F.col("gap").asc_nulls_last(), F.desc("ratio"), F.col("pos")]
    best = may.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1 and timed")
    return best.select(key, "pos", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), "gap", "forced")


def first_success(tries: DataFrame, key: str, order: str, success: str) -> DataFrame:
    """One try a key: the first that succeeded, else the last."""
    good = F.coalesce(F.col(success), F.lit(False))
    rank = F.when(good, F.struct(F.lit(0).alias("bad"), F.col(order).alias("at"))).otherwise(F.struct(F.lit(1).alias("bad"), (-F.col(order)).alias("at")))
    return tries.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where("_r = 1").drop("_r")


def align_by_trust(words: DataFrame, tokens: DataFrame, lines: DataFrame, tracking: DataFrame, key: str) -> DataFrame:
    """words with new_text, reference_text, line_no, dropped and by: along the timed lines where tracking(key, tracks) trusts them, else against the whole reference.

    words(key, pos, text, start, end), tokens(key, pos, norm, original, line_no[, parts]), lines(key, line_no, line). Songs that tracking does not name, or that have no timed line, are aligned as a whole.
    """
    trusted = tracking.where("tracks").select(key).join(lines.select(key).distinct(), key, "left_semi")
    walked = A.assign_lines(words.join(trusted, key, "left_semi"), lines.join(trusted, key, "left_semi"), key)
    matched = A.align_to_reference(words.join(trusted, key, "left_anti"), tokens.join(trusted, key, "left_anti"), key)
    told = lambda df, how: df.where(F.col(key).isNotNull() & F.col("pos").isNotNull()).withColumn("by", F.lit(how))
    return told(walked, "lines").unionByName(told(matched, "reference"))


def calibrate_score_pitches(syllables: DataFrame, key: str, order: list[str], pitch: str, confidence: str, predicted: str, least: float = CORRECTED_CONFIDENCE, **limits) -> DataFrame:
    """Adds new_pitch, new_confidence and offset: a score's pitches by the class offset between them and predicted classes (0 to 11, null for none), found once a song; octave and time stay.

    The offset and its limits are those of calibration.class_offset. A pitch that moves has at least the given confidence; without an offset nothing moves.
    """
    ours, theirs = F.col(predicted).cast("long") - 60, F.col(pitch) + 60
    known = syllables.where(F.col(predicted).isNotNull()).select(key, *order, ours.alias("_ours"), theirs.alias("_theirs"), F.col(confidence).alias("_c"))
    offsets = K.class_offset(known, [key], order, "_ours", "_theirs", "_c", **limits).select(key, "offset")
    met = syllables.join(offsets, key, "left")
    moved = S.nearest_pitch_of_class(F.col(pitch), F.pmod(F.col(pitch) + 60 - F.col("offset"), F.lit(12)))
    new = F.coalesce(moved, F.col(pitch))
    return met.withColumns({"new_pitch": new, "new_confidence": F.when(new != F.col(pitch), F.greatest(F.col(confidence), F.lit(least))).otherwise(F.col(confidence))})


def verification_issues(backups: DataFrame, current: DataFrame, target_lufs: float = TARGET_LUFS, target_peak: float = TARGET_PEAK) -> DataFrame:
    """path_key, verdict (ok, issue, missing), issues: every backed-up file against the current one.

    Both sides have path_key, sample_rate, channels and duration (decoded seconds); current also lufs and true_peak. A file whose durations or loudness are not known or not plausible could not be measured.
    """
    b = backups.select("path_key", *[F.col(c).alias(f"_{c}") for c in ("sample_rate", "channels", "duration")])
    met = b.join(current.withColumn("_here", F.lit(True)), "path_key", "left")
    both = lambda c: (F.col(c) != 0) & (F.col(f"_{c}") != 0) & (F.col(c) != F.col(f"_{c}"))
    drift = F.abs(F.col("_duration") - F.col("duration"))
    timed, loud = drift.isNotNull(), loudness_plausible(F.col("lufs"), F.col("true_peak"))
    found = F.array(
        F.when(both("sample_rate"), "sample rate changed"), F.when(both("channels"), "channel count changed"), F.when(drift > DURATION_TOLERANCE, "decoded duration differs"),
        F.when(timed & loud & (F.abs(F.col("lufs") - target_lufs) > LOUDNESS_TOLERANCE), "loudness off target"), F.when(timed & loud & (F.col("true_peak") > target_peak + PEAK_TOLERANCE), "true peak exceeds ceiling"),
        F.when(~(timed & loud), "could not be measured"),
    )
    issues = F.when(F.col("_here"), F.array_compact(found))
    verdict = F.when(issues.isNull(), "missing").when(F.size(issues) > 0, "issue").otherwise("ok")
    return met.select("path_key", verdict.alias("verdict"), F.coalesce(issues, F.array().cast("array<string>")).alias("issues"))
