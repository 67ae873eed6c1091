"""Pitch correction of charts by sheet music: classes are calibrated a song, pitches stay in the octave that was detected.

Texts are matched by one whole-sequence alignment; without enough matches, or agreement, a song stays as it is.
Repeated texts match in order, texts that are null or all marks never do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import calibration as K
from chronoline.operators import ordered as O
from chronoline.session import checkpoint

CONFIRMED = 0.75
KEY = ["song_id"]


def _corrected(pitch: Column, midi: Column) -> Column:
    return S.nearest_pitch_of_class(pitch, F.pmod(midi - F.col("offset"), F.lit(12))).cast("long")


def _confirmed(new_pitch: Column, pitch: Column, confidence: Column) -> Column:
    return F.when(new_pitch != pitch, F.greatest(confidence, F.lit(CONFIRMED))).otherwise(confidence)


def correct_syllables(syllables: DataFrame, notes: DataFrame, force: bool = True) -> DataFrame:
    """syllables(song_id, pos, text, pitch, confidence, ...) with the pitch classes of notes(song_id, offset, midi, norm), sung notes of a score.

    Every matched syllable of a calibrated song takes the nearest pitch of the score's class; a changed one counts as confirmed.
    """
    ours = syllables.withColumn("norm", S.normalize_word(F.col("text"))).where("norm <> ''")
    theirs = notes.where("norm <> ''").withColumn("pos", F.row_number().over(O.over(KEY, ["offset"])).cast("long"))
    matched = A.match_words(ours, theirs, KEY, "norm", "norm").join(theirs.select("song_id", F.col("pos").alias("right_pos"), "midi"), ["song_id", "right_pos"])
    matched = matched.select("song_id", F.col("left_pos").alias("pos"), "midi")
    pairs = checkpoint(matched.join(syllables.select("song_id", "pos", "pitch", "confidence"), ["song_id", "pos"]))
    offsets = K.class_offset(pairs, KEY, ["pos"], "pitch", "midi", "confidence", force=force).where("offset is not null").select("song_id", "offset")
    classes = pairs.join(offsets, KEY).select("song_id", "pos", _corrected(F.col("pitch"), F.col("midi")).alias("_new"))
    out = syllables.join(classes, ["song_id", "pos"], "left")
    new = F.coalesce("_new", "pitch")
    return out.withColumns({"confidence": _confirmed(new, F.col("pitch"), F.col("confidence")), "pitch": new.cast("long")}).drop("_new")


def correct_words(entries: DataFrame, words: DataFrame, force: bool = True) -> DataFrame:
    """entries(song_id, pos, text, start, end, pitch, confidence, is_word_start) by the words of a score (sources.scores.sung_words).

    A word of one note that the score sings on several is split by their lengths, the later ones as ~; other words keep their notes, each takes the
    class of the score's note at its share of the word. Returns the same columns with k, the place of a piece in the note it was.
    """
    numbered = O.word_ids(entries, KEY, ["pos"], "is_word_start", "word_id")
    note = F.struct("pos", "pitch", "confidence", "text")
    ours = numbered.groupBy("song_id", "word_id").agg(F.sort_array(F.collect_list(note)).alias("ours"))
    text = F.array_join(F.transform("ours", lambda n: F.when(n["text"] == "~", "").otherwise(F.coalesce(n["text"], F.lit("")))), "")
    ours = ours.withColumns({"norm": S.normalize_word(text), "pos": F.col("word_id")})
    theirs = words.where("norm <> ''").select("song_id", "pos", "norm", F.col("syllables").alias("theirs"))
    met = A.match_words(ours.where("norm <> ''"), theirs, KEY, "norm", "norm")
    met = met.join(ours.select("song_id", F.col("pos").alias("left_pos"), "ours", "word_id"), ["song_id", "left_pos"])
    met = checkpoint(met.join(theirs.select("song_id", F.col("pos").alias("right_pos"), "theirs"), ["song_id", "right_pos"]))
    zipped = met.select("song_id", F.explode(F.arrays_zip("ours", "theirs")).alias("z")).where("z.ours is not null and z.theirs is not null")
    samples = zipped.select("song_id", "z.ours.pos", "z.ours.pitch", "z.ours.confidence", F.col("z.theirs.midi").alias("midi"))
    offsets = K.class_offset(samples, KEY, ["pos"], "pitch", "midi", "confidence", force=force).where("offset is not null").select("song_id", "offset")
    usable = met.join(offsets, KEY).select("song_id", "word_id", "offset", "theirs", F.size("ours").alias("n"), F.size("theirs").alias("m"))
    k = (F.row_number().over(O.over(["song_id", "word_id"], ["pos"])) - 1).cast("int")
    rows = numbered.withColumn("_i", k).join(usable, ["song_id", "word_id"], "left")
    splits = (F.col("n") == 1) & (F.col("m") > 1)
    share = F.bround(F.col("_i") * (F.col("m") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
    at = F.when(F.col("m") == F.col("n"), F.col("_i")).otherwise(F.least(share, F.col("m") - 1))
    pieces = F.when(splits, F.col("theirs")).when(F.col("m").isNotNull(), F.array(F.get("theirs", at)))
    rows = rows.withColumn("_pieces", pieces).select("*", F.posexplode_outer("_pieces").alias("k", "_piece")).withColumn("k", F.coalesce("k", F.lit(0)))
    quarters = lambda upto: F.aggregate(F.slice("_pieces", 1, upto), F.lit(0.0), lambda s, x: s + x["qlen"])
    total = quarters(F.size("_pieces"))
    edge = lambda upto: F.col("start") + quarters(upto) / F.when(total == 0, 1.0).otherwise(total) * (F.col("end") - F.col("start"))
    several = F.coalesce(splits, F.lit(False))
    first, last = F.col("k") == 0, F.col("k") == F.col("m") - 1
    new = F.coalesce(_corrected(F.col("pitch"), F.col("_piece")["midi"]), F.col("pitch"))
    rows = rows.withColumns(
        {
            "_start": F.when(several & ~first, edge(F.col("k"))).otherwise(F.col("start")), "_end": F.when(several & ~last, edge(F.col("k") + 1)).otherwise(F.col("end")),
            "text": F.when(first, F.col("text")).otherwise("~"), "is_word_start": first & F.col("is_word_start"),
            "confidence": F.when(several, F.greatest("confidence", F.lit(CONFIRMED))).otherwise(_confirmed(new, F.col("pitch"), F.col("confidence"))), "pitch": new.cast("long"),
        }
    )
    return rows.withColumns({"start": F.col("_start"), "end": F.col("_end")}).select(*entries.columns, "k")


def each_score(charts: DataFrame, scores: DataFrame, correct: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """charts corrected by scores(song_id, score_no, ...) one after the other in the order of score_no, which counts a song's scores from 0."""
    most = scores.agg(F.max("score_no")).first()[0]
    for number in range(0 if most is None else most + 1):
        charts = checkpoint(correct(charts, scores.where(F.col("score_no") == number).drop("score_no")))
        if "k" in charts.columns:
            charts = charts.withColumn("pos", F.row_number().over(O.over(KEY, ["pos", "k"])).cast("long") - 1).drop("k")
    return charts
