"""Whole-song pipelines over input tables: generate a chart, re-time one, refresh its pitches. All songs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.functions.syllables import syllables
from chronoline.operators import calibration as K
from chronoline.operators import estimators as E
from chronoline.operators import ordered as O
from chronoline.operators import phrasing as P
from chronoline.operators import ranges as R
from chronoline.session import checkpoint

KEY = ["song_id"]


def notes_of_words(words: DataFrame, notes: DataFrame) -> DataFrame:
    """words that are not dropped, with notes (null for none), parts (their syllables) and n_words of their group.

    Words form groups by the gaps between them and whole notes go to groups; only inside a group of several words are notes cut at the words'
    boundaries. words(song_id, pos, text, start, end, line_id, dropped), notes(song_id, pos, start, end, pitch, confidence, protected); dropped words, if
    there is such a column, hold their notes all the same.
    """
    spans = O.gap_groups(words, KEY, ["pos"], "start", "end", O.LINE_GAP, "grp").withColumn("word_id", F.concat_ws("|", "song_id", "pos"))
    ends = F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.count("*").alias("n_words")
    groups = spans.groupBy("song_id", "grp").agg(*ends)
    named = notes.withColumn("note_id", F.concat_ws("|", "song_id", "pos"))
    zoned = R.assign_zones(named, R.zone_boundaries(groups, KEY, ["grp"], "start", "end"), KEY, ["pos"], "start", "end", "note_id").withColumnRenamed("zone", "grp")
    zoned = zoned.join(groups.select("song_id", "grp", "n_words"), ["song_id", "grp"])
    own = ["song_id", "grp"]
    pieces = R.split_by_boundaries(zoned, R.zone_boundaries(spans, own, ["pos"], "start", "end"), own, "start", "end", "note_id")
    whole = (F.col("protected") & F.col("first_piece")) | (F.col("n_words") == 1)
    pieces = pieces.select(*own, F.col("zone").alias("pos"), "piece_start", "piece_end", "pitch", "confidence", whole.alias("protected"))
    pieces = O.drop_leading_slivers(pieces, [*own, "pos"], ["piece_start", "piece_end"], "piece_start", "piece_end", "protected")
    held = pieces.groupBy(*own, "pos").agg(F.sort_array(F.collect_list(F.struct("piece_start", "piece_end", "pitch", "confidence"))).alias("notes"))
    if "dropped" in words.columns:
        spans = spans.withColumn("_gone", F.coalesce("dropped", F.lit(False)))
    else:
        spans = spans.withColumn("_gone", F.lit(False))
    numbered = spans.withColumn("_at", (F.row_number().over(O.over(own, ["pos"])) - 1).cast("long"))
    joined = numbered.where("not _gone").join(held.withColumnRenamed("pos", "_at"), [*own, "_at"], "left")
    return joined.join(groups.select(*own, "n_words"), own).withColumn("parts", syllables("text"))


def generation_counts(held: DataFrame) -> DataFrame:
    """song_id and counts over notes_of_words: words, with and without notes, with more notes than syllables and the reverse, notes, words in cut groups."""
    n, parts, has = F.coalesce(F.size("notes"), F.lit(0)), F.size("parts"), F.col("notes").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    return held.groupBy("song_id").agg(
        F.count("*").alias("words"), count(has).alias("with_notes"), count(~has).alias("without_notes"), count(has & (parts < n)).alias("melismas"),
        count(has & (parts > n)).alias("merged"), F.sum(F.when(has, n).otherwise(0)).alias("notes"), count(F.col("n_words") > 1).alias("in_cut_groups"),
    )


def generate_entries(words: DataFrame, notes: DataFrame) -> DataFrame:
    """words and notes as of notes_of_words -> chart entries.

    Words without notes take the nearest note's pitch; syllables are merged or padded with ~ to a word's notes.
    """
    joined = checkpoint(notes_of_words(words, notes))
    lone = R.nearest_note(joined.where("notes is null").drop("notes"), notes, KEY, "start", "end", "pos", ["pitch", "confidence"], "word_id")
    n = F.size("notes")
    texts = F.when(F.size("parts") > n, S.chunks_of(F.col("parts"), n)).otherwise(F.concat("parts", F.array_repeat(F.lit("~"), n - F.size("parts"))))
    full = joined.where("notes is not null").withColumn("texts", texts)
    rows = full.select("song_id", "pos", "line_id", F.posexplode(F.arrays_zip("texts", "notes")).alias("k", "z")).select(
        "song_id", "pos", "k", "line_id", F.col("z.texts").alias("text"), F.col("z.notes.piece_start").alias("start"), F.col("z.notes.piece_end").alias("end"), F.col("z.notes.pitch").cast("long").alias("pitch"), (F.col("k") == 0).alias("is_word_start")
    )
    extra = lone.select("song_id", "pos", F.lit(0).alias("k"), "line_id", "text", "start", F.greatest("end", F.col("start") + 0.06).alias("end"), F.col("near_pitch").cast("long").alias("pitch"), F.lit(True).alias("is_word_start"))
    rows = checkpoint(rows.unionByName(extra))
    timed = O.enforce_monotonic(rows, KEY, ["pos", "k"], "start", "end")
    rows = rows.drop("start", "end").join(timed.withColumnsRenamed({"new_start": "start", "new_end": "end"}), ["song_id", "pos", "k"])
    rows = rows.withColumn("note_type", S.note_type(F.col("end") - F.col("start")))
    return P.with_breaks(P.free_breaks(rows, KEY, ["pos", "k"]), KEY, ["pos", "k"])


def refresh_pitches(notes: DataFrame, frames: DataFrame, frame_seconds: float, bucket: float = 5.0) -> DataFrame:
    """notes(song_id, pos, start, end, pitch) and frames(song_id, t, midi, conf, voiced) -> notes with new_pitch in the old octave.

    Each note's frames vote for a class, gaps fill forward, and classes foreign to the song's key move a step.
    """
    keyed = notes.withColumn("note_id", F.concat_ws("|", "song_id", "pos"))
    own = ["song_id", "note_id"]
    inside = R.frames_in_notes(keyed.select("song_id", "note_id", "start", "end"), frames, KEY, "start", "end", "t", "note_id", bucket)
    inside = inside.where(F.col("voiced") & F.col("midi").isNotNull() & ~F.isnan("midi"))
    settled = E.confidence_floor(E.trim_attack(inside, own, ["t"], round(0.04 / frame_seconds)), own, "conf", 0.5)
    votes = E.weighted_mode(settled, own, ["t"], F.col("midi"), F.col("conf"), "midi_mode").select("note_id", F.pmod("midi_mode", F.lit(12)).cast("long").alias("pc"))
    filled = keyed.join(votes, "note_id", "left").withColumn("pc", O.fill_forward("pc", KEY, ["pos"]))
    known = filled.where("pc is not null")
    nudged = K.nudge(known, K.likely_key(known, KEY, "pc"), KEY, "pc")
    octave = F.floor(F.col("pitch") / 12) * 12
    out = nudged.select("song_id", "pos", "start", "end", "pitch", (octave + F.col("nudged")).cast("long").alias("new_pitch"))
    return out.unionByName(filled.where("pc is null").select("song_id", "pos", "start", "end", "pitch", F.col("pitch").cast("long").alias("new_pitch")))
