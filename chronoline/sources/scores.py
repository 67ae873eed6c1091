"""Sheet music (MusicXML texts) as note rows, and its sung words.

Only the XML walk is Python, one file at a time; picking the part, merging parts and building words are DataFrame work.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.functions import scalars as S
from chronoline.operators import ordered as O

STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SCHEMA = "song_id string, part string, pos bigint, offset double, qlen double, midi int, text string, syllabic string, tied boolean"

#: Files whose notes a task holds at a time.
FILES_AT_ONCE = 64


def _notes(song_id: str, text: str | None) -> Iterator[tuple]:
    """Pitched notes of every part in document order; offsets and lengths in quarter notes. Files that are no XML have none."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return
    names = {p.get("id"): (p.findtext("part-name") or "").strip() for p in root.iter("score-part")}
    for part in root.iter("part"):
        name, pos, at, divisions, last = names.get(part.get("id")) or part.get("id") or "", 0, 0.0, 1.0, 0.0
        for measure in part.iter("measure"):
            for item in measure:
                if item.tag == "attributes":
                    divisions = float(item.findtext("divisions") or divisions)
                length = float(item.findtext("duration") or 0) / divisions
                if item.tag == "backup":
                    at -= length
                elif item.tag == "forward":
                    at += length
                elif item.tag == "note":
                    chord = item.find("chord") is not None
                    start, pitch = (last if chord else at), item.find("pitch")
                    if pitch is not None:
                        midi = 12 * (int(pitch.findtext("octave")) + 1) + STEPS[pitch.findtext("step")] + int(float(pitch.findtext("alter") or 0))
                        lyric = item.find("lyric")
                        words = None if lyric is None else "".join(t.text or "" for t in lyric.iter("text")) or None
                        tied = any(t.get("type") == "stop" for t in item.iter("tie"))
                        yield song_id, name, pos, start, length, midi, words, None if lyric is None else lyric.findtext("syllabic"), tied
                        pos += 1
                    if not chord:
                        last, at = at, at + length


def read_scores(files: DataFrame) -> DataFrame:
    """files(song_id, text) -> one row a pitched note."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for pdf in frames:
            for k in range(0, len(pdf), FILES_AT_ONCE):
                some = pdf.iloc[k : k + FILES_AT_ONCE]
                yield pd.DataFrame([n for s, t in zip(some["song_id"], some["text"]) for n in _notes(s, t)], columns=names)

    return files.select("song_id", "text").mapInPandas(run, SCHEMA)


def vocal_part(notes: DataFrame, preferred: str | None = None) -> DataFrame:
    """Notes of the preferred part where it has lyrics, else of the part with most sung notes (the first by name on ties)."""
    sung = notes.groupBy("song_id", "part").agg(F.count("text").alias("n")).where("n > 0")
    first = (F.lower("part") == (preferred or "").lower()).cast("int")
    best = sung.groupBy("song_id").agg(F.min_by("part", F.struct(-first, -F.col("n"), "part")).alias("part"))
    return notes.join(best, ["song_id", "part"], "left_semi")


def repair_lyrics(notes: DataFrame) -> DataFrame:
    """Notes of a vocal part with two engraving faults mended: punctuation on a note of its own, and words run together on one.

    A text without letters or digits joins the text of the note before it, which it touches, and leaves its note without a text; of several such notes in a row every other one joins. A text with a
    comma, full stop or space before another letter or digit gives what follows to the notes without a text behind it, a piece each, the last of them the rest.
    """
    order = ["offset", "pos"]
    w = O.over(["song_id"], order)
    touches = F.abs(F.col("offset") - F.lag(F.col("offset") + F.col("qlen")).over(w)) < 1e-6
    joins = F.col("text").isNotNull() & (S.normalize_word(F.col("text")) == "") & F.lag("text").over(w).isNotNull() & F.coalesce(touches, F.lit(False))
    marked = O.islands(notes.withColumn("_joins", joins), ["song_id"], order, F.col("_joins") != F.lag("_joins").over(w), "_run")
    within = F.row_number().over(O.over(["song_id", "_run"], order))
    marked = marked.withColumn("_gone", F.col("_joins") & (within % 2 == 1))
    tail = F.when(F.lead("_gone").over(w), F.lead("text").over(w))
    marked = marked.withColumns({"_text": F.when(~F.col("_gone"), F.concat(F.col("text"), F.coalesce(tail, F.lit("")))), "syllabic": F.when(~F.col("_gone"), F.col("syllabic"))})
    # a text and the notes without one behind it
    marked = marked.withColumn("_head", F.sum(F.col("_text").isNotNull().cast("int")).over(O.upto(["song_id"], order)))
    own = Window.partitionBy("song_id", "_head")
    pieces = F.split(F.first("_text", True).over(own), r"(?<=.[,.\s])(?=[A-Za-z0-9])")
    marked = marked.withColumns({"_pieces": pieces, "_at": F.row_number().over(own.orderBy(*order)), "_of": F.count("*").over(own)})
    rest = F.array_join(F.slice("_pieces", F.col("_at"), F.greatest(F.lit(1), F.size("_pieces"))), "")
    piece = F.when(F.col("_head") == 0, F.col("_text")).when(F.col("_at") <= F.size("_pieces"), F.when(F.col("_at") == F.col("_of"), rest).otherwise(F.get("_pieces", F.col("_at") - 1)))
    given = (F.col("_at") > 1) & piece.isNotNull()
    return marked.withColumns({"text": piece, "syllabic": F.when(given, "single").otherwise(F.col("syllabic"))}).select(*notes.columns)


def sung_words(notes: DataFrame) -> DataFrame:
    """song_id, pos, text, norm, offset, syllables of a vocal part: a word begins at syllabic single, begin or none; untexted notes that touch the one before extend its word."""
    w = O.over(["song_id"], ["offset", "pos"])
    starts = F.col("text").isNotNull() & (F.col("syllabic").isNull() | F.col("syllabic").isin("single", "begin"))
    touches = F.abs(F.col("offset") - F.lag(F.col("offset") + F.col("qlen")).over(w)) < 1e-6
    kept = notes.withColumn("_touch", F.coalesce(touches, F.lit(False))).where(F.col("text").isNotNull() | F.col("_touch") | F.col("tied"))
    words = kept.withColumn("word_id", F.sum(starts.cast("int")).over(O.upto(["song_id"], ["offset", "pos"]))).where("word_id > 0")
    syllable = F.struct("offset", "pos", "qlen", "midi", F.coalesce("text", F.lit("~")).alias("text"))
    packed = words.groupBy("song_id", "word_id").agg(F.sort_array(F.collect_list(syllable)).alias("syllables"))
    text = F.array_join(F.transform(F.filter("syllables", lambda s: s["text"] != "~"), lambda s: s["text"]), "")
    return packed.select("song_id", (F.col("word_id") - 1).alias("pos"), text.alias("text"), S.normalize_word(text).alias("norm"), F.get("syllables", F.lit(0))["offset"].alias("offset"), F.transform("syllables", lambda s: F.struct(s["offset"].alias("off"), s["qlen"].alias("qlen"), s["midi"].alias("midi"), s["text"].alias("text"))).alias("syllables"))


def merged_notes(notes: DataFrame, primary: DataFrame) -> DataFrame:
    """song_id, offset, midi, norm of all parts with lyrics, one row an offset; the primary part wins, then the first part by name."""
    sung = notes.where("text is not null").join(primary.select("song_id", F.col("part").alias("_first")).distinct(), "song_id", "left")
    rank = F.row_number().over(Window.partitionBy("song_id", "offset").orderBy((F.col("part") == F.col("_first")).desc_nulls_last(), "part", "pos"))
    return sung.withColumn("_r", rank).where("_r = 1").select("song_id", "offset", "midi", S.normalize_word(F.col("text")).alias("norm"))
