import math
import random

import pytest
from chronoline.functions import scalars as S
from chronoline.operators import notes as N
from chronoline.operators import ordered as O
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_beat_math(spark):
    r = one(spark, ms=S.beat_ms(F.lit(300.0)), n=S.seconds_to_beats(F.lit(0.427), F.lit(300.0)), least=S.seconds_to_beats(F.lit(0.001), F.lit(300.0)), beat=S.seconds_to_beat(F.lit(23.0), F.lit(23000), F.lit(300.0)))
    assert r == {"ms": 50.0, "n": 8, "least": 1, "beat": 0}
    for t, gap, bpm in ((1.234, 500, 300.0), (77.7, -120, 90.5), (0.0, 0, 200.0)):
        back = one(spark, t=S.beat_to_seconds(S.seconds_to_beat(F.lit(t), F.lit(gap), F.lit(bpm)), F.lit(gap), F.lit(bpm)))["t"]
        assert abs(back - t) <= 60 / (bpm * 4)


def test_text_functions(spark):
    r = one(
        spark, norm=S.normalize_word(F.lit("Don’t, É!")), edges=S.normalize_edges(F.lit(' "Hi, you!" ')), line=S.normalize_line(F.lit("  Oh - the Café  NOW! ")), head=S.headline_case(F.lit("beauty AND the beast of KPop (in")),
        file=S.safe_file_name(F.lit("a/b:c? .. ")), clock=S.parse_clock(F.lit("3:05.5")), bad=S.parse_clock(F.lit("x:1")), tempo=S.format_tempo(F.lit(120.50)), whole=S.format_tempo(F.lit(120.0)), crc=S.crc_text(F.lit("abc").cast("binary")),
        chunks=S.chunks_of(F.array(*map(F.lit, "abcde")), F.lit(2)), name=S.pitch_name(F.lit(-4)), near=S.nearest_pitch_of_class(F.lit(1), F.lit(8)), down=S.nearest_pitch_of_class(F.lit(1), F.lit(11)), fold=S.fold_tempo(F.lit(400.0)), zero=S.fold_tempo(F.lit(0.0)),
    )
    assert (r["norm"], r["edges"], r["line"]) == ("don't", "hi, you", "oh the caf now")
    assert r["head"] == "Beauty AND the Beast of KPop (In" and r["file"] == "abc"
    assert (r["clock"], r["bad"], r["tempo"], r["whole"], r["crc"]) == (185.5, None, "120.5", "120", "352441c2")
    assert (r["chunks"], r["name"], r["near"], r["down"], r["fold"], r["zero"]) == (["abc", "de"], "G#3", -4, -1, 200.0, None)


def test_enforce_monotonic_fixture(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 0.5, 1.5), ("s", 2, 1.2, 1.3), ("s", 3, 5.0, 4.9)], "song_id string, pos int, start double, end double")
    rows = O.enforce_monotonic(df, ["song_id"], ["pos"], "start", "end").orderBy("pos").collect()
    assert [(round(r["new_start"], 2), round(r["new_end"], 2)) for r in rows] == [(0, 1), (1.01, 1.5), (1.51, 1.57), (5.0, 5.06)]


def test_quantize_equals_the_loop(spark):
    r = random.Random(1)
    rows = [(s, i, r.choice(["syl", "syl", "break"]), r.randint(0, 60), r.randint(0, 9), r.choice([None, r.randint(0, 60)])) for s in range(20) for i in range(r.randint(1, 15))]
    df = spark.createDataFrame(rows, "song_id int, pos int, kind string, beat long, len long, end_beat long")
    got = {(x["song_id"], x["pos"]): (x["start_beat"], x["out_len"], x["out_end"]) for x in O.quantize_entries(df, ["song_id"], ["pos"]).collect()}
    for s in range(20):
        taken = None
        for song, pos, kind, beat, length, end in (x for x in rows if x[0] == s):
            start = beat if taken is None else max(beat, taken)
            if kind == "syl":
                taken = start + max(1, length)
                assert got[song, pos] == (start, max(1, length), None)
            else:
                assert got[song, pos] == (start, None, None if end is None else max(end, start))


def notes(*rows):
    return [N.Note(*r) for r in rows]


def test_note_clean_ups():
    step = notes((0, 0.2, -6, 1.0), (0.2, 0.4, -7, 1.0), (0.4, 0.6, -8, 1.0), (0.6, 0.8, -9, 1.0))
    assert len(N.merge_similar(step)) > 1
    assert len(N.merge_similar(notes((0, 0.2, -4, 1.0), (0.2, 0.4, -5, 1.0), (0.4, 0.6, -4, 1.0), (0.6, 0.8, -5, 1.0)))) == 1
    assert [n.pitch for n in N.drop_spikes(notes((0, 1, 0, 0.9, True), (1, 1.1, 9, 0.9), (1.1, 2, 1, 0.9)))] == [0, 1]
    assert len(N.merge_short(notes((0, 1, 0, 0.9), (1, 1.03, 5, 0.9), (1.03, 2, 6, 0.9)))) == 2
    assert len(N.absorb_tails(notes((0, 1, 0, 0.9), (1.0, 1.1, 5, 0.3)))) == 1
    assert [n.start for n in N.part_overlaps(notes((0, 1, 0, 0.9), (0.5, 0.8, 5, 0.3)))] == [0, 1]


def test_vibrato_is_one_note(spark):
    rows = [("a", i * 256 / 22050, 56 + 0.6 * math.sin(2 * math.pi * 6.5 * i * 256 / 22050), 0.9, True, False, False) for i in range(int(1.4 * 22050 / 256))]
    df = spark.createDataFrame(rows, "track string, t double, midi double, conf double, voiced boolean, onset boolean, strong_onset boolean")
    found = N.detect_notes(df, ["track"], 256 / 22050).collect()
    assert len(found) == 1 and found[0]["pitch"] == -4 and found[0]["end"] - found[0]["start"] > 0.8 * 1.4
    silent = N.detect_notes(df.withColumn("voiced", F.lit(False)), ["track"], 256 / 22050)
    assert silent.count() == 0


def test_isotonic_fixture(spark):
    rows = [("s", float(x), float(y)) for x, y in ((0, 5), (10, 15), (20, 25), (30, 15), (40, 45), (50, 55))]
    df = spark.createDataFrame(rows, "song string, x double, y double")
    assert (25.0, 20.0) in [(r["x"], r["y"]) for r in N.isotonic_anchors(df, ["song"], "x", "y").collect()]
    assert [r["x"] for r in O.monotone_anchors(df, ["song"], ["x"], "y").orderBy("x").collect()] == [0, 10, 20, 40, 50]


def test_padded_median_repeats_edges(spark):
    df = spark.createDataFrame([("s", i, v, True) for i, v in enumerate([9.0, 1.0, 2.0, 8.0])] + [("s", 4, None, False), ("s", 5, 7.0, True)], "song string, pos int, v double, voiced boolean")
    out = [r["smooth"] for r in O.padded_median(df, ["song"], ["pos"], "v", "voiced", 3).orderBy("pos").collect()]
    assert out == [9.0, 2.0, 2.0, 8.0, None, 7.0]
    assert out[0] == pytest.approx(9.0)
