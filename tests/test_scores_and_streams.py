from chronoline.operators import alignment as A
from chronoline.sources import scores as X
from chronoline.streaming import sessions
from pyspark.sql import functions as F

NOTE = "<note>{}<duration>{}</duration>{}</note>"


def note(step, octave, duration, text=None, syllabic="single", alter=0, more=""):
    lyric = f"<lyric><syllabic>{syllabic}</syllabic><text>{text}</text></lyric>" if text else ""
    return f"<note>{more}<pitch><step>{step}</step><alter>{alter}</alter><octave>{octave}</octave></pitch><duration>{duration}</duration>{lyric}</note>"


def test_score_words(spark):
    sung = note("C", 4, 2, "Won", "begin") + note("D", 4, 2, "der", "end") + note("E", 4, 4) + "<note><rest/><duration>4</duration></note>" + note("F", 4, 4, "Hi!", alter=1)
    other = note("G", 3, 4, "la") + "<backup><duration>4</duration></backup>" + note("A", 3, 8)
    xml = f"<score-partwise><part-list><score-part id='P1'><part-name>Voice</part-name></score-part><score-part id='P2'><part-name>Alto</part-name></score-part></part-list><part id='P1'><measure><attributes><divisions>2</divisions></attributes>{sung}</measure></part><part id='P2'><measure>{other}</measure></part></score-partwise>"
    notes = X.read_scores(spark.createDataFrame([("s", xml), ("bad", "<x"), ("none", None)], "song_id string, text string"))
    voice = X.vocal_part(notes)
    words = X.sung_words(voice).orderBy("pos").collect()
    assert [(w["text"], w["norm"], w["offset"], [(s["midi"], s["text"]) for s in w["syllables"]]) for w in words] == [("Wonder", "wonder", 0.0, [(60, "Won"), (62, "der"), (64, "~")]), ("Hi!", "hi", 6.0, [(66, "Hi!")])]
    assert {r["part"] for r in X.vocal_part(notes, "alto").collect()} == {"Alto"}
    merged = X.merged_notes(notes, voice).orderBy("offset").collect()
    assert [(r["offset"], r["midi"]) for r in merged] == [(0.0, 60), (1.0, 62), (6.0, 66)]


def test_reconcile_lines(spark):
    ours = spark.createDataFrame([("s", i, t) for i, t in enumerate(["hello my world", "second one here", "part one", "and part two of it", "closing words now"])], "s string, line_no long, line string")
    theirs = spark.createDataFrame([("s", i, float(t), x) for i, (t, x) in enumerate([(1, "Intro talk"), (5, "Hello my world, yeah"), (9, "second one here"), (12, "part one and part two of it"), (20, "closing words now")])], "s string, line_no long, t double, line string")
    rows = A.reconcile_lines(ours, theirs, "s").orderBy("our_line").collect()
    assert [(r["our_line"], round(r["t"], 3)) for r in rows] == [(0, 5.0), (1, 9.0), (2, 12.0), (3, round(12 + 8 * 2 / 7, 3)), (4, 20.0)]
    assert A.reconcile_lines(ours, theirs.withColumn("line", F.lit("x")), "s").count() == 0


def test_gap_sessions(spark, tmp_path):
    def put(k, seconds):
        spark.createDataFrame([("a", 1_000_000 + s) for s in seconds], "track string, s long").select("track", F.timestamp_seconds("s").alias("t")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    out = tmp_path / "out"
    for k, seconds in enumerate(([0, 5, 100], [8, 104], [10_000], [20_000])):
        put(k, seconds)
        stream = spark.readStream.schema("track string, t timestamp").parquet(str(tmp_path / "in" / "*"))
        sessions.gap_sessions(stream, "track", "t", 10, "20 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((int(r["first_t"].timestamp()) - 1_000_000, int(r["last_t"].timestamp()) - 1_000_000, r["n"]) for r in spark.read.parquet(str(out)).collect())
    assert got[:3] == [(0, 5, 2), (100, 104, 2), (10_000, 10_000, 1)]  # 8 comes after the watermark


def test_repaired_lyrics(spark):
    """Dots join the word before them, every other one of several; words run together go to the notes without a text behind them."""

    def walk(notes):
        import re

        out = [dict(n) for n in notes]
        for i in range(1, len(out)):
            a, b = out[i - 1], out[i]
            if b["text"] and not re.sub("[^a-z0-9']", "", b["text"].lower()) and a["text"] and abs(b["offset"] - a["offset"] - a["qlen"]) < 1e-6:
                a["text"] += b["text"]
                b["text"] = b["syllabic"] = None
        for i in range(len(out) - 1):
            m = re.match(r"^(.+?[,.\s])([A-Za-z0-9].*)$", out[i]["text"] or "")
            if m and not out[i + 1]["text"]:
                out[i]["text"], out[i + 1]["text"] = m.groups()
                out[i + 1]["syllabic"] = "single"
        return [(n["pos"], n["text"], n["syllabic"]) for n in out]

    import random

    r = random.Random(4)
    rows, kind = [], "song_id string, part string, pos long, offset double, qlen double, midi int, text string, syllabic string, tied boolean"
    for song in range(40):
        at = 0.0
        for pos in range(25):
            at += r.choice([0, 0, 0, 0.5])
            text = r.choice(["la", "la", "know", "..", "!", "right,it's", "a,b,c d", ", x", "end.", None, None])
            rows.append((f"s{song}", "P", pos, at, 1.0, 60, text, None if text is None else r.choice(["single", "begin", "end"]), False))
            at += 1.0
    got = {}
    for x in X.repair_lyrics(spark.createDataFrame(rows, kind)).orderBy("song_id", "pos").collect():
        got.setdefault(x["song_id"], []).append((x["pos"], x["text"], x["syllabic"]))
    names = kind.replace(",", "").split()[::2]
    want = {f"s{song}": walk([dict(zip(names, x)) for x in rows if x[0] == f"s{song}"]) for song in range(40)}
    assert got == want
