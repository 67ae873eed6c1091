from difflib import SequenceMatcher

from chronoline.functions import scalars as S
from chronoline.operators import alignment as A
from chronoline.operators import estimators as E
from chronoline.sources import charts as C
from chronoline.sources import listings as L
from pyspark.sql import functions as F


def test_chart_round_trip(spark):
    songs = spark.createDataFrame([("a", 200.0, 1000, {"TITLE": "T", "ARTIST": "A", "GENRE": ""})], "song_id string, bpm double, gap_ms long, tags map<string,string>")
    rows = [("a", 0, "syl", 1.0, 1.5, 3, "Hello", True), ("a", 1, "syl", 1.6, 2.0, 4, "world", True), ("a", 2, "break", 2.0, 2.5, None, None, None), ("a", 3, "syl", 2.6, 3.0, 5, "a", True), ("a", 4, "syl", 3.0, 3.4, 5, "gain", False)]
    entries = spark.createDataFrame(rows, "song_id string, pos long, kind string, start double, end double, pitch long, text string, is_word_start boolean").withColumn("note_type", F.lit(":"))
    rendered = C.render_charts(songs, entries)
    text = rendered.first()["text"]
    assert text.startswith("#TITLE:T\n#ARTIST:A\n#BPM:200\n#GAP:1000\n: 0 6 3 Hello\n") and text.endswith("\nE\n") and "GENRE" not in text
    back = C.parse_entries(rendered).orderBy("pos").collect()
    assert [(r["kind"], r["text"], r["is_word_start"]) for r in back if r["kind"] == "syl"] == [("syl", "Hello", True), ("syl", "world", True), ("syl", "a", True), ("syl", "gain", False)]
    assert C.parse_headers(rendered).first()["tags"]["TITLE"] == "T" and C.chart_errors(rendered).count() == 0


def test_bad_charts_and_rebase(spark):
    texts = [("bad", "#BPM:100\n: 1 x 3 a\nE\n"), ("none", "#GAP:5\n: 1 2 3 a\n"), ("ok", "#TITLE:x\n#BPM:120\n#GAP:1000\n: -8 2 3 a\n- 0\n: 2 2 3 b\nE\n"), ("zero", "#BPM:120\n: 0 2 3 a\nE"), ("nogap", "#BPM:120,0\n: 8 2 3 a\nP2\nrubbish")]
    charts = spark.createDataFrame(texts, "song_id string, text string")
    assert {r["song_id"]: r["reason"].split(":")[0] for r in C.chart_errors(charts).collect()} == {"bad": "malformed line", "none": "no usable BPM"}
    out = {r["song_id"]: r for r in C.rebase(charts).collect()}
    assert (out["ok"]["beat_shift"], out["ok"]["new_gap_ms"]) == (8, 0)
    assert out["ok"]["text"] == "#TITLE:x\n#BPM:120\n#GAP:0\n: 0 2 3 a\n- 8\n: 10 2 3 b\nE\n"
    assert out["zero"]["text"] == texts[3][1] and "#GAP:1000" in out["nogap"]["text"]


def test_lyrics(spark):
    df = spark.createDataFrame([("k", "[ar:Me]\n[00:10.5]late\r\n[00:02.25][00:20.1] two \n[01:00]\nno stamp\n[Chorus]")], "k string, text string")
    timed = [(r["t"], r["line"]) for r in C.parse_timed_lines(df, "k", "text").orderBy("line_no").collect()]
    assert timed == [(2.25, "[00:20.1] two"), (10.5, "late")]
    tagged = C.parse_tagged_lyrics(df, "k", "text").first()
    assert tagged["artist"] == "Me" and tagged["synced"].split("\n") == ["[00:02.25]two", "[00:10.50]late", "[00:20.10]two", "[01:00.00]"]
    plain = C.parse_lyrics(spark.createDataFrame([("k", " a \n\n[Chorus]\nParoles: x\nb-c d")], "k string, text string"), "k", "text")
    assert [r["norm"] for r in C.tokenize(plain, "k").orderBy("pos").collect()] == ["a", "b", "c", "d"]


def test_reference_alignment(spark):
    heard = "we walk in is time with all the lights and then x x x x x x x x home".split()
    words = spark.createDataFrame([("s", i, w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(heard)], "s string, pos long, text string, start double, end double")
    lyrics = spark.createDataFrame([("s", "we walk in his time with all\nthe lights and then home")], "s string, text string")
    out = A.align_to_reference(words, C.tokenize(C.parse_lyrics(lyrics, "s", "text"), "s"), "s").orderBy("pos").collect()
    assert out[3]["new_text"] == "his" and [r["line_no"] for r in out][:9] == [0] * 7 + [1, 1]
    assert not any(r["dropped"] for r in out) and len(out) == len(heard)


def test_line_cursor_and_calibration(spark):
    lines = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    words = spark.createDataFrame([("s", i, w, 2.0 * i + 3.0) for i, w in enumerate(lines)], "s string, pos long, text string, start double")
    timed = spark.createDataFrame([("s", i, 2.0 * i, w) for i, w in enumerate(lines)], "s string, line_no long, t double, line string")
    found = A.line_candidates(words, timed, "s")
    assert [r["delta"] for r in found.orderBy("line_no").collect()] == [3.0] * 6
    fit = E.constant_calibration(found, ["s"], ["line_no"], "delta").first()
    assert (fit["offset"], fit["confidence"], fit["accepted"]) == (3.0, 1.0, True)


def test_verify(spark):
    left = spark.createDataFrame([("s", i, f"w{i}", float(i), 3 * i % 12) for i in range(15)], "s string, pos long, w string, start double, pitch long")
    cases = {"PASS": left.withColumn("start", F.col("start") + 0.02), "PROBLEMS_FOUND": left.withColumn("pitch", F.col("pitch") + 1), "COULD_NOT_VERIFY": left.where("pos < 5")}
    for verdict, right in cases.items():
        assert A.verify(A.match_words(left, right, ["s"], "w", "w"), left, right, "s").first()["verdict"] == verdict


def test_key_and_ratio(spark):
    mass = spark.createDataFrame([("n", pc, float(w)) for pc, w in enumerate([9.0, 0, 3, 0, 4, 4, 0, 8, 0, 3, 0, 2])] + [("flat", pc, 1.0) for pc in range(12)], "k string, pc int, mass double")
    got = {r["k"]: (r["tonic"], r["mode"]) for r in E.key_fit(mass, ["k"]).collect()}
    assert got == {"n": (0, "major"), "flat": (0, "major")}
    r = spark.createDataFrame([("abcd", "abce", ["a", "b"], ["a", "x", "y", "b"]), (None, "x", None, ["a"])], "a string, b string, p array<string>, q array<string>").select(A.text_ratio("a", "b").alias("r"), A.sequence_ratio("p", "q").alias("s"), A.largest_insert("p", "q").alias("i"), A.fuzzy_equal(F.col("a"), F.col("b"), 0.7).alias("f")).collect()
    assert (r[0]["r"], round(r[0]["s"], 4), r[0]["i"], r[0]["f"]) == (0.75, 0.6667, 2, True)


def test_listings(spark):
    paths = ["/m/a/Song.mp3", "/m/a/song.mp4", "/m/a/Song [CO].jpg", "/m/a/Song [BG].png", "/m/b/x.mp4", "/m/c/1.mp3", "/m/c/2.mp3", "/m/d/z.txt", "/m/root.mp4", "/m/root.mp3", "/m/e/e.txt", "/m/e/q.txt"]
    files = L.split_paths(spark.createDataFrame([(p,) for p in paths], "path string"), "path")
    assert [r["path"] for r in L.with_partner(files, ("mp4",), ("mp3",), "/m").collect()] == ["/m/a/song.mp4"]
    got = {r["dir"]: (r["path"], r["problem"]) for r in L.primary_source(files).collect()}
    assert got["/m/a"] == ("/m/a/Song.mp3", None) and got["/m/c"] == (None, "several sources") and got["/m/d"] == (None, "no audio source") and got["/m/b"][0] == "/m/b/x.mp4"
    c = L.companions(files, files.where("path = '/m/a/Song.mp3'")).first()
    assert (c["cover"], c["background"], c["video"]) == ("/m/a/Song [CO].jpg", "/m/a/Song [BG].png", "/m/a/song.mp4")
    assert {r["dir"]: r["path"] for r in L.existing_chart(files).collect()} == {"/m/d": "/m/d/z.txt", "/m/e": "/m/e/e.txt"}
    report = spark.createDataFrame([("/v/a.mp4",), ("   Resolution",), ("",), ("ERROR: x",), ("No videos",)], "value string")
    assert [r["path"] for r in L.report_paths(report).collect()] == ["/v/a.mp4"]
    assert S.headline_case is not None


def test_alignments_with_a_key_on_one_side_only(spark):
    """A song that only one side has gives no matches (or keeps its words) and stops nothing."""
    words = spark.createDataFrame([("x", 0, "a", 0.0, 0.1), ("x", 1, "b", 1.0, 1.1)], "s string, pos long, text string, start double, end double")
    lines = spark.createDataFrame([("y", 0, 0.0, "a b")], "s string, line_no long, t double, line string")
    tokens = spark.createDataFrame([("y", 0, "a", "a", 0)], "s string, pos long, norm string, original string, line_no long")
    assert A.match_words(words, tokens, ["s"], "text", "norm").count() == 0
    assert [(r["new_text"], r["line_no"], r["dropped"]) for r in A.align_to_reference(words, tokens, "s").orderBy("pos").collect()] == [("a", None, False), ("b", None, False)]
    assert A.line_candidates(words, lines, "s").count() == 0
    assert A.reconcile_lines(lines.withColumn("s", F.lit("x")), lines, "s").count() == 0


def test_lines_take_their_words(spark):
    heard = "we walk in time uh the light is on home again".split()
    words = spark.createDataFrame([("s", i, w, float(i), i + 0.5) for i, w in enumerate(heard)], "s string, pos long, text string, start double, end double")
    lines = spark.createDataFrame([("s", 0, "we walk in time"), ("s", 1, ""), ("s", 2, "the light is on")], "s string, line_no long, line string")
    got = A.assign_lines(words, lines, "s").orderBy("pos").collect()
    assert [r["line_no"] for r in got] == [0, 0, 0, 0, 2, 2, 2, 2, 2, None, None]
    assert [r["pos"] for r in got if r["dropped"]] == [4] and len(got) == len(heard)


def test_written_charts_are_read_back(spark, tmp_path):
    rows = [("a song", "#TITLE:x\n: 0 1 2 la\nE\n"), ("b/ö", "E\n"), ("none", None)]
    C.write_charts(spark.createDataFrame(rows, "name string, text string"), str(tmp_path / "out"))
    got = sorted((r["name"], r["text"]) for r in C.read_written(spark, str(tmp_path / "out")).collect())
    assert got == [(n, t) for n, t in rows if t is not None]


def test_fuzzy_equal_is_the_ratio(spark):
    words = ["", "a", "ab", "love", "loves", "lover", "lo", "beloved", "lovelovelove", None]
    pairs = [(a, b) for a in words for b in words]
    for least in (0.5, 0.85, 0.0):
        wanted = [None if None in p else p[0] == p[1] or ("" not in p and SequenceMatcher(None, *p).ratio() >= least) for p in pairs]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
        assert [r["f"] for r in df.select("i", A.fuzzy_equal(F.col("a"), F.col("b"), least).alias("f")).orderBy("i").collect()] == wanted


def test_capitals_are_those_asked_for(spark):
    """A replaced word keeps its capital; with ascii_case, as in the SQL of align_replace, only A-Z are capitals."""
    words = spark.createDataFrame([("s", i, t, i * 0.5, i * 0.5 + 0.4) for i, t in enumerate(["Ästheix", "Lovex"])], "s string, pos long, text string, start double, end double")
    tokens = spark.createDataFrame([("s", 0, "stheit", "ästheit", 0), ("s", 1, "love", "love", 0)], "s string, pos long, norm string, original string, line_no long")
    texts = lambda **how: [r["new_text"] for r in A.align_to_reference(words, tokens, "s", **how).orderBy("pos").collect()]
    assert texts() == ["Ästheit", "Love"]
    assert texts(ascii_case=True) == ["ästheit", "Love"]
