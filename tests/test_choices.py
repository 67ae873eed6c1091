from chronoline.operators import choices as X


def test_gates_ranks_and_forced_candidates(spark):
    synced = "[00:10.00]one\n[01:40.00]two"
    rows = [
        (0, "t", "Other Band", 100.0, False, "a b c d", synced), (1, "t", "The Singer", 104.0, False, "a b c x", synced), (2, "t", "The Singer", 104.0, False, "a b c d", synced),
        (3, "t", "The Singer", 100.5, True, "a b c d", synced), (4, "t", "The Singer", 100.6, False, "a b c d", ""), (5, "t", "The Singer", None, False, "a b c d", synced),
        (6, "t", "The Singer", 130.0, False, "a b c d", synced), (7, "t", "The Singer", 101.0, False, "x y z", synced), (8, "t", "The Singer", 101.5, False, " ", synced),
    ]
    kind = "k string, pos int, track_name string, artist_name string, duration double, instrumental boolean, plain_lyrics string, synced_lyrics string"
    df = spark.createDataFrame([("s", *r) for r in rows] + [("none", 0, "t", "x", 400.0, False, "a", synced)], kind)
    songs = spark.createDataFrame([("s", "singer", 100.0, ["a", "b", "c", "d"]), ("none", "x", 100.0, ["a"])], "k string, artist string, seconds double, words array<string>")
    why = {r["pos"]: r["refused"] for r in X.judged_lyrics(df, songs, "k").where("k = 's'").collect()}
    assert why == {0: None, 1: None, 2: "repeat", 3: "instrumental", 4: "not synced", 5: "no duration", 6: "duration", 7: "words", 8: "no words"}
    chosen = X.choose_lyrics(df, songs, "k").collect()
    assert [tuple(r) for r in chosen] == [("s", 1, 0.75, 4.0, False)]  # the artist ranks over the duration
    forced = df.selectExpr("*", "pos = 6 as pin")
    assert [tuple(r)[:2] + (r["forced"],) for r in X.choose_lyrics(forced, songs, "k", "pin").where("k = 's'").collect()] == [("s", 6, True)]
    assert X.choose_lyrics(df.selectExpr("*", "pos = 4 as pin"), songs, "k", "pin").where("k = 's'").count() == 0


def test_first_success_else_last_failure(spark):
    tries = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), ("b", 0, False), ("b", 1, None)], "k string, n int, ok boolean")
    assert sorted((r["k"], r["n"]) for r in X.first_success(tries, "k", "n", "ok").collect()) == [("a", 1), ("b", 1)]


def test_score_pitches_move_by_the_songs_offset(spark):
    rows = [("s", i, 2 + i, 0.5, (2 + i + 60 - 2) % 12 if i != 3 else None) for i in range(10)] + [("few", i, 5, 0.5, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i int, p int, c double, pc int")
    got = {(r["k"], r["i"]): (r["new_pitch"], r["new_confidence"]) for r in X.calibrate_score_pitches(df, "k", ["i"], "p", "c", "pc").collect()}
    assert all(got["s", i] == (i, 0.75) for i in range(10)) and all(got["few", i] == (5, 0.5) for i in range(3))


def test_verification_issues(spark):
    backups = spark.createDataFrame([(p, 44100, 2, 10.0) for p in "abcdef"], "path_key string, sample_rate int, channels int, duration double")
    rows = [("a", 44100, 2, 10.0, -14.0, -2.0), ("b", 48000, 1, 10.2, -16.0, 0.0), ("c", 0, 2, 10.04, -14.9, -0.6), ("d", 44100, 2, None, -14.0, -2.0), ("e", 44100, 2, 10.0, -99.0, -2.0)]
    current = spark.createDataFrame(rows, "path_key string, sample_rate int, channels int, duration double, lufs double, true_peak double")
    got = {r["path_key"]: (r["verdict"], r["issues"]) for r in X.verification_issues(backups, current).collect()}
    assert got == {
        "a": ("ok", []), "b": ("issue", ["sample rate changed", "channel count changed", "decoded duration differs", "loudness off target", "true peak exceeds ceiling"]), "c": ("ok", []),
        "d": ("issue", ["could not be measured"]), "e": ("issue", ["could not be measured"]), "f": ("missing", []),
    }


def test_songs_are_aligned_by_trust(spark):
    words = spark.createDataFrame([(s, i, t, float(i), i + 0.5) for s in ("x", "y") for i, t in enumerate("a b c d".split())], "s string, pos long, text string, start double, end double")
    tokens = spark.createDataFrame([(s, i, t, t.upper(), i // 2) for s in ("x", "y") for i, t in enumerate("a b c d".split())], "s string, pos long, norm string, original string, line_no long")
    lines = spark.createDataFrame([("x", 0, "A B"), ("x", 1, "C D")], "s string, line_no long, line string")
    tracking = spark.createDataFrame([("x", True), ("y", True)], "s string, tracks boolean")
    got = X.align_by_trust(words, tokens, lines, tracking, "s").orderBy("s", "pos").collect()
    assert [(r["s"], r["by"], r["reference_text"], r["line_no"]) for r in got] == [("x", "lines", t, k) for t, k in zip("ABCD", (0, 0, 1, 1))] + [("y", "reference", t, k) for t, k in zip("ABCD", (0, 0, 1, 1))]
