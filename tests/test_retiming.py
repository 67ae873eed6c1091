"""Re-timing and pitch correction by scores, on small songs whose results can be told by hand."""

import random

from chronoline.operators import alignment as A
from chronoline.operators import retiming as RT
from chronoline.operators import score_reference as SR
from chronoline.plans import pipelines

OURS = "song_id string, pos long, text string, start double, end double, line_no long"
HEARD = "song_id string, pos long, text string, start double, end double, confidence double"
CHORUS = "sing it loud again"


def song(spark, lines, gap=0.5, name="s"):
    rows, pos = [], 0
    for n, line in enumerate(lines):
        for w in line.split():
            rows.append((name, pos, w, 10.0 + pos * gap, 10.3 + pos * gap, n))
            pos += 1
    return rows


def test_repeated_lines_match_in_order(spark):
    lines = [CHORUS, "a verse of its own words", CHORUS, "other rhymes come round here", CHORUS]
    rows = song(spark, lines)
    words = spark.createDataFrame(rows, OURS)
    kept = [r for r in rows if r[5] != 1]  # the first verse was not heard at all
    heard = spark.createDataFrame([(r[0], i, r[2], r[3] + 1, r[4] + 1, 0.9) for i, r in enumerate(kept)], HEARD)
    hits = {r["pos"]: r["heard_start"] for r in RT.heard_in_order(words, heard, ["song_id"]).collect()}
    assert hits == {r[1]: r[3] + 1 for r in kept}


def test_misheard_and_unsure_words(spark):
    words = spark.createDataFrame(song(spark, ["do me some favours now please"]), OURS)
    told = [("do", 0.9), ("me", 0.1), ("some", 0.9), ("favorites", 0.9), ("now", None), ("xyz", 0.9)]
    heard = spark.createDataFrame([("s", i, w, i * 1.0, i + 0.5, c) for i, (w, c) in enumerate(told)], HEARD)
    hits = {r["pos"]: r["heard_start"] for r in RT.heard_in_order(words, heard, ["song_id"]).collect()}
    assert hits == {0: 0.0, 2: 2.0, 3: 3.0, 4: 4.0}
    lines = spark.createDataFrame([("s", 0, 2.0)], "song_id string, line_no long, t double")
    assert {r["pos"] for r in RT.heard_in_lines(words, lines, heard, ["song_id"]).collect()} == {2, 3, 4}


def test_validated_or_replaced(spark):
    lines = [" ".join(f"w{chr(97 + i)}{chr(97 + j)}{i * 7 + j}" for j in range(6)) for i in range(4)]
    good, bad = song(spark, lines, name="good"), song(spark, lines, name="bad")
    told = [(r[0], r[1], r[2], r[3] + 3.1, r[4] + 3.5, 0.9) for r in good if r[1] != 5]
    told += [(r[0], r[1], r[2], r[3] + r[1] ** 2, r[4] + r[1] ** 2, 0.9) for r in bad if r[1] != 6]
    seeds = [("good", 1, 99.0), ("bad", 1, 13.0 + 36)]
    words, heard = spark.createDataFrame(good + bad, OURS), spark.createDataFrame(told, HEARD)
    out = RT.retime(words, heard, spark.createDataFrame(seeds, "song_id string, line_no long, t double"))
    got = {(r["song_id"], r["pos"]): r for r in out.collect()}
    first = got["good", 4]
    assert first["source"] == "validated" and abs(first["new_end"] - first["new_start"] - 0.3) < 1e-9
    assert got["good", 5]["source"] == "interpolated" and got["good", 6]["source"] == "validated"
    assert got["bad", 3]["source"] == "heard" and abs(got["bad", 3]["new_start"] - (11.5 + 9)) < 1e-9
    assert (got["bad", 6]["source"], got["bad", 6]["new_start"]) == ("line", 49.0)
    empty = RT.retime(words, heard.limit(0)).collect()
    assert len(empty) == 48 and all(r["source"] == "kept" and r["new_start"] == r["start"] for r in empty)
    assert RT.retime(words.limit(0), heard).count() == 0


def test_lines_are_prepared(spark):
    texts = ["we walk down to the river", "nobody calls us home", "some lights are on", "then morning breaks again", "you said it would", "old friends of mine"]
    ours = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "song_id string, line_no long, line string")
    theirs = spark.createDataFrame([("s", i, 10.0 * i, t) for i, t in enumerate(texts) if i != 2], "song_id string, line_no long, t double, line string")
    told = [("s", 10 * i + k, w, 10.0 * i + 2 + 0.3 * k, 0.0, 0.9) for i, t in enumerate(texts) for k, w in enumerate(t.split())]
    got = RT.prepared_lines(ours, theirs, spark.createDataFrame(told, HEARD), "song_id").orderBy("line_no").collect()
    assert [(r["line_no"], round(r["t"], 3)) for r in got] == [(0, 2.0), (1, 12.0), (3, 32.0), (4, 42.0), (5, 52.0)]


def test_cursor_of_lines_is_unchanged(spark):
    assert A.find_from(0, "x a b c y".split(), ["a", "b", "c"], 3) == [("delete", 0, 1, 0, 0), ("equal", 1, 4, 0, 3), ("delete", 4, 5, 3, 3)]
    assert A.find_from(0, ["x"], ["a", "b"], 2) is None


SYLLABLE = "song_id string, pos long, text string, start double, end double, pitch long, confidence double, is_word_start boolean"


def test_scores_one_after_the_other(spark):
    rows = [("s", i, f"{chr(97 + i)}{chr(98 + i)}", float(i), i + 0.8, i, 0.5, True) for i in range(10)] + [("few", 0, "ab", 0.0, 1.0, 5, 0.5, True)]
    charts = spark.createDataFrame(rows, SYLLABLE)
    notes = [("s", float(i), i + 62 + (i == 4), f"{chr(97 + i)}{chr(98 + i)}", 0) for i in range(10)] + [("few", 0.0, 3, "ab", 0)]
    notes += [("s", float(i), i + 60 + (i == 7), f"{chr(97 + i)}{chr(98 + i)}", 1) for i in range(10)]
    scores = spark.createDataFrame(notes, "song_id string, offset double, midi long, norm string, score_no long")
    one = {(r["song_id"], r["pos"]): (r["pitch"], r["confidence"]) for r in SR.correct_syllables(charts, scores.where("score_no = 0")).collect()}
    assert one["s", 4] == (5, 0.75) and one["s", 3] == (3, 0.5) and one["few", 0] == (5, 0.5)
    both = {r["pos"]: r["pitch"] for r in SR.each_score(charts, scores, SR.correct_syllables).where("song_id = 's'").collect()}
    assert both[7] == 8 and both[4] == 4 and both[3] == 3
    assert SR.each_score(charts, scores.limit(0), SR.correct_syllables).count() == 11


def test_score_words_split_single_notes(spark):
    rows = [("s", i, f"{chr(97 + i)}{chr(98 + i)}", float(i), i + 0.6, 0, 0.9, True) for i in range(9)]
    rows += [("s", 9, "oh", 9.0, 9.2, 0, 0.9, True), ("s", 10, "~", 9.2, 9.4, 0, 0.9, False), ("s", 11, "~", 9.4, 9.6, 0, 0.9, False)]
    notes = [("s", i, f"{chr(97 + i)}{chr(98 + i)}", [(1.0, 60)] if i else [(1.0, 60), (2.0, 62)]) for i in range(9)] + [("s", 9, "oh", [(1.0, 60), (1.0, 59)])]
    words = spark.createDataFrame(notes, "song_id string, pos long, norm string, syllables array<struct<qlen: double, midi: long>>")
    got = SR.correct_words(spark.createDataFrame(rows, SYLLABLE), words).orderBy("pos", "k").collect()
    assert [(r["pos"], r["k"], r["text"], round(r["start"], 3), round(r["end"], 3), r["pitch"], r["is_word_start"]) for r in got[:2]] == [(0, 0, "ab", 0.0, 0.2, 0, True), (0, 1, "~", 0.2, 0.6, 2, False)]
    assert [r["pitch"] for r in got[-3:]] == [0, 0, -1] and len(got) == 13


def test_whole_notes_go_to_groups_of_words(spark):
    words = [("s", 0, "one", 0.0, 0.5, 0, False), ("s", 1, "two", 0.6, 1.0, 0, False), ("s", 2, "sun", 3.0, 3.4, 1, False), ("s", 3, "gone", 6.0, 6.4, 1, True)]
    notes = [("s", 0, 0.0, 0.9, 1, 0.9, False), ("s", 1, 1.2, 1.9, 2, 0.9, False), ("s", 2, 1.9, 3.5, 3, 0.9, False), ("s", 3, 3.5, 3.55, 4, 0.9, False), ("s", 4, 6.0, 6.3, 5, 0.9, False)]
    w = spark.createDataFrame(words, "song_id string, pos long, text string, start double, end double, line_id long, dropped boolean")
    n = spark.createDataFrame(notes, "song_id string, pos long, start double, end double, pitch long, confidence double, protected boolean")
    out = pipelines.generate_entries(w, n).where("kind = 'syl'").orderBy("start").collect()
    # the first note is cut between one and two; sun takes its note from before the middle of the gap, whole, and the short one after it; gone was dropped
    assert [(r["text"], round(r["start"], 2), r["pitch"]) for r in out] == [("one", 0.0, 1), ("two", 0.56, 1), ("~", 1.2, 2), ("sun", 1.91, 3), ("~", 3.51, 4)]


def test_unheard_words_come_back(spark):
    words = spark.createDataFrame([("s", 3, "we", 1.0, 1.2), ("s", 7, "home", 4.0, 4.5), ("t", 0, "we", 0.0, 1.0)], "song_id string, pos long, text string, start double, end double")
    tokens = spark.createDataFrame([("s", i, w, w.title(), i // 2) for i, w in enumerate("oh we go back home now".split())] + [("u", 0, "x", "X", 0)], "song_id string, pos long, norm string, original string, line_no long")
    runs = {(r["song_id"], r["run"]): r for r in A.unheard_runs(words, tokens, "song_id").collect()}
    assert {k: (r["window_start"], r["window_end"], r["texts"], r["line_nos"]) for k, r in runs.items()} == {
        ("s", 0): (0.0, 1.0, ["Oh"], [0]), ("s", 1): (1.2, 4.0, ["Go", "Back"], [1, 1]), ("s", 2): (4.5, 4.5, ["Now"], [2]),
    }
    heard = words.selectExpr("*", "0.9 as confidence", "0L as line_no")
    aligned = spark.createDataFrame([("s", 1, 1, "Back", 2.0, 2.5, 0.5, 1), ("s", 1, 0, "Go", 1.5, 2.0, 0.5, 1)], "song_id string, run long, k long, text string, start double, end double, confidence double, line_no long")
    got = A.splice_runs(heard, aligned, "song_id").where("song_id = 's'").orderBy("pos").collect()
    assert [(r["pos"], r["text"], r["recovered"]) for r in got] == [(0, "we", False), (1, "Go", True), (2, "Back", True), (3, "home", False)]


def test_generation_counts(spark):
    w = spark.createDataFrame([("s", 0, "big", 0.0, 0.5, 0), ("s", 1, "winter", 0.6, 1.0, 0), ("s", 2, "sun", 9.0, 9.4, 1)], "song_id string, pos long, text string, start double, end double, line_id long")
    n = spark.createDataFrame([("s", 0, 0.0, 0.3, 1, 0.9, False), ("s", 1, 0.3, 0.5, 2, 0.9, False), ("s", 2, 0.6, 1.0, 3, 0.9, False)], "song_id string, pos long, start double, end double, pitch long, confidence double, protected boolean")
    got = pipelines.generation_counts(pipelines.notes_of_words(w, n)).first().asDict()
    assert got == {"song_id": "s", "words": 3, "with_notes": 2, "without_notes": 1, "melismas": 1, "merged": 1, "notes": 3, "in_cut_groups": 2}


def test_windows_of_any_length_meet_their_points(spark):
    """Also one with a wild end, which lies in three buckets at the most."""
    from chronoline.operators import ranges as R

    r = random.Random(3)
    windows = [("s", k, a, a + r.choice([0.0, 0.3, 7.0, 300.0, 1e9])) for k in range(60) for a in [r.uniform(-50, 400)]] + [("s", 99, 5.0, 1.0), ("t", 0, 0.0, 2.0)]
    points = [(r.choice(["s", "t", "u"]), i, r.uniform(-60, 500)) for i in range(300)]
    w = spark.createDataFrame(windows, "k string, n int, lo double, hi double")
    p = spark.createDataFrame(points, "k string, i int, x double")
    got = sorted((x["i"], x["k"], x["n"]) for x in R.within_windows(p, w, ["k"], "x", "lo", "hi", 5.0).collect())
    assert got == sorted((i, k, n) for k, i, x in points for wk, n, lo, hi in windows if wk == k and lo <= x <= hi)
