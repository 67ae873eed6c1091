"""Placement of a score's words on a timed lyric, on small songs whose results can be told by hand."""

import pytest
from chronoline.operators import score_placement as SP
from pyspark.sql import functions as F

WORD = "song_id string, pos long, text string, norm string, offset double, syllables array<struct<off: double, qlen: double, midi: long, text: string>>"
LINE = "song_id string, line_no long, t double, line string"
HEARD = "song_id string, pos long, text string, start double, end double, confidence double"


def score(name, *words):
    """Rows of words, each a list of syllables; a syllable is a text of one quarter or (text, quarters)."""
    rows, at = [], 0.0
    for pos, word in enumerate(words):
        made, begin = [], at
        for s in word:
            text, q = s if isinstance(s, tuple) else (s, 1.0)
            made.append((at, q, 60 + len(made), text))
            at += q
        text = "".join(m[3] for m in made if m[3] != "~")
        rows.append((name, pos, text, "".join(c for c in text.lower() if c.isalnum() or c == "'"), begin, made))
    return rows


@pytest.fixture(scope="module")
def assigned(spark):
    rows = score("plain", ["sun"], ["light"], ["falls"]) + score("ocr", ["the"], ["gar", "dem"], ["grows"]) + score("no", ["the"], ["qzx"], ["grows"])
    rows += score("cut", ["I"], [("camrun", 3.0)], ["too"]) + score("halves", ["we"], [("fo", 0.5)], [("rest", 1.5)], ["sing"]) + score("none", ["word"])
    lines = [("plain", 0, 10.0, "sun light"), ("plain", 1, 20.0, "falls"), ("ocr", 0, 5.0, "the garden grows"), ("no", 0, 5.0, "the river grows")]
    lines += [("cut", 0, 1.0, "I can run too"), ("halves", 0, 8.0, "we forest, sing")]
    words, lyric = spark.createDataFrame(rows, WORD), spark.createDataFrame(lines, LINE)
    return SP.lines_for_words(words, lyric).cache(), lyric


def test_lines_and_texts(assigned):
    out, _ = assigned
    got = {(r["song_id"], r["pos"]): r for r in out.collect()}
    assert [got["plain", i]["line_no"] for i in range(3)] == [0, 0, 1] and ("none", 0) not in got
    assert got["ocr", 1]["clean_text"] == "garden" and got["ocr", 1]["candidate"] is None
    assert got["no", 1]["clean_text"] is None and got["no", 1]["candidate"] == "river" and got["no", 1]["line_no"] == 0
    cut = got["cut", 1]
    assert [tuple(s) for s in cut["shown"]] == [("can", True), ("run", True)] and cut["clean_text"] is None
    assert [(s["off"], s["qlen"], s["text"]) for s in cut["syllables"]] == [(1.0, 1.5, "can"), (2.5, 1.5, "run")]
    assert [tuple(s) for s in got["halves", 1]["shown"]] == [("fo", True)] and [tuple(s) for s in got["halves", 2]["shown"]] == [("rest,", False)]
    assert got["halves", 1]["grp"] == got["halves", 2]["grp"] == 1 and got["halves", 1]["grp_text"] == "forest,"


def test_words_are_placed(spark, assigned):
    out, lyric = assigned
    told = [("plain", 0, "sun", 10.2, 10.5, 0.9), ("halves", 0, "we", 8.1, 8.2, 0.9), ("halves", 1, "forest", 8.4, 9.2, 0.9), ("no", 0, "the", 5.0, 5.2, 0.9), ("no", 1, "river", 5.5, 6.0, 0.9), ("no", 2, "grows", 7.0, 7.0, 0.9)]
    placed = SP.place_words(out, lyric, spark.createDataFrame(told, HEARD)).cache()
    got = {(r["song_id"], r["pos"]): r for r in placed.collect()}
    times = lambda song, n: [(round(got[song, i]["start"], 3), round(got[song, i]["end"], 3), got[song, i]["placed_by"]) for i in range(n)]
    # one word heard for the group, shared by quarters; the last word has two anchors before it: 0.6 seconds in a half quarter
    assert times("halves", 4)[:3] == [(8.1, 8.2, "heard"), (8.4, 8.6, "heard"), (8.6, 9.2, "heard")]
    assert times("halves", 4)[3] == (9.2, 9.6, "rate")
    assert times("no", 3) == [(5.0, 5.2, "heard"), (5.5, 6.0, "heard"), (7.0, 7.3, "heard")] and got["no", 1]["clean_text"] == "river"
    # a lone anchor gives no rate: words lie at their share of their own line
    assert times("plain", 3) == [(10.2, 10.5, "heard"), (20.0, 20.0, "line"), (20.0, 20.3, "line")]
    quality = {r["song_id"]: (r["words"], r["heard"], r["guessed"]) for r in SP.placement_quality(placed).collect()}
    assert quality["halves"] == (4, 3, 1) and quality["ocr"] == (3, 0, 3)
    made = {(r["song_id"], r["pos"], r["k"]): r for r in SP.score_syllables(placed).collect()}
    assert (made["ocr", 1, 0]["text"], made["ocr", 1, 1]["text"], made["ocr", 1, 1]["pitch"]) == ("gar", "den", 1)
    assert made["cut", 1, 1]["is_word_start"] and made["halves", 2, 0]["is_word_start"] is False
    width = made["ocr", 1, 1]["end"] - made["ocr", 1, 0]["start"]
    assert abs(made["ocr", 1, 0]["end"] - made["ocr", 1, 0]["start"] - width / 2) < 1e-9


def test_slots(spark):
    cases = [(["keep", "going,"], ["keep"], ["x", "y"]), (["we", "see"], ["we"], ["x"]), (["half-light", "now"], ["half", "light"], ["a", "b", "c"]), (["ay"], ["ay"], ["a", "b", "c"]), (["winter"], ["win", "ter"], ["win", "ter"])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, tokens array<string>, parts array<string>, slot array<string>")
    got = [r["s"] for r in df.select("i", SP.slots(F.col("tokens"), F.col("parts"), F.col("slot")).alias("s")).orderBy("i").collect()]
    assert got == [["keep", "going,"], ["we see"], ["half", "light", "now"], ["ay", "~", "~"], ["win", "ter"]]


def test_shown_texts(spark):
    cases = [(None, ["a", "~"]), ("gone", ["go", "ne"]), ("hey", ["h3y", "~"]), ("sunny", ["sum", "my"]), ("two words", ["tow", "ords"]), ("x", ["~", "~"]), ("river", ["zzz", "qq"])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, clean string, own array<string>").withColumn("parts", F.array("clean"))
    got = [r["s"] for r in df.select("i", SP.shown_texts(F.col("clean"), F.col("parts"), F.col("own")).alias("s")).orderBy("i").collect()]
    assert got == [["a", "~"], ["go", "ne"], ["hey", "~"], ["sun", "ny"], ["tow", "ords"], ["x", "~"], ["zzz", "qq"]]


def test_whole_charts(spark):
    words = spark.createDataFrame(score("s", ["one"], ["two"], ["three"]) + score("bad", ["one"], ["two"], ["three"]), WORD)
    lyric = spark.createDataFrame([(s, 0, 1.0, "one two three") for s in ("s", "bad")], LINE)
    heard = spark.createDataFrame([("s", i, w, 1.0 + i, 1.5 + i, 0.9) for i, w in enumerate(["one", "two"])], HEARD)
    made, quality = SP.chart_from_score(words, lyric, heard)
    assert {r["song_id"]: r["accepted"] for r in quality.collect()} == {"s": True, "bad": False}
    assert [(r["text"], r["start"]) for r in made.orderBy("start").collect()] == [("one", 1.0), ("two", 2.0), ("three", 3.0)]
    assert SP.chart_from_score(words.limit(0), lyric, heard)[0].count() == 0
