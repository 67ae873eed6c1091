import time
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from chronoline.operators import alignment as A
from chronoline.operators import blocks as B
from chronoline.operators import retiming as RT
from chronoline.operators.walks import plain, walk_pairs


def test_walks_meet_every_key_once_and_in_order(spark):
    left = spark.createDataFrame([(k, p, f"{k}{p}") for k in (1, 2, None) for p in (2, 0, 1)], "k int, pos long, w string")
    right = spark.createDataFrame([(k, float(-p)) for k in (2, None, 3) for p in range(3)], "k int, x double")
    one = lambda a, b: [("".join(w for _, w in a), sum((i + 1) * x for i, (x,) in enumerate(b)))]
    rows = walk_pairs(left, right, ["k"], (["pos"], ["x"]), one, "words string, weighed double").collect()
    assert {r["k"]: (r["words"], r["weighed"]) for r in rows} == {1: ("101112", 0.0), 2: ("202122", -4.0), None: ("None0None1None2", -4.0), 3: ("", -4.0)}
    assert len(rows) == 4


def test_alignments_cost_no_call_a_song(spark):
    """Thousands of small songs share a task's stream; a grouped function would be called for each."""
    songs = spark.range(3000).select(F.col("id").alias("s"))
    words = songs.select("s", F.posexplode(F.split(F.lit("we walk in time"), " ")).alias("pos", "text")).withColumns({"start": F.col("pos") * 1.0, "end": F.col("pos") + 0.5})
    lines = songs.select("s", F.lit(0).cast("long").alias("line_no"), F.lit(1.0).alias("t"), F.lit("we walk in time").alias("line"))
    tokens = words.select("s", F.col("pos").cast("long").alias("pos"), F.col("text").alias("norm"), F.col("text").alias("original"), F.lit(0).cast("long").alias("line_no"))
    lined = words.withColumn("line_no", F.lit(0).cast("long"))
    found = [
        A.match_words(words, tokens, ["s"], "text", "norm"), A.match_blocks(words, tokens, ["s"], "text", "norm"), A.align_to_reference(words, tokens, "s"), A.assign_lines(words, lines, "s"),
        A.line_candidates(words, lines, "s"), A.reconcile_lines(lines, lines, "s"), RT.heard_in_order(lined, words, ["s"]), RT.heard_in_lines(lined, lines, words.withColumn("start", F.col("start") + 1), ["s"]),
    ]
    assert not [p for p in (df._jdf.queryExecution().toString() for df in found) if "Pandas" in p]
    assert [df.count() for df in found] == [12000, 3000, 12000, 12000, 3000, 3000, 12000, 12000]


def test_words_without_times_are_amid_silence(spark):
    words = spark.createDataFrame([("s", i, t, None if t == "ba" else float(i), i + 0.5) for i, t in enumerate("a ba bo c".split())], "s string, pos long, text string, start double, end double")
    tokens = spark.createDataFrame([("s", i, t, t, 0) for i, t in enumerate("axc")], "s string, pos long, norm string, original string, line_no long")
    got = A.align_to_reference(words, tokens, "s").orderBy("pos").collect()
    assert [(r["reference_text"], r["dropped"]) for r in got] == [("a", False), ("x", False), ("x", False), ("c", False)]


def test_columns_come_as_plain_lists():
    for values, kind in (([1, None, 2**62 + 1], pa.int64()), ([0.1, None, float("inf")], pa.float64()), ([True, None], pa.bool_()), (["a", None, ""], pa.string()), ([["a"], None], pa.list_(pa.string())), ([3, 4], pa.int32()), ([], pa.int64())):
        got = plain(pa.array([*values, *values], kind).slice(len(values)))
        assert got == values and [type(x) for x in got] == [type(x) for x in values]


def test_a_text_that_opens_the_other_is_matched_without_a_search():
    words = [f"w{i % 5}" for i in range(60)]
    assert B.opcodes(words, words[:30]) == [("equal", 0, 30, 0, 30), ("delete", 30, 60, 30, 30)] and B.opcodes(words[:30], words) == [("equal", 0, 30, 0, 30), ("insert", 30, 30, 30, 60)]
    assert B.opcodes([], words[:2]) == [("insert", 0, 0, 0, 2)] and B.opcodes(words, words) == [("equal", 0, 60, 0, 60)] and B.opcodes([], []) == []
    began = time.perf_counter()
    for _ in range(2000):
        B.opcodes(words, words[:30])
    assert time.perf_counter() - began < 0.2


def test_short_texts_are_matched_by_bits_and_likeness_is_asked_once():
    """Lines of few words that repeat; the standard library meets every pair of equal words, and asks for each pair's likeness anew."""
    ours = ["view", "click"] * 25
    heard = ["view", "click", "clicx", "view"] * 12
    B.opcodes(ours, heard)
    began = time.perf_counter()
    for _ in range(200):
        B.opcodes(ours, heard)
    bits = time.perf_counter() - began
    began = time.perf_counter()
    for _ in range(200):
        SequenceMatcher(None, ours, heard, autojunk=False).get_opcodes()
    assert bits < 0.6 * (time.perf_counter() - began)
    assert RT._likeness("click", "clicx") == 0.8 and RT._likeness("click", "zzz") == 0.0 and RT._likeness("", "") == 1.0


def test_lines_meet_their_stretch_of_the_song_without_a_range_join(spark):
    words = spark.createDataFrame([("s", p, t, n) for p, (t, n) in enumerate([("go", 0), ("on", 0), ("go", 1), ("up", 2), ("no", 3), ("in", None)])], "song_id string, pos long, text string, line_no long")
    lines = spark.createDataFrame([("s", 0, 0.0, 2.0), ("s", 1, 5.0, 6.0), ("s", 1, 8.0, 9.0), ("s", 2, None, 9.0), ("s", 3, 9.0, 1.0), ("t", 0, 0.0, 9.0)], "song_id string, line_no long, t double, t_end double")
    heard = spark.createDataFrame([("s", p, t, x, 9.5) for p, (t, x) in enumerate([("on", -0.5), ("go", None), ("go", float("nan")), ("go", 7.0), ("go", 8.2), ("up", 8.3), ("no", 4.0), ("in", 1.0)])], "song_id string, pos long, text string, start double, end double")
    found = RT.heard_in_lines(words, lines, heard, ["song_id"])
    assert {r["pos"]: r["heard_start"] for r in found.collect()} == {1: -0.5, 2: 8.2}
    assert "Join" not in found._jdf.queryExecution().toString()
