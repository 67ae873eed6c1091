import time

from chronoline import session
from chronoline.operators import calibration as K
from chronoline.operators import ranges as R
from pyspark.sql import functions as F


def test_tasks_grow_in_number_with_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    assert session.dealt_by_rows(spark.range(950), ["id"]).rdd.getNumPartitions() == 10
    few = spark.range(100)
    assert session.dealt_by_rows(few, ["id"]) is few


def test_nearest_note_of_a_long_song_looks_at_each_edge_once(spark):
    """Ten thousand notes of one song; with a look at all edges that follow, as before, each word is twenty thousand steps."""
    notes = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") * 2.0).alias("a"), (F.col("id") * 2.0 + 1).alias("b"), (F.col("id") * 3).alias("pitch"))
    words = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("row"), (F.col("id") * 2.0 - 0.4).alias("a"), (F.col("id") * 2.0).alias("b"))
    began = time.perf_counter()
    found = {r["row"]: (r["near_pos"], r["near_pitch"]) for r in R.nearest_note(words, notes, ["k"], "a", "b", "pos", ["pitch"], "row").collect()}
    assert found == {k: (k, k * 3) for k in range(10_000)}
    assert time.perf_counter() - began < 30


def test_nearest_note_of_equal_edges_is_the_first(spark):
    notes = spark.createDataFrame([(1, 2, 0.0, 4.0, "c"), (1, 0, 4.0, 9.0, "a"), (1, 1, 4.0, 6.0, "b"), (2, 0, None, None, "n")], "k int, pos long, a double, b double, pitch string")
    words = spark.createDataFrame([(1, 10, 4.0, 4.0), (1, 11, 5.0, 5.0), (1, 12, 2.0, 2.0), (2, 13, 1.0, 1.0), (3, 14, 1.0, 1.0)], "k int, row long, a double, b double")
    found = {r["row"]: r["near_pitch"] for r in R.nearest_note(words, notes, ["k"], "a", "b", "pos", ["pitch"], "row").collect()}
    assert found == {10: "a", 11: "a", 12: "a", 13: "n", 14: None}


def test_tiers_are_worked_out_once(spark):
    """Every tier reads the first one's result; before, each of them worked it out anew inside the last stage."""
    rows = spark.range(200).select((F.col("id") % 4).alias("k"), F.col("id").alias("i"), (F.col("id") * 5.0).alias("x"), (F.col("id") % 4 * F.col("id") % 9).cast("double").alias("d"))
    summary, anchors = K.calibrate(rows, ["k"], ["i"], "x", "d")
    assert summary.count() == 4
    assert "Window" not in summary.join(anchors, "k", "left")._jdf.queryExecution().optimizedPlan().toString()
