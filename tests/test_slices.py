import time

from pyspark.sql import functions as F

from chronoline.operators import placement as P


def test_cuts_of_a_text_are_worked_out_once_a_row(spark):
    """Forty weights a text; with every cut worked out anew for each piece, two thousand texts are minutes of work."""
    texts = spark.range(2000).select("id", F.concat(F.repeat(F.lit("abcdefgh"), 10), F.col("id").cast("string")).alias("t"))
    began = time.perf_counter()
    rows = texts.select("t", P.slice_text(F.col("t"), F.array_repeat(F.lit(1.5), 40)).alias("p")).collect()
    assert time.perf_counter() - began < 20
    assert all(len(r["p"]) == 40 and "".join(r["p"]) == r["t"] and all(r["p"]) for r in rows)


def test_slices_of_odd_texts_and_weights(spark):
    rows = spark.createDataFrame([("abcd", [0.0, 0.0]), ("abcd", [9.0, 0.0, 0.0]), ("ab", [1.0, 1.0, 1.0]), (None, [1.0]), ("ab", None), ("ab", []), ("abc", [0.0, 0.0, 5.0])], "t string, w array<double>")
    got = [r["p"] for r in rows.select(P.slice_text(F.col("t"), F.col("w")).alias("p")).collect()]
    assert got == [["a", "bcd"], ["ab", "c", "d"], None, None, None, None, ["a", "b", "c"]]
