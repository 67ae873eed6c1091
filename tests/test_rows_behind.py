import time

from chronoline.operators import ordered as O
from pyspark.sql import functions as F


def test_anchors_behind_are_read_once(spark):
    """One song of 60,000 words, of which only the last is an anchor; a look at all rows behind each would be 10**9 steps."""
    words = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.col("id").cast("double").alias("s"), (F.col("id") + 0.5).alias("e"))
    words = words.withColumns({"a": F.when(F.col("pos") == 59_999, F.col("s") + 2), "ae": F.when(F.col("pos") == 59_999, F.col("e") + 2)})
    began = time.perf_counter()
    rows = O.interpolate_anchors(words, ["k"], ["pos"], "s", "e", "a", "ae").select(F.min(F.col("new_start") - F.col("s")), F.max(F.col("new_start") - F.col("s"))).first()
    assert tuple(rows) == (2.0, 2.0)
    assert time.perf_counter() - began < 20
