import random

from pyspark.sql import functions as F

from chronoline.operators import phrasing as P


def walk(rows):
    """Breaks of one song, rows (start, end, is_word_start, line_id) in order; no forced ones."""
    out, length, line, last_end = [], 0, None, None
    for start, end, opens, own in rows:
        cut = False
        if opens and last_end is not None:
            known = line is not None and own is not None
            if not (known and own == line):
                cut = known or start - last_end >= P.GAP or (length >= P.HARD or (length >= P.SYLLABLES and start - last_end >= P.SOFT_GAP))
        out.append(cut)
        length = 1 if cut else length + 1
        line = own if opens and own is not None else line
        last_end = end
    return out


def test_free_breaks_stream_through_songs_and_batches(spark):
    r, songs = random.Random(4), {}
    for s in [None, *range(60)]:
        t, rows = 0.0, []
        for i in range(r.randint(1, 60)):
            t += r.choice([0.0, 0.1, 0.2, 0.5])
            rows.append((t, t + 0.1, r.random() < 0.6, r.choice([None, None, i // 9])))
            t += 0.1
        songs[s] = rows
    made = [(s, i, *row, "la") for s, rows in songs.items() for i, row in enumerate(rows)]
    r.shuffle(made)
    df = spark.createDataFrame(made, "song long, pos long, start double, end double, is_word_start boolean, line_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        broken = P.free_breaks(df, ["song"], ["pos"])
        assert "InPandas" not in broken._jdf.queryExecution().toString()  # no call a song
        got = {(x["song"], x["pos"]): x["break_before"] for x in broken.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(s, i): cut for s, rows in songs.items() for i, cut in enumerate(walk(rows))}
    assert got == want and sum(want.values()) > 100


def test_a_long_run_of_a_line_is_cut_at_a_comma(spark):
    df = spark.range(14).select(F.lit(1).alias("song"), F.col("id").alias("pos"), (F.col("id") * 0.2).alias("start"), (F.col("id") * 0.2 + 0.1).alias("end"), F.lit(True).alias("is_word_start"), F.lit(5).alias("line_id"), F.when(F.col("id") == 6, "la,").otherwise("la").alias("text"))
    assert [x["pos"] for x in P.free_breaks(df, ["song"], ["pos"]).where("break_before").collect()] == [7]
