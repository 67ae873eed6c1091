from chronoline.sources import scores as X


def test_more_files_than_are_held_at_a_time_keep_all_notes(spark):
    n = 3 * X.FILES_AT_ONCE + 1
    note = "<note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration></note>"
    files = spark.createDataFrame([(str(k), f'<score-partwise><part id="P"><measure>{note * 2}</measure></part></score-partwise>' if k % 5 else "none") for k in range(n)], "song_id string, text string").coalesce(1)
    rows = X.read_scores(files).collect()
    assert sorted((r["song_id"], r["pos"]) for r in rows) == sorted((str(k), p) for k in range(n) if k % 5 for p in (0, 1))
