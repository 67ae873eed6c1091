import io
import os
import random
import zipfile

import pytest
from chronoline.sources import formats as V
from pyspark.sql import functions as F


def texts(folder):
    return {p: open(os.path.join(folder, p), encoding="utf-8", newline="").read() for p in sorted(os.listdir(folder))}


def test_files_are_binned_evenly():
    r = random.Random(0)
    files = [(f"f{k}", r.choice([10, 10_000, 3_000_000])) for k in range(300)]
    bins = V.binned(files, 4 << 20)
    assert sorted(f for b in bins for f in b) == sorted(files)
    loads = [sum(s + V.OPEN_BYTES for _, s in b) for b in bins]
    assert max(loads) <= (4 << 20) + 3_000_000 + V.OPEN_BYTES and max(loads) - min(loads) <= 3_000_000 + V.OPEN_BYTES
    assert V.binned([]) == []


def test_round_trip_overwrite_and_append(spark, tmp_path):
    V.register(spark)
    folder = str(tmp_path / "charts")
    rows = [(f"s{k}", f"#TITLE:é{k}\r\n: 0 1 2 a\nE\n", k) for k in range(40)] + [("none", None, 1), (None, "x", 2)]
    df = spark.createDataFrame(rows, "name string, text string, other int").repartition(5)
    df.write.format("song_chart").mode("overwrite").option("path", folder).save()
    assert texts(folder) == {f"{n}.txt": t for n, t, _ in rows if n and t is not None}
    read = spark.read.format("song_chart").option("path", folder).option("binBytes", "200000").load()
    assert {(r["name"], r["text"]) for r in read.collect()} == {(n, t) for n, t, _ in rows if n and t is not None}
    assert read.rdd.getNumPartitions() > 5
    spark.createDataFrame([("s1", "new"), ("z", "new")], "name string, text string").write.format("song_chart").mode("append").option("path", folder).save()
    assert len(texts(folder)) == 41 and texts(folder)["s1.txt"] == "new"
    spark.createDataFrame([("z", "last")], "name string, text string").write.format("song_chart").mode("overwrite").option("path", folder).save()
    assert texts(folder) == {"z.txt": "last"}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    V.register(spark)
    folder = str(tmp_path / "charts")
    spark.createDataFrame([("kept", "old")], "name string, text string").write.format("song_chart").mode("append").option("path", folder).save()
    bad = spark.createDataFrame([("kept", "new"), ("a", "1"), ("../b", "2")], "name string, text string").repartition(3)
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("song_chart").mode("overwrite").option("path", folder).save()
    assert texts(folder) == {"kept.txt": "old"}


def test_filters_keep_other_files_closed(spark, tmp_path):
    V.register(spark)
    for name in ("a1", "a2", "b1"):
        (tmp_path / f"{name}.txt").write_text(name)
    os.chmod(tmp_path / "b1.txt", 0)
    reader = V.FileReader("song_chart", {"path": str(tmp_path)})
    keep = list(reader.pushFilters([V.StringStartsWith(("name",), "a"), V.EqualTo(("bytes",), 2)]))
    assert keep == [V.EqualTo(("bytes",), 2)]
    assert [f for p in reader.partitions() for f, _ in p.files] == [str(tmp_path / "a1.txt"), str(tmp_path / "a2.txt")]
    read = spark.read.format("song_chart").option("path", str(tmp_path / "*.txt")).load().where(F.col("name").isin("a1", "a2") & ~F.col("name").contains("2"))
    assert [r["text"] for r in read.collect()] == ["a1"]


def test_lyrics_without_a_timed_line_and_packed_scores(spark, tmp_path):
    V.register(spark)
    (tmp_path / "timed.lrc").write_text("[ti:x]\n[00:01.5]la\n", encoding="utf-16")
    (tmp_path / "plain.lrc").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "blank.lrc").write_text("[00:01.5]  \n")
    read = spark.read.format("song_lyric").option("path", str(tmp_path)).load()
    assert {r["name"]: r["text"] for r in read.collect()} == {"timed": "[ti:x]\n[00:01.5]la\n", "plain": None, "blank": None}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
        z.writestr("score.xml", "<score-partwise/>")
    (tmp_path / "p.mxl").write_bytes(packed.getvalue())
    (tmp_path / "broken.mxl").write_bytes(packed.getvalue()[:40])
    (tmp_path / "q.musicxml").write_text("﻿<score-partwise/>", encoding="utf-8")
    read = spark.read.format("song_score").option("path", str(tmp_path)).load()
    assert {r["name"]: r["text"] for r in read.collect()} == {"p": "<score-partwise/>", "broken": None, "q": "<score-partwise/>"}


def test_an_empty_folder_and_missing_options(spark, tmp_path):
    V.register(spark)
    assert spark.read.format("song_chart").option("path", str(tmp_path)).load().collect() == []
    with pytest.raises(Exception, match="give a path"):
        spark.read.format("song_chart").load().collect()
