import random

import pandas as pd
import pytest
from chronoline.operators import notes as N
from chronoline.sources import listings as L
from chronoline.streaming import notes as S
from chronoline.streaming import registry as R


def made(seed, n=400):
    """Frames of a track in hundredths, with silences, jumps, onsets and re-attacks."""
    r = random.Random(seed)
    rows, pitch = [], 60.0
    for k in range(n):
        if r.random() < 0.08:
            pitch = 50.0 + r.randint(0, 20)
        rows.append((k / 100, pitch + r.choice([0, 0, 0.2, 0.6]), round(r.random(), 3), r.random() > 0.07, r.random() < 0.1, r.random() < 0.06))
    return rows


def naive(frames):
    """Running medians by sorting, notes by a walk with a look ahead."""
    import numpy as np

    hold, trim, bounds, i = 8, 4, [], 0
    while i < len(frames):
        if not frames[i][3]:
            i += 1
            continue
        j, keep = i + 1, frames[i][5]
        if bounds and bounds[-1][1] == i and bounds[-1][3] is not None:
            keep = bounds[-1][3]
        cut = None
        while j < len(frames) and frames[j][3]:
            off = abs(frames[j][1] - float(np.median([f[1] for f in frames[i:j]])))
            jump = off >= 1.0 or (frames[j][4] and off >= 0.5)
            if jump or (frames[j][5] and j - i >= hold):
                cut = not jump
                break
            j += 1
        bounds.append((i, j, keep, cut))
        i = j
    notes = []
    for k, (a, b, keep, _) in enumerate(bounds):
        start, end = frames[a][0], frames[b - 1][0] + 0.01
        if end - start < N.MIN_SECONDS:
            end = min(start + N.MIN_SECONDS, frames[bounds[k + 1][0]][0] if k + 1 < len(bounds) else np.inf)
            if not keep or end - start < N.LEAST_REATTACK:
                continue
        midi, conf = N.settle(np.array([f[1] for f in frames[a:b]]), np.array([f[2] for f in frames[a:b]]), trim, 50.0)
        notes.append((start, end, N.vote(midi, conf) - 60, float(conf.mean()), keep))
    return notes


def as_rows(notes):
    return [(round(n.start, 6), round(n.end, 6), n.pitch, round(n.confidence, 9), n.protected) for n in notes]


@pytest.mark.parametrize("seed", range(12))
def test_segment_equals_a_walk_over_sorted_medians(seed):
    rows = made(seed)
    got = N.segment(pd.DataFrame(rows, columns=N.Frame._fields), 0.01)
    assert as_rows(got) == as_rows([N.Note(*x) for x in naive(rows)]) and len(got) > 5


def test_a_segmenter_resumes_from_its_state():
    rows = [N.Frame(*f) for f in made(3)]
    whole = N.segment(pd.DataFrame(rows, columns=N.Frame._fields), 0.01)
    notes, state = [], ([], False, None)
    for f in rows:
        track = N.Segmenter(0.01, N.SPLIT_STEP, *state)
        notes += track.push(f)
        state = track.open, track.protected, track.short
    assert notes + N.Segmenter(0.01, N.SPLIT_STEP, *state).finish() == whole


@pytest.mark.parametrize("cuts", [[400], [1, 60, 61, 200], [37 * k for k in range(1, 11)]])
def test_a_stream_in_any_batches_gives_the_notes_of_the_whole(spark, tmp_path, cuts):
    r = random.Random(len(cuts))
    tracks = {"a": made(1), "b": made(2)}
    kind = "track string, at timestamp, t double, midi double, conf double, voiced boolean, onset boolean, strong_onset boolean"
    stamp = lambda t: pd.Timestamp(1_000_000_000 + t, unit="s")

    def put(k, rows):
        spark.createDataFrame([(key, stamp(f[0]).to_pydatetime(), *f) for key, f in rows], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))

    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")

    def run():
        found = S.stream_notes(stream, "track", "at", 0.01, "500 milliseconds", 5.0)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    begin = 0
    for k, end in enumerate([*cuts, 400]):
        rows = [(key, f) for key, frames in tracks.items() for f in frames[begin:end]]
        # frames of the next batch's first 0.2 s come early, in any order
        begin = max(begin, min(end, 400) - 0)
        r.shuffle(rows)
        if rows:
            put(k, rows)
            run()
    put(998, [("heartbeat", (60.0, 0.0, 0.0, False, False, False))])
    run()
    put(999, [("heartbeat", (61.0, 0.0, 0.0, False, False, False))])
    run()
    got = spark.read.parquet(out).where("track <> 'heartbeat'").orderBy("track", "start").collect()
    for key, frames in tracks.items():
        want = N.segment(pd.DataFrame(frames, columns=N.Frame._fields), 0.01)
        mine = [N.Note(x["start"], x["end"], x["pitch"], x["confidence"], x["protected"]) for x in got if x["track"] == key]
        assert as_rows(mine) == as_rows(want)


@pytest.mark.parametrize("cuts, seed", [([40], 0), ([1, 9, 20], 1), ([5, 6, 33], 2)])
def test_streamed_registry_actions_equal_the_batch_form(spark, tmp_path, cuts, seed):
    r = random.Random(7)
    crc = lambda: f"c{r.randrange(45)}"
    registry = spark.createDataFrame([(f"p{k}", crc()) for k in range(0, 40, 2)], "path_key string, crc string")
    same = [tuple(x) for x in registry.limit(3).collect()]
    files = [*same, *((f"p{k}", crc()) for k in range(40) if f"p{k}" not in dict(same)), (None, "c1"), ("p99", None)]
    backups = spark.createDataFrame([(f"p{k}",) for k in range(0, 60, 3)] * 2, "path_key string")
    random.Random(seed).shuffle(files)
    kind = "path_key string, crc string"
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(files)])):
        if b > a:
            spark.createDataFrame(files[a:b], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
            found = R.stream_registry_actions(stream, registry, backups)
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    known = spark.createDataFrame([f for f in files if None not in f], kind)
    want = L.registry_actions(known, registry, backups)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    after = lambda actions: sorted(map(tuple, L.upsert(registry, actions).collect()))
    assert after(got) == after(want) and {"move", "skip", "redo", "new", "record"} == {x["action"] for x in want.collect()}


@pytest.mark.parametrize("ttl_ms, third", [(None, "redo"), (1, "new")])
def test_a_path_that_comes_again_is_judged_by_what_it_came_with_until_that_expires(spark, tmp_path, ttl_ms, third):
    empty = spark.createDataFrame([], "path_key string, crc string")
    stream = spark.readStream.schema("path_key string, crc string").parquet(str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for k, crc in enumerate(("a", "b")):
            spark.createDataFrame([("p", crc)], "path_key string, crc string").write.parquet(str(tmp_path / "in" / str(k)))
            found = R.stream_registry_actions(stream, empty, empty, ttl_ms)
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert sorted((x["crc"], x["action"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "new"), ("b", third)]
