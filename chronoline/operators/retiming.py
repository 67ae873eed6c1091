"""Re-timing of finished charts by heard words.

Which heard word stands for which of ours is found line by line, either with a cursor that only moves on or inside each
line's own time; what follows (calibration, anchors, fall-back, seeds) is DataFrame work. One song, or one line, is one group.

Cases: a heard word without a confidence counts as sure; words without a line are cut into sixes where the whole song has none, else
their run is a chunk of its own; songs without heard words have no hits; texts that are null or all marks are equal to each other only.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoline.operators import alignment as A
from chronoline.operators import calibration as K
from chronoline.operators import estimators as E
from chronoline.operators import ordered as O
from chronoline.operators import placement as P
from chronoline.operators import ranges as R
from chronoline.operators.walks import walk_pairs
from chronoline.session import checkpoint

MIN_CONFIDENCE, MIN_RATIO = 0.3, 0.6
CHUNK_WORDS, MAX_PENDING = 6, 60
WINDOW_SLACK, WINDOW_BUCKET = 0.5, 5.0
VALIDATE_SECONDS, MIN_ANCHORED = 0.3, 0.5
FLAG_SECONDS = 2.0
_HITS = "pos bigint, heard_start double, heard_end double"


@lru_cache(maxsize=100_000)
def _likeness(a: str, b: str) -> float:
    """Ratio of two short strings; 0 where upper bounds of it are under MIN_RATIO."""
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.ratio() if matcher.real_quick_ratio() >= MIN_RATIO and matcher.quick_ratio() >= MIN_RATIO else 0.0


def _stand_ins(spans: Iterable[tuple], ours: list[str], heard: list[str], sure: list[bool]) -> dict[int, int]:
    """Our index -> heard index over spans (tag, ours from, ours to, heard from, heard to).

    Equal words stand for each other; a lone word of ours also for the most alike heard word of its span, if alike enough. Unsure words never do.
    """
    pairs: list[tuple[int, int]] = []
    for tag, i0, i1, j0, j1 in spans:
        if tag == "equal":
            pairs += zip(range(i0, i1), range(j0, j1))
        elif tag == "replace" and i1 == i0 + 1:
            likeness, nearest = max((_likeness(ours[i0], heard[j]), -j) for j in range(j0, j1))
            pairs += [(i0, -nearest)] if likeness >= MIN_RATIO else []
    return {i: j for i, j in pairs if sure[j]}


class _Heard:
    """Heard words (start, pos, text, end, confidence) of a group in order."""

    def __init__(self, rows: list[tuple]):
        self.norms = [A.norm(text) for _, _, text, _, _ in rows]
        self.sure = [sure is None or sure != sure or sure >= MIN_CONFIDENCE for *_, sure in rows]
        self.times = [(start, end) for start, _, _, end, _ in rows]


def _heard_columns(heard: DataFrame, key: list[str]) -> DataFrame:
    sure = F.col("confidence") if "confidence" in heard.columns else F.lit(None)
    return heard.select(*key, F.col("start").cast("double").alias("start"), F.col("pos").cast("long").alias("pos"), "text", F.col("end").cast("double").alias("end"), sure.cast("double").alias("confidence"))


def with_chunks(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds chunk: runs of one line_no, or six words each in songs without lines."""
    at = F.row_number().over(O.over(key, ["pos"])) - 1
    changes = ~F.col("line_no").eqNullSafe(F.lag("line_no").over(O.over(key, ["pos"])))
    lined = F.max("line_no").over(Window.partitionBy(*key)).isNotNull()
    runs = O.islands(words, key, ["pos"], changes, "_run")
    return runs.withColumn("chunk", F.when(lined, F.col("_run")).otherwise(F.floor(at / CHUNK_WORDS))).drop("_run")


def heard_in_order(words: DataFrame, heard: DataFrame, key: list[str]) -> DataFrame:
    """key, pos, heard_start, heard_end of our words that were heard, matched chunk by chunk ahead of a cursor without regard to times.

    words(key, pos, text, line_no) and heard(key, pos, text, start, end, confidence).
    """

    def one(a: list[tuple], b: list[tuple]) -> Iterable[tuple]:
        ear, cursor, pending = _Heard(b), 0, 0
        for _, chunk in groupby(a, lambda w: w[0]):
            rows = list(chunk)
            ours = [A.norm(text) for _, _, text in rows]
            pending = min(pending + len(ours), MAX_PENDING)
            spans = A.find_from(cursor, ear.norms, ours, pending, lenient=1)
            if spans is None:
                continue
            ahead = [(tag, i0, i1, cursor + j0, cursor + j1) for tag, j0, j1, i0, i1 in spans]
            hits = _stand_ins(ahead, ours, ear.norms, ear.sure)
            yield from ((rows[i][1], *ear.times[j]) for i, j in hits.items())
            cursor, pending = max(hits.values(), default=cursor - 1) + 1, 0

    chunked = with_chunks(words, key).select(*key, F.col("chunk").cast("long").alias("chunk"), F.col("pos").cast("long").alias("pos"), "text")
    return walk_pairs(chunked, _heard_columns(heard, key), key, (["chunk", "pos"], ["start", "pos"]), one, _HITS)


def heard_near_lines(lines: DataFrame, heard: DataFrame, key: list[str], slack: float = WINDOW_SLACK) -> DataFrame:
    """heard with line_no, one row for every line in whose time, with some slack, a word starts.

    lines(key, line_no, t, t_end); without t_end a line ends where the next one starts, the last after five seconds.
    """
    ended = lines if "t_end" in lines.columns else R.line_windows(lines, key, ["line_no"], "t")
    windows = ended.select(*key, "line_no", (F.col("t") - slack).alias("_lo"), (F.col("t_end") + slack).alias("_hi"))
    return R.within_windows(heard, windows, key, "start", "_lo", "_hi", WINDOW_BUCKET).drop("_lo", "_hi")


def heard_in_lines(words: DataFrame, lines: DataFrame, heard: DataFrame, key: list[str]) -> DataFrame:
    """As heard_in_order, each line against the words heard in its own time (heard_near_lines); words without a line have no hits.

    A song is met once, with its lines' times among its words; what is heard in a line's time is a stretch of the song's heard words.
    """

    def one(a: list[tuple], b: list[tuple]) -> Iterable[tuple]:
        timed = [h for h in b if h[0] is not None and h[0] == h[0]]
        ear, starts = _Heard(timed), [h[0] for h in timed]
        for _, rows in groupby(a, lambda w: w[0]):
            line = list(rows)
            ours = [(pos, A.norm(text)) for _, pos, text, low, _ in line if low is None]
            spans = [(bisect_left(starts, low), bisect_right(starts, high)) for *_, low, high in line if low is not None and low <= high]
            near = [j for span in spans for j in range(*span)]
            if not ours or not near:
                continue
            near = sorted(near) if len(spans) > 1 else near
            norms, mine = [ear.norms[j] for j in near], [norm for _, norm in ours]
            hits = _stand_ins(A.blocks(mine, norms), mine, norms, [ear.sure[j] for j in near])
            yield from ((ours[i][0], *ear.times[near[j]]) for i, j in hits.items())

    number, none = F.col("line_no").cast("long").alias("line_no"), F.lit(None).cast("double")
    ours = words.where("line_no is not null").select(*key, number, F.col("pos").cast("long").alias("pos"), "text", none.alias("low"), none.alias("high"))
    ended = lines if "t_end" in lines.columns else R.line_windows(lines, key, ["line_no"], "t")
    at = lambda c, name: c.cast("double").alias(name)
    windows = ended.where("line_no is not null and t is not null and t_end is not null").select(
        *key, number, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), at(F.col("t") - WINDOW_SLACK, "low"), at(F.col("t_end") + WINDOW_SLACK, "high")
    )
    return walk_pairs(ours.unionByName(windows), _heard_columns(heard, key), key, (["line_no", "pos"], ["start", "pos"]), one, _HITS)


def prepared_lines(ours: DataFrame, theirs: DataFrame, heard: DataFrame, key: str) -> DataFrame:
    """key, line_no, t: our lines with the times of a timed lyric that tells the same lines, moved to what was heard.

    ours(key, line_no, line), theirs(key, line_no, t, line). Songs whose lines do not reconcile or whose times do not calibrate have no rows.
    """
    met = A.reconcile_lines(ours, theirs, key).withColumnRenamed("our_line", "line_no").withColumn("row_id", F.concat_ws("|", key, "line_no"))
    met = checkpoint(met)
    found = A.line_candidates(heard, met.drop("row_id"), key).withColumn("row_id", F.concat_ws("|", key, "line_no"))
    _, anchors = K.calibrate(found, [key], ["line_no"], "t", "delta")
    moved = E.interpolate(met, anchors, [key], "t", "row_id").where("fitted is not null").select("row_id", "fitted")
    return met.join(moved, "row_id").select(key, "line_no", F.col("fitted").alias("t"), "line")


def retime(words: DataFrame, heard: DataFrame, lines: DataFrame | None = None, strategy: str = "validate", tolerance: float = VALIDATE_SECONDS, least: float = MIN_ANCHORED) -> DataFrame:
    """words(song_id, pos, text, start, end, line_no) -> new_start, new_end, source and placed of every word.

    ``validate``: a song is shifted as a whole by one calibration; a word heard within the tolerance of where it should be then takes its heard
    start and keeps its length. Songs in which fewer than ``least`` of the words come to an anchor are matched as ``replace`` does: every heard word takes
    its heard times. ``windowed``: as ``replace``, but songs with lines look only into each line's time. lines(song_id, line_no, t) are calibrated
    times of our lines (prepared_lines): they seed the first word of a line that was not heard. All others move with the anchors around them.
    """
    key = ["song_id"]
    for name in {"line_no"} - set(words.columns):
        words = words.withColumn(name, F.lit(None).cast("long"))
    words = words.withColumn("row_id", F.concat_ws("|", "song_id", "pos"))
    hits = heard_in_order(words, heard, key)
    if strategy == "windowed" and lines is not None:
        lined = lines.select("song_id").distinct()
        hits = hits.join(lined, key, "left_anti").unionByName(heard_in_lines(words.join(lined, key, "left_semi"), lines, heard, key))
    both = checkpoint(words.join(hits, ["song_id", "pos"], "left"))
    times = {"a": F.col("heard_start"), "ae": F.col("heard_end"), "source": F.when(F.col("heard_start").isNotNull(), "heard")}
    if strategy == "validate":
        drift = both.where("heard_start is not null").withColumn("delta", F.col("heard_start") - F.col("start"))
        _, anchors = K.calibrate(drift, key, ["pos"], "start", "delta")
        expected = E.interpolate(both, anchors, key, "start", "row_id").select("row_id", "fitted")
        both = both.join(expected, "row_id", "left").withColumn("fitted", F.coalesce("fitted", "start"))
        close = F.abs(F.col("heard_start") - F.col("fitted")) <= tolerance
        ours = {"_a": F.when(close, F.col("heard_start")), "_ae": F.when(close, F.col("heard_start") + F.col("end") - F.col("start"))}
        both = both.withColumns(ours)
    seeds = {"seed_start": F.lit(None).cast("double"), "seed_end": F.lit(None).cast("double")}
    seeded = lambda df, anchor: df.withColumns(seeds)
    if lines is not None and strategy != "windowed":
        starts = lines.select("song_id", "line_no", F.col("t").alias("line_start"))
        both = both.join(starts, ["song_id", "line_no"], "left")
        both = both.withColumn("line_no", F.when(F.col("line_start").isNotNull(), F.col("line_no")))
        seeded = lambda df, anchor: P.seed_line_starts(df, key, ["pos"], "line_no", "line_start", "start", "end", anchor)
    if strategy == "validate":
        both = seeded(both, "_a")
        share = F.avg(F.coalesce("_a", "seed_start").isNotNull().cast("double")).over(Window.partitionBy(*key))
        both = both.withColumn("_safe", share >= least).drop("seed_start", "seed_end")
        pick = lambda a, b: F.when(F.col("_safe"), a).otherwise(b)
        times = {
            "a": pick(F.col("_a"), times["a"]), "ae": pick(F.col("_ae"), times["ae"]),
            "source": pick(F.when(F.col("_a").isNotNull(), "validated"), times["source"]),
        }
    both = seeded(both.withColumns(times), "a")
    source = F.coalesce("source", F.when(F.col("seed_start").isNotNull(), "line"))
    both = both.withColumns({"source": source, "a": F.coalesce("a", "seed_start"), "ae": F.coalesce("ae", "seed_end")})
    moved = O.interpolate_anchors(both, key, ["pos"], "start", "end", "a", "ae")
    return moved.withColumn("source", F.coalesce("source", "placed")).select("song_id", "pos", "start", "end", "new_start", "new_end", "source", "placed")


def line_timing(ours: DataFrame, theirs: DataFrame, tokens: DataFrame, their_tokens: DataFrame, key: str, tolerance: float = FLAG_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(summary, lines): does a finished chart keep the times of a timed lyric?

    ours(key, line_no, start), theirs(key, line_no, t); tokens(key, pos, norm, line_no) of both. summary has the calibration and tracks, true
    where two lines or more match and a calibration was found; lines has line_no, expected, residual and flagged of the calibrated songs' lines.
    """
    votes = A.line_votes(A.match_words(tokens, their_tokens, [key], "norm", "norm"), tokens, their_tokens, key)
    named = votes.select(key, F.col("left_line").alias("line_no"), F.col("right_line").alias("_their"))
    met = named.join(ours.select(key, "line_no", "start"), [key, "line_no"]).join(theirs.select(key, F.col("line_no").alias("_their"), "t"), [key, "_their"])
    met = checkpoint(met.withColumns({"delta": F.col("start") - F.col("t"), "row_id": F.concat_ws("|", key, "line_no")}))
    summary, anchors = K.calibrate(met, [key], ["line_no"], "t", "delta")
    fitted = E.interpolate(met, anchors, [key], "t", "row_id").where("fitted is not null").select("row_id", "fitted")
    residual = F.col("start") - F.col("fitted")
    lines = met.join(fitted, "row_id").select(key, "line_no", F.col("fitted").alias("expected"), residual.alias("residual"), (F.abs(residual) > tolerance).alias("flagged"))
    tracks = (F.col("total") >= 2) & F.col("kind").isNotNull()
    return summary.withColumn("tracks", tracks), lines
