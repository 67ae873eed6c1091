"""Notes as pitch frames arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoline.operators.notes import SPLIT_STEP, Frame, Note, Segmenter
from chronoline.streaming.state import use_rocksdb

FRAME_TYPE = "at_ms bigint, t double, midi double, conf double, voiced boolean, onset boolean, strong_onset boolean"
NOTE_COLUMNS = ["start", "end", "pitch", "confidence", "protected"]


class NoteTracks(StatefulProcessor):
    """One track a key.

    Frames wait in a list state until the watermark has passed them, and are then pushed in order of time; a timer at the first waiting one says
    when. Between pushes the open note is a list state of its frames, and what else there is to know of it a value state. A track without a
    frame for idle_ms is at its end.
    """

    def __init__(self, key: str, frame_seconds: float, split: float, idle_ms: int):
        self.key, self.frame_seconds, self.split, self.idle_ms = key, frame_seconds, split, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", FRAME_TYPE)
        self.open = handle.getListState("open", "t double, midi double, conf double")
        self.track = handle.getValueState("track", "done_ms bigint, timer bigint, protected boolean, start double, end double, pitch int, confidence double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        for pdf in rows:
            new = [tuple(r) for r in pdf[["at_ms", *Frame._fields]].itertuples(index=False) if r.at_ms > known["done_ms"]]  # an older one is too late
            if new:
                self.waiting.appendList(new)
                self._set_timer(known, min(r[0] for r in new))
        self._keep(known)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        known["timer"] = None
        frames = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due, rest = [r for r in frames if r[0] <= mark], [r for r in frames if r[0] > mark]
        short = None if known["start"] is None else Note(known["start"], known["end"], known["pitch"], known["confidence"], True)
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        track = Segmenter(self.frame_seconds, self.split, held, known["protected"], short)
        notes = [n for r in due for n in track.push(Frame(*r[1:]))]
        if due:
            known["done_ms"] = due[-1][0]
        ended = not rest and known["done_ms"] + self.idle_ms <= mark
        if ended:
            notes += track.finish()
        (self.waiting.put(rest) if rest else self.waiting.clear())
        (self.open.put(track.open) if track.open else self.open.clear())
        # only a protected short note can still come to be one
        left = track.short if track.short is not None and track.short.protected else None
        known |= {"protected": track.protected} | {c: getattr(left, c, None) for c in ("start", "end", "pitch", "confidence")}
        if rest:
            self._set_timer(known, rest[0][0])
        elif track.open or left:
            self._set_timer(known, known["done_ms"] + self.idle_ms)
        self._keep(known)
        rows = [(*key, *(getattr(n, c) for c in NOTE_COLUMNS)) for n in notes]
        yield pd.DataFrame(rows, columns=[self.key, *NOTE_COLUMNS])

    def close(self) -> None:
        pass

    def _known(self) -> dict:
        names = ("done_ms", "timer", "protected", "start", "end", "pitch", "confidence")
        return dict(zip(names, self.track.get() if self.track.exists() else (-(1 << 62), None, False, None, None, None, None)))

    def _keep(self, known: dict) -> None:
        self.track.update(tuple(known.values()))

    def _set_timer(self, known: dict, ms: int) -> None:
        """The one timer of the track; an earlier one stays."""
        ms = int(ms)
        if known["timer"] is None or ms < known["timer"]:
            if known["timer"] is not None:
                self.handle.deleteTimer(known["timer"])
            self.handle.registerTimer(ms)
            known["timer"] = ms


def stream_notes(frames: DataFrame, key: str, at: str, frame_seconds: float, late: str = "10 seconds", idle_seconds: float = 30.0, split: float = SPLIT_STEP) -> DataFrame:
    """Streaming frames(key, at timestamp, t, midi, conf, voiced, onset, strong_onset) -> the notes of notes.segment, appended as the watermark passes what decides them.

    Frames may come in any order within the watermark's delay; later ones, and frames without a time, are left out. A gap of idle_seconds ends a track; state is the open note, a short note before it
    and the frames not passed yet, whatever the length of the track.
    """
    use_rocksdb(frames.sparkSession)
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.where(f"`{at}` is not null").selectExpr(f"`{key}`", f"`{at}` as at", f"unix_millis(`{at}`) as at_ms", *(f"`{c}`" for c in Frame._fields)).withWatermark("at", late)
    processor = NoteTracks(key, frame_seconds, split, int(idle_seconds * 1000))
    out = f"`{key}` {kind}, start double, end double, pitch int, confidence double, protected boolean"
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")
