"""Streaming extensions: gap groups of timed rows as they arrive, and a content registry kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gap_sessions(rows: DataFrame, key: str, t: str, max_gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """key, first_t, last_t, n of every finished group, appended once the watermark has passed its last row by the gap.

    t is a timestamp; a row joins the open group of its key if it lies within the gap of it on either side.
    """
    kind = rows.schema[key].dataType.simpleString()
    gap = pd.Timedelta(seconds=max_gap_seconds)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [(pd.Timestamp(a), pd.Timestamp(b), n) for a, b, n in (state.get[0] if state.exists else [])]
        times = sorted(x for pdf in frames for x in pdf[t])
        merged: list[list] = []
        for a, b, n in sorted([*open_, *((x, x, 1) for x in times)]):
            if merged and a - merged[-1][1] <= gap:
                merged[-1] = [merged[-1][0], max(merged[-1][1], b), merged[-1][2] + n]
            else:
                merged.append([a, b, n])
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        done = [m for m in merged if m[1] + gap < mark]
        left = [m for m in merged if m[1] + gap >= mark]
        if left:
            state.update(([[a.isoformat(), b.isoformat(), n] for a, b, n in left],))
            state.setTimeoutTimestamp(int((left[0][1] + gap).timestamp() * 1000) + 1 if (left[0][1] + gap) > mark else state.getCurrentWatermarkMs() + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(group[0], a, b, n) for a, b, n in done], columns=[key, "first_t", "last_t", "n"])

    marked = rows.select(key, t).withWatermark(t, late)
    return marked.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, first_t timestamp, last_t timestamp, n bigint", "open array<struct<a: string, b: string, n: bigint>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_content(changes: DataFrame, key: str = "path_key", crc: str = "crc", t: str = "t") -> DataFrame:
    """The newest content of every path as a running aggregate, for an update or complete sink."""
    return changes.groupBy(key).agg(F.max_by(crc, t).alias(crc), F.max(t).alias(t))
