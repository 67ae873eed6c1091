"""A content registry as keyed state: what to do with files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronoline.streaming.state import use_rocksdb

class KnownContent(StatefulProcessor):
    """One path a key: what to do with a file by the content on record there before, which it then replaces. Entries not touched for the TTL, if there is one, expire."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "crc string", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.known.update((str(initialState["crc"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.get()[0] if self.known.exists() else None
        out = []
        for pdf in rows:
            for crc, other, saved in zip(pdf["crc"], pdf["other"], pdf["saved"]):
                moved = not pd.isna(other) and other != key[0] and known != crc
                action = "skip" if known == crc else "move" if moved else "redo" if known is not None else "record" if saved else "new"
                out.append((key[0], crc, action, other if moved else None))
                known = crc
        self.known.update((known,))
        yield pd.DataFrame(out, columns=["path_key", "crc", "action", "moved_from"])

    def close(self) -> None:
        pass


def stream_registry_actions(files: DataFrame, registry: DataFrame, backups: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming files(path_key, crc), batch registry(path_key, crc) and backups(path_key) -> path_key, crc, action, moved_from, as listings.registry_actions, as files arrive.

    The registry seeds the state by path on the first run; a path that comes again is judged by the content it came with before. Where else a content is on record is looked
    up in the registry as given, as in the batch form, so actions do not depend on how files fall into batches as long as a path comes once. Rows
    without a path or content are left out. A TTL works by the clock: Spark then keeps starting empty batches, so with a trigger that ends by itself set
    spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    use_rocksdb(files.sparkSession)
    seed = registry.where("path_key is not null and crc is not null").select("path_key", "crc")
    there = seed.groupBy("crc").agg(F.max("path_key").alias("other"))
    saved = backups.select("path_key").distinct().withColumn("saved", F.lit(True))
    arriving = files.where("path_key is not null and crc is not null").select("path_key", "crc").join(there, "crc", "left").join(saved, "path_key", "left")
    keyed = arriving.select("path_key", "crc", "other", F.coalesce("saved", F.lit(False)).alias("saved")).groupBy("path_key")
    return keyed.transformWithStateInPandas(KnownContent(ttl_ms), "path_key string, crc string, action string, moved_from string", "Append", "ProcessingTime" if ttl_ms else "None", seed.groupBy("path_key"))
