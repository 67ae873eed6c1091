"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a Java regex class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder in spark.checkpoint.dir; a local one only where it is unset."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chronoline-checkpoint-"))
    return df.checkpoint(eager=True)


#: A table of keys is broadcast only up to so many rows (16 bytes a row).
BROADCAST_ROWS = 1_000_000


def broadcast_keys(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Counts a narrow table of keys, which should be written out, and marks it for broadcast only where it is small enough."""
    return F.broadcast(keys) if keys.count() <= most else keys


#: Rows of texts that travel to Python at once.
BATCH_ROWS = 2_000


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batches to so many rows: a batch of texts is held several times over, by the JVM and by its Python worker."""
    if not 0 < int(spark.conf.get(ARROW_ROWS, "10000")) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; for rows that are large themselves."""
    before = spark.conf.get(ARROW_ROWS, "10000")
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters kept; for short strings."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column has it; column names do not differ by case alone."""
    used, found = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        found.append(name)
    return found
