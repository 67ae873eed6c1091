"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronoline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sorts of a task hold all its rows, so tasks grow in number rather than in size.
ROWS_A_TASK = 250_000


def dealt_by_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """df, a table as it is read, dealt by key to so many tasks that none has many rows more than that; small tables are left to Spark."""
    tasks = -(-df.count() // ROWS_A_TASK)
    return df if tasks <= 1 else df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir, as this session uses it; a local one only where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chronoline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().removeprefix("file:").replace("///", "/", 1)


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes a step that is read more than once to the shared folder in spark.checkpoint.dir; a local one only where it is unset."""
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)
