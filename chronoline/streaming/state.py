"""Settings of stateful processors."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state with several state variables needs column families, so a RocksDB store; it holds state outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
