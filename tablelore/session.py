"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, name: str = "tablelore", shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and the benchmark. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def cluster_settings(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a session that profiles this much data.

    The widest shuffle carries the distinct cells, at worst about as many bytes as the input; partitions are sized so that each fits in
    a task's memory, and adaptive execution merges them where cells turn out to repeat.
    """
    partitions = max(input_bytes // partition_bytes, 200)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for frames that are read back; a folder of our own only in a local session."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablelore-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder as Parquet and read back: later plans start from it and read only the columns they need, and a lost
    executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
