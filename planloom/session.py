"""Session helpers shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the test-suite and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("planloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints and cut tables: ``spark.checkpoint.dir``; a temporary one only in local mode.

    On a cluster the setting names a folder that all executors share, so what is
    written there outlives the executor that wrote it; without the setting a cluster
    session is refused rather than pointed at one machine's disk.  A folder made here
    is deleted when the application ends.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="planloom-checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
        _delete_on_exit(spark, found.get())
    return found.get()


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint (never localCheckpoint); for frames of ids, keys and counts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a compressed table in the checkpoint folder; for frames with a row per record."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _delete_on_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Give ``df`` at least one partition per core when its files make fewer.

    Only the physical layout changes: a scan that already has enough splits is
    returned as it is, without a shuffle.
    """
    if df.isStreaming:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df if have >= want else df.repartition(want)


def bench_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
