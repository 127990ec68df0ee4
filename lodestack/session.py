"""Session settings that the results rely on; sizes of partitions stay with the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
}


def session(name: str = "lodestack", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session in one process (tests, a laptop) gets a temporary folder where it names none; a cluster must name one.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):  # local-cluster has several processes
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-shared-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def _located(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut, and a lost executor costs no more than its tasks. It goes with drop_written(), or when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/lodestack/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _located(df.sparkSession, path)
    system.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gone_at_the_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    system, at = _located(spark, path)
    system.deleteOnExit(at)


def drop_written(df: DataFrame) -> None:
    """Deletes what written() wrote for df, which must not be read afterwards."""
    for file in df.inputFiles()[:1]:
        system, at = _located(df.sparkSession, file)
        system.delete(at.getParent(), True)
