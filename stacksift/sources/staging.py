"""Folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application: local mode without spark.checkpoint.dir.
LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. In local mode, where that is unset, a folder of our own.

    A cluster without the setting is an error: executors would write to their own disks. The session's
    settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in LOCAL:
        LOCAL[application] = tempfile.mkdtemp(prefix="stacksift-")
    return LOCAL[application]


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written_table(df: DataFrame, path: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet and reads it back, so that a lost executor costs a re-read.

    With zstd it takes a fraction of the room of Dataset.checkpoint(), which stores uncompressed rows.
    """
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
