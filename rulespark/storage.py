"""Tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where the setting is absent, a fresh temporary one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave and that no plan reads any more."""
    for table in tables:
        jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
