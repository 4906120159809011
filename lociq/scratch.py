"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where none is set (tests)."""
    context = spark.sparkContext
    base = context.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and context.master.split("[")[0] != "local":
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        base = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='lociq-')}"
        spark.conf.set(_SETTING, base)
    return base.rstrip("/")


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete what this process has stored so far, once the results that are read from it are no longer needed; how many folders it was."""
    context = spark.sparkContext
    deleted = 0
    while _WRITTEN:
        path = context._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        deleted += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read from it.

    Cuts the lineage like a reliable checkpoint: a lost executor does not lose the rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
