"""Scratch folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; it is removed when the application ends.

    Only a local master may go without that setting: executors on other machines don't see a folder of this one.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        master = spark.sparkContext.master
        if not shared and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{(shared or tempfile.gettempdir()).rstrip('/')}/tidemark-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one table of this application."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
