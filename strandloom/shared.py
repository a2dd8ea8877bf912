"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; set here only where it is unset, as in tests, and then emptied at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/strandloom/{spark.sparkContext.applicationId}"
    found = "/tmp/checkpoints/strandloom"
    spark.conf.set("spark.checkpoint.dir", found)
    own = f"{found}/strandloom/{spark.sparkContext.applicationId}"
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, label: str) -> DataFrame:
    """written(), for tables that grow with the input and are joined many times: no join sends them to the driver to be broadcast."""
    return written(df, label).hint("merge")


def stage(spark: SparkSession, folder: str | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name in folder, made only if no whole one is there; without a folder, a new table in the shared one.

    Spark's mark of success tells a whole table from what a lost run left, which is overwritten.
    """
    if folder is None:
        return written(make(), name)
    path = f"{folder.rstrip('/')}/{name}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
