"""Tables in the folder that all executors share: what is used twice is written once, and survives lost executors."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a task that groups by keys of which nearly every row has its own: adding up before the shuffle would hold them all.
ROWS = 1 << 18


#: Rows of a task that computes much for each row (0.1 ms).
COSTLY_ROWS = 1 << 15


def tasks(df: DataFrame, rows: int = ROWS) -> int:
    """Tasks for df, so that none has more than about so many rows at any size."""
    return max(1, math.ceil(df.count() / rows))


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """df dealt out by keys to so many tasks; grouping by these keys, or more, then needs no other shuffle."""
    return df.repartition(tasks(df, rows), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; in local mode one is made where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own(spark)}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written there; DataFrames that read it are of no use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder, and read again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
