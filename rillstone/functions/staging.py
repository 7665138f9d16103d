"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs in one process (tests), a local temporary folder is made, one
    per application; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return base.rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """The folder of what this application has staged."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage and computes a table once that is used several times. The file survives
    the loss of executors, unlike cached blocks. Results read staged tables until they are written
    themselves; then ``clear_staged`` frees the space.
    """
    path = f"{staged_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of at most so many rows (of a few bytes each) is broadcast; above it the join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if it has at most ``rows`` rows, else leave it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables that this application has staged. Results that were not written before can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
