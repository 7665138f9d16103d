"""Literal, empty and clock sources as tables with an order column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def of(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """Values in order: seq from 0 and value."""
    return spark.createDataFrame(list(enumerate(values)), f"seq long, value {kind}")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def timer(spark: SparkSession, start_ms: int, ms: int, ticks: int = 1) -> DataFrame:
    """Ticks 0, 1, ... at ``start_ms`` + ms, + 2 ms, ..."""
    return spark.range(ticks).select(F.col("id").alias("tick"), (F.lit(start_ms) + (F.col("id") + 1) * ms).alias("at_ms"))
