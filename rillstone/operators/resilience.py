"""Retry, backoff and breaker policies as columns over attempt counts and event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import Cols, over, so_far


def backoff_ms(kind: str, attempt: Column, initial: int = 0, step: int = 0, factor: int = 2, cap: int | None = None, longest: int = 64) -> Column:
    """Delay before a retry by the attempt's number, from 1; kinds: none, constant, linear, exponential, fibonacci."""
    n = F.greatest(attempt, F.lit(1)) - 1
    if kind == "none":
        return F.lit(0).cast("long") + 0 * n
    if kind == "constant":
        delay = F.lit(initial) + 0 * n
    elif kind == "linear":
        delay = F.lit(initial) + step * n
    elif kind == "exponential":
        delay = F.lit(initial) * F.pow(F.lit(factor), n)
    elif kind == "fibonacci":
        a, b, table = 1, 1, []
        for _ in range(longest):
            table.append(a)
            a, b = b, a + b
        delay = F.lit(initial) * F.get(F.array(*map(F.lit, table)), F.least(n, F.lit(longest - 1)).cast("int"))
    else:
        raise ValueError(f"unknown backoff {kind}")
    return F.least(delay, F.lit(cap)).cast("long") if cap is not None else delay.cast("long")


def should_retry(failed: Column, most: int) -> Column:
    return failed < most


def next_delay_ms(failed: Column, most: int, **policy) -> Column:
    """The delay before the next attempt; null if none follows: number 0 or beyond the most."""
    following = failed + 1
    return F.when((following > 0) & (following <= most), backoff_ms(attempt=following, **policy))


def retry_status(df: DataFrame, kind: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """The state after each key's last event (attempt, retry, success, failure, exhausted); unknown kinds are idle."""
    last = df.groupBy(*partition_by).agg(F.max_by(kind, F.struct(*order_by)).alias("kind"))
    names = {"attempt": "running", "retry": "waiting", "success": "succeeded", "failure": "failed", "exhausted": "exhausted"}
    status = F.lit("idle")
    for k, s in names.items():
        status = F.when(F.col("kind") == k, s).otherwise(status)
    return last.select(*partition_by, status.alias("status"))


def breaker(df: DataFrame, failed: Column, succeeded: Column, threshold: int, at: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """After each row: failures since the last success, whether the breaker is open, and since which failure."""
    rows = df.withColumn("_island", F.sum(F.when(succeeded, 1).otherwise(0)).over(so_far(partition_by, order_by)))
    w = over([*partition_by, "_island"], order_by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum(F.when(failed, 1).otherwise(0)).over(w)).withColumn("_failed_at", F.last(F.when(failed, F.col(at)), ignorenulls=True).over(w))
    rows = rows.withColumn("open", F.col("failures") >= threshold)
    return rows.withColumn("opened_at", F.when(F.col("open"), F.col("_failed_at"))).drop("_island", "_failed_at")
