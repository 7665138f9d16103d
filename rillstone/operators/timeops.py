"""Time operators over rows with a time in milliseconds.

A timer that is due exactly when a row arrives fires first: debounce keeps a row at a gap of ``ms``,
throttle and audit reopen at it, timeout fails at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import Cols, over, so_far
from .basic import in_order


def delay(df: DataFrame, at: str, ms: int) -> DataFrame:
    return df.withColumn(at, F.col(at) + ms)


def debounce(df: DataFrame, at: str, ms: int, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows with no later row within ``ms``, emitted (``emit_at``) that much later; a key's last row is one."""
    later = F.lead(at).over(over(partition_by, order_by))
    return df.withColumn("_next", later).where(F.col("_next").isNull() | (F.col("_next") - F.col(at) >= ms)).withColumn("emit_at", F.col(at) + ms).drop("_next")


def windows(df: DataFrame, at: str, ms: int, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows with ``opened``, the time of the row that opened their window, and ``opens``, whether they did.

    A key's first row opens a window, and so does the first row ``ms`` or more after the opening one. Keys
    are dealt out once and their sorted rows pass as a stream of batches; a search jumps from opening row
    to opening row, and all that is carried on is the last opening time.
    """
    keys = list(partition_by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_open = None, None
        for rows in batches:
            if not len(rows):
                continue
            t = rows[at].to_numpy()
            own = rows[keys].astype(object).where(rows[keys].notna(), None).to_records(index=False).tolist()
            starts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            opened, opens = np.empty(len(t), np.int64), np.zeros(len(t), bool)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                i, now = s, None
                if own[s] == last_key:
                    now, i = last_open, s + int(np.searchsorted(t[s:e], last_open + ms))
                    opened[s:i] = now
                while i < e:
                    now, opens[i] = int(t[i]), True
                    j = max(i + int(np.searchsorted(t[i:e], now + ms)), i + 1)
                    opened[i:j] = now
                    i = j
                last_key, last_open = own[s], now
            yield rows.assign(opened=opened, opens=opens)

    out = T.StructType([*df.schema.fields, T.StructField("opened", T.LongType()), T.StructField("opens", T.BooleanType())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order_by).mapInPandas(run, out)


def throttle(df: DataFrame, at: str, ms: int, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Leading edge: a row is emitted, then rows are ignored for ``ms``."""
    return windows(df, at, ms, order_by, partition_by).where("opens").drop("opened", "opens")


def audit(df: DataFrame, at: str, ms: int, order_by: Cols, partition_by: Cols) -> DataFrame:
    """A row opens a window; at its end (``emit_at``) the latest row is emitted. The pending row of a key's last
    window is flushed at the end of the stream."""
    rows = windows(df, at, ms, order_by, partition_by)
    last = F.coalesce(F.lead("opens").over(over(partition_by, order_by)), F.lit(True))
    return rows.withColumn("_last", last).where("_last").withColumn("emit_at", F.col("opened") + ms).drop("_last", "opened", "opens")


def rate_limit(df: DataFrame, at: str, most: int, ms: int, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Fixed windows that open at the first row after the last one's end. Each row carries allowed, the
    key's dropped count so far, what remains of its window and when that resets."""
    placed = windows(df, at, ms, order_by, partition_by)
    nth = F.row_number().over(over([*partition_by, "opened"], order_by))
    placed = placed.withColumn("_nth", nth).withColumn("allowed", F.col("_nth") <= most).withColumn("remaining", F.greatest(F.lit(0), most - F.col("_nth")))
    placed = placed.withColumn("reset_at", F.col("opened") + ms)
    dropped = F.sum((~F.col("allowed")).cast("long")).over(so_far(partition_by, order_by))
    return placed.withColumn("dropped", dropped).drop("_nth", "opened", "opens")


def timeout(df: DataFrame, at: str, ms: int, order_by: Cols, partition_by: Cols, start: str | None = None) -> DataFrame:
    """Rows up to the first gap of ``ms`` or more; there the key ends with an error row (``error``) at the time
    the timer fired. ``start`` is a column with the time the stream was subscribed, if that counts as a gap."""
    w = over(partition_by, order_by)
    before = F.lag(at).over(w) if start is None else F.coalesce(F.lag(at).over(w), F.col(start))
    rows = df.withColumn("_before", before).withColumn("_late", F.coalesce(F.col(at) - F.col("_before") >= ms, F.lit(False)))
    rows = rows.withColumn("_failed", F.sum(F.col("_late").cast("int")).over(so_far(partition_by, order_by)))
    fine = rows.where("_failed = 0").select(*df.columns, F.lit(None).cast("string").alias("error"))
    message = F.lit(f"timeout: no value within {ms}ms")
    fail = rows.where("_failed = 1 and _late").select(*[
        F.col(c) if c in partition_by else (F.col("_before") + ms).alias(c) if c == at else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns
    ], message.alias("error"))
    return fine.union(fail)


def buffer_time(df: DataFrame, at: str, ms: int, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Tumbling windows from the key's first row on, empty ones included, except after the last row."""
    start = df.groupBy(*partition_by).agg(F.min(at).alias("_start"), F.max(at).alias("_end"))
    windows = start.withColumn("slot", F.explode(F.sequence(F.lit(0), F.floor((F.col("_end") - F.col("_start")) / ms)))).select(*partition_by, "slot")
    slot = F.floor((F.col(at) - F.col("_start")) / ms)
    filled = df.join(start, list(partition_by)).withColumn("slot", slot).groupBy(*partition_by, "slot").agg(in_order(value, order_by).alias("items"))
    out = windows.join(filled, [*partition_by, "slot"], "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(filled.schema["items"].dataType)))


def interval(df: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """Ticks 0, 1, 2, ... every ``step`` from ``start`` up to ``end``, per row."""
    ticks = F.sequence(F.col(start) + step, F.col(end), F.lit(step))
    return df.where(F.col(start) + step <= F.col(end)).select("*", F.posexplode(ticks).alias("tick", "tick_at"))
