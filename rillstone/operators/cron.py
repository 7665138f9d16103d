"""Five-field cron expressions as column predicates and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of minute, hour, day of month, month, day of week (Sunday 0).
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]


def parse(expression: str) -> list[list[int]]:
    """The values that each field allows: lists, ranges, ``*`` and steps."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    out = []
    for text, (low, high) in zip(fields, BOUNDS, strict=True):
        values: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            every = int(step) if step else 1
            if span == "*":
                start, end = low, high
            elif "-" in span:
                start, end = map(int, span.split("-"))
            else:
                start = int(span)
                end = high if step else start
            if every <= 0 or not low <= start <= end <= high:
                raise ValueError(f"bad cron field {text!r}")
            values.update(range(start, end + 1, every))
        out.append(sorted(values))
    return out


def matches(at: Column, expression: str) -> Column:
    """Whether a time matches. If both day fields are restricted either may match, else both must."""
    minute, hour, day, month, weekday = parse(expression)
    fields = expression.split()
    by_day, by_weekday = F.dayofmonth(at).isin(day), (F.dayofweek(at) - 1).isin(weekday)
    days = by_day | by_weekday if fields[2] != "*" and fields[4] != "*" else by_day & by_weekday
    return F.minute(at).isin(minute) & F.hour(at).isin(hour) & F.month(at).isin(month) & days


def calendar(spark: SparkSession, start: str, end: str, expression: str) -> DataFrame:
    """A row per matching minute from ``start`` up to ``end`` (timestamps without zone)."""
    span = spark.range(1).select(F.expr(f"explode(sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{end}', INTERVAL 1 MINUTE))").alias("at"))
    return span.where(matches(F.col("at"), expression))
