"""Total orders on tables: windows, positions in a global order, latest values, as-of unions.

Every operator takes ``order_by`` (a list of columns that order rows totally) and ``partition_by``.
Rows are never pulled to one task: a global order is built from counts per bucket of the order column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Cols = Sequence[str]


def over(keys: Cols, order: Cols) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: Cols, order: Cols) -> WindowSpec:
    """From the first row of the key to this one."""
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def latest(col: Column | str, keys: Cols, order: Cols) -> Column:
    """The last non-null value up to this row."""
    return F.last(col, ignorenulls=True).over(so_far(keys, order))


#: Buckets whose counts are summed up in one task.
SPAN = 1024


def number(df: DataFrame, order: Cols, keys: Cols = (), bucket: Column | None = None, name: str = "rn") -> DataFrame:
    """Position of each row, from 1: within its key, or in the whole table if there are no keys.

    Without keys a ``bucket`` is needed; with keys it keeps a key of many rows from being one task. See ``running_sum``.
    """
    if bucket is None and keys:
        return df.withColumn(name, F.row_number().over(over(keys, order)))
    return running_sum(df, F.lit(1), order, keys, bucket, name)


def running_sum(df: DataFrame, value: Column, order: Cols, keys: Cols = (), bucket: Column | None = None, name: str = "total") -> DataFrame:
    """The sum of ``value`` up to and with each row, within its key or in the whole table, see ``running_sums``."""
    return running_sums(df, {name: value}, order, keys, bucket)


def running_sums(df: DataFrame, values: dict[str, Column], order: Cols, keys: Cols = (), bucket: Column | None = None) -> DataFrame:
    """Sums, by name, up to and with each row, within its key or in the whole table.

    ``bucket`` must be a number that never falls as rows go on in order, with few rows per value (the
    hour of a time, say): sums run within buckets, ahead of which goes a row with those of earlier buckets. These are
    summed up within spans of SPAN buckets and over spans, so that one task sees a sum per span at most.
    The input is read twice: stage it where it is costly, and where several such sums follow each other.
    """
    return _running(df, values, order, keys, bucket, F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))


def running_max(df: DataFrame, values: dict[str, Column], order: Cols, keys: Cols = (), bucket: Column | None = None, earlier: str = "") -> DataFrame:
    """The greatest values, by name, up to and with each row, nulls passed over; see ``running_sums``.

    A struct that begins with the order makes it the last value so far. With a suffix ``earlier``, columns
    of that ending have the greatest values before each row.
    """
    return _running(df, values, order, keys, bucket, F.max, F.greatest, earlier)


def _running(df: DataFrame, values: dict[str, Column], order: Cols, keys: Cols, bucket: Column | None, agg: Callable[[str], Column], merge: Callable[[Column, Column], Column], earlier: str = "") -> DataFrame:
    """``agg`` up to each row; ``merge`` puts together what is before and what is own, either may be null.

    What is before a bucket comes as a row ahead of it, so that rows are shuffled once and never joined.
    """
    if bucket is None:
        if not keys:
            raise ValueError("a global order needs a bucket column")
        made = df.withColumns({f"_x{i}": v for i, v in enumerate(values.values())})
        ends = {"": so_far(keys, order)} | ({earlier: over(keys, order).rowsBetween(Window.unboundedPreceding, -1)} if earlier else {})
        return made.withColumns({name + end: agg(f"_x{i}").over(w) for end, w in ends.items() for i, name in enumerate(values)}).drop(*[f"_x{i}" for i in range(len(values))])
    keys, ns = list(keys), range(len(values))
    rows = df.withColumns({"_bucket": bucket.cast("double")} | {f"_x{i}": v for i, v in enumerate(values.values())})
    sums = rows.groupBy(*keys, "_bucket").agg(*[agg(f"_x{i}").alias(f"_n{i}") for i in ns]).withColumn("_span", F.floor(F.col("_bucket") / SPAN))
    before = lambda i, part, by: agg(f"_n{i}").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    spans = sums.groupBy(*keys, "_span").agg(*[agg(f"_n{i}").alias(f"_n{i}") for i in ns]).withColumns({f"_s{i}": before(i, keys, "_span") for i in ns})
    spans = spans.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_span").alias("_s__span"), *[f"_s{i}" for i in ns])
    sums = sums.withColumns({f"_o{i}": before(i, [*keys, "_span"], "_bucket") for i in ns})
    sums = sums.join(spans, _all([F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in [*keys, "_span"]]))
    sums = sums.select(*keys, "_bucket", *[merge(F.col(f"_s{i}"), F.col(f"_o{i}")).alias(f"_b{i}") for i in ns], F.lit(True).alias("_ahead"))
    both = rows.withColumn("_ahead", F.lit(False)).unionByName(sums, allowMissingColumns=True)
    inside = over([*keys, "_bucket"], [F.desc("_ahead"), *order])
    ends = {"": inside.rowsBetween(Window.unboundedPreceding, 0)} | ({earlier: inside.rowsBetween(Window.unboundedPreceding, -1)} if earlier else {})
    made = both.withColumns({f"_b{i}": F.first(f"_b{i}").over(ends[""]) for i in ns} | {f"_in{i}{end}": agg(f"_x{i}").over(w) for end, w in ends.items() for i in ns})
    made = made.where("NOT _ahead").withColumns({name + end: merge(F.col(f"_b{i}"), F.col(f"_in{i}{end}")) for end in ends for i, name in enumerate(values)})
    return made.drop("_bucket", "_ahead", *[f"{c}{i}" for c in ("_x", "_b") for i in ns], *[f"_in{i}{end}" for end in ends for i in ns])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def tagged_union(sides: dict[str, DataFrame], columns: Cols) -> DataFrame:
    """Rows of several inputs with a ``side`` column; columns an input lacks are null."""
    out = None
    for side, df in sides.items():
        own = df.select(*columns_of(df, columns)).withColumn("side", F.lit(side))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def columns_of(df: DataFrame, columns: Cols) -> list[str]:
    return [c for c in columns if c in df.columns]
