"""Projection, filters, limits, positions, folds and buffers over ordered, keyed tables.

Ties: ``order_by`` must be a total order. Nulls: a null predicate counts as false, values are compared
null-safely.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as _reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import keyed_fold
from ..functions.order import Cols, number, over, so_far


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each row, with new or replaced columns."""
    return df.withColumns(columns)


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def tap(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and metrics over all of them once an action has run."""
    seen = Observation(name)
    return df.observe(seen, *(metrics or (F.count(F.lit(1)).alias("rows"),))), seen


def tap_first(df: DataFrame, name: str, order_by: Cols, predicate: Column | None = None) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and the first (matching) one in ``first``."""
    row = F.struct(*df.columns)
    own = F.when(F.coalesce(predicate, F.lit(False)), row) if predicate is not None else row
    order = F.struct(*order_by)
    order = F.when(own.isNotNull(), order)
    seen = Observation(name)
    return df.observe(seen, F.min_by(own, order).alias("first")), seen


def distinct_until_changed(df: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows whose value differs from the one before; a key's first row stays. Equality is transitive, so
    the row before stands for the last one kept."""
    w = over(partition_by, order_by)
    rows = df.withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1))
    return rows.where(~F.col("_same")).drop("_same")


def distinct_until_moved(df: DataFrame, value: str, tolerance: float, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows that differ by more than ``tolerance`` from the last row *kept*; a fold per key. A null or NaN value is kept."""
    place = df.columns.index(value)

    def step(last, row):
        x = row[place]
        stay = last is None or x is None or not abs(x - last) <= tolerance
        return (x, [tuple(row)]) if stay else (last, [])

    return keyed_fold(df, partition_by, order_by, step, lambda: None, df.schema)


def stratify(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for every branch whose rule matches, with the branch's name; one pass over the input."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in rules.items()]))
    return df.withColumn("branch", F.explode(names))


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _reduce(lambda rows, step: rows.transform(step), steps, df)


def rescue(df: DataFrame, error: str, recovered: dict[str, Column], order_by: Cols, partition_by: Cols) -> DataFrame:
    """A key's stream ends at its first error row, whose columns take the recovered values."""
    failed = F.col(error).isNotNull()
    errors = F.sum(failed.cast("int")).over(so_far(partition_by, order_by))
    rows = df.withColumn("_errors", errors).where((F.col("_errors") == 0) | ((F.col("_errors") == 1) & failed))
    fixed = {c: F.when(failed, v).otherwise(F.col(c)) for c, v in recovered.items()}
    return rows.withColumns(fixed | {error: F.lit(None).cast(df.schema[error].dataType)}).drop("_errors")


def take(df: DataFrame, n: int, order_by: Cols, partition_by: Cols = ()) -> DataFrame:
    """The first n rows of each key, or of the table (a partial top-n per task)."""
    if not partition_by:
        return df.orderBy(*order_by).limit(n)
    return number(df, order_by, partition_by, name="_rn").where(F.col("_rn") <= n).drop("_rn")


def skip(df: DataFrame, n: int, order_by: Cols, partition_by: Cols = (), bucket: Column | None = None) -> DataFrame:
    return number(df, order_by, partition_by, bucket, "_rn").where(F.col("_rn") > n).drop("_rn")


def element_at(df: DataFrame, i: int, order_by: Cols, partition_by: Cols = (), bucket: Column | None = None) -> DataFrame:
    """The row at zero-based position i; none if there are fewer."""
    return number(df, order_by, partition_by, bucket, "_rn").where(F.col("_rn") == i + 1).drop("_rn")


def take_while(df: DataFrame, predicate: Column, order_by: Cols, partition_by: Cols = ()) -> DataFrame:
    """Rows before the first that fails. Without keys an aggregate finds the cut and no sort is needed."""
    fails = ~F.coalesce(predicate, F.lit(False))
    if partition_by:
        rows = df.withColumn("_failed", F.max(fails.cast("int")).over(so_far(partition_by, order_by)))
        return rows.where("_failed = 0").drop("_failed")
    cut = df.where(fails).agg(F.min(F.struct(*order_by)).alias("_cut"))
    rows = df.crossJoin(F.broadcast(cut))  # one row
    return rows.where(F.col("_cut").isNull() | (F.struct(*order_by) < F.col("_cut"))).drop("_cut")


def _end(df: DataFrame, pick: Callable, order_by: Cols, partition_by: Cols, predicate: Column | None) -> DataFrame:
    rows = df if predicate is None else df.where(predicate)
    found = rows.groupBy(*partition_by).agg(pick(F.struct(*df.columns), F.struct(*order_by)).alias("_row"))
    return found.where("_row is not null").select("_row.*")


def first(df: DataFrame, order_by: Cols, partition_by: Cols = (), predicate: Column | None = None) -> DataFrame:
    """The first (matching) row of each key; partial aggregation, no sort. No match gives no row."""
    return _end(df, F.min_by, order_by, partition_by, predicate)


def last(df: DataFrame, order_by: Cols, partition_by: Cols = (), predicate: Column | None = None) -> DataFrame:
    return _end(df, F.max_by, order_by, partition_by, predicate)


def single(df: DataFrame) -> dict:
    """The only row of a table, as a dict; an error if it has none or several. Two rows reach the driver at most."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("no value" if not rows else "more than one value")
    return rows[0].asDict()


def settle(df: DataFrame, value: str, quiet: int, most: int | None, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows up to the one that closes the stream: ``quiet`` rows in a row without a change, or ``most`` rows.

    A row changes if it differs from the one before; a key's first row does.
    """
    w = over(partition_by, order_by)
    changed = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    rows = df.withColumn("_rn", F.row_number().over(w)).withColumn("_island", F.sum(changed.cast("int")).over(so_far(partition_by, order_by)))
    in_island = over([*partition_by, "_island"], order_by)
    rows = rows.withColumn("_still", F.row_number().over(in_island) - 1)
    closes = (F.col("_still") >= quiet) if most is None else (F.col("_still") >= quiet) | (F.col("_rn") >= most)
    cut = F.min(F.when(closes, F.col("_rn"))).over(so_far(partition_by, order_by))
    rows = rows.withColumn("_cut", cut)
    return rows.where(F.col("_cut").isNull() | (F.col("_rn") <= F.col("_cut"))).drop("_rn", "_island", "_still", "_cut")


def scan(df: DataFrame, order_by: Cols, partition_by: Cols, **folds: Column) -> DataFrame:
    """Running aggregates, one output per row: each fold is an aggregate such as ``F.sum(x)``; a seed is added by the caller."""
    return df.withColumns({name: agg.over(so_far(partition_by, order_by)) for name, agg in folds.items()})


def scan_with(df: DataFrame, step: Callable, seed: object, value: str, out: str, kind: T.DataType, order_by: Cols, partition_by: Cols) -> DataFrame:
    """A running fold by any function ``step(acc, x)``, in order, per key."""
    place = df.columns.index(value)

    def each(acc, row):
        acc = step(acc, row[place])
        return acc, [(*row, acc)]

    return keyed_fold(df, partition_by, order_by, each, lambda: seed, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def reduce(df: DataFrame, partition_by: Cols, **folds: tuple[Column, object]) -> DataFrame:
    """One row per key; each fold is (aggregate, seed): the seed stands for an empty one. No keys and no rows give the seeds."""
    return df.groupBy(*partition_by).agg(*[F.coalesce(agg, F.lit(seed)).alias(n) for n, (agg, seed) in folds.items()])


def reduce_in_order(df: DataFrame, value: str, seed: Column, step: Callable, order_by: Cols, partition_by: Cols, out: str) -> DataFrame:
    """One value per key by an order-sensitive step on columns."""
    rows = F.array_sort(F.collect_list(F.struct(*order_by, F.col(value).alias("_x"))))
    return df.groupBy(*partition_by).agg(rows.alias("_rows")).select(*partition_by, F.aggregate("_rows", seed, lambda acc, r: step(acc, r["_x"])).alias(out))


def pairwise(df: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """previous and current value from the second row on."""
    w = over(partition_by, order_by)
    rows = df.withColumn("previous", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    return rows.where("_rn > 1").withColumn("current", F.col(value)).drop("_rn")


def in_order(value: str | Column, order_by: Cols) -> Column:
    """Aggregate: the values of a group as an array in order (collect_list alone has none)."""
    x = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*order_by, x.alias("_x")))), lambda s: s["_x"])


def buffer_count(df: DataFrame, n: int, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Chunks of n values per key, a shorter one at the end; n must be positive."""
    if n <= 0:
        raise ValueError("a buffer needs a positive count")
    rows = number(df, order_by, partition_by, name="_rn").withColumn("chunk", F.floor((F.col("_rn") - 1) / n).cast("long"))
    return rows.groupBy(*partition_by, "chunk").agg(in_order(value, order_by).alias("items"))


def retained(df: DataFrame, kind: str, cuts: list[str], order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows of a log after its last clear or trim; folds over the retained log start from there."""
    edges = df.groupBy(*partition_by).agg(F.max(F.when(F.col(kind).isin(cuts), F.struct(*order_by))).alias("_cut"))
    rows = df.join(edges, list(partition_by))
    return rows.where(F.col("_cut").isNull() | (F.struct(*order_by) > F.col("_cut"))).drop("_cut")
