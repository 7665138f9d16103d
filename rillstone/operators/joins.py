"""Multi-input operators: merges, zips, latest-value and as-of joins, races, notifiers and mapped inner streams.

Rows of different inputs with equal order values form one wave and are seen together. As-of joins are a
union and one window: one shuffle by key, never a range join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import Cols, latest, number, over, so_far, tagged_union
from .basic import in_order


def merge(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs with the number of their input; the order column interleaves them."""
    out = None
    for i, df in enumerate(inputs):
        own = df.withColumn("source", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def concat(*inputs: DataFrame, name: str = "phase") -> DataFrame:
    """All of the first input, then all of the next: order by (phase, own order)."""
    out = None
    for i, df in enumerate(inputs):
        own = df.withColumn(name, F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def zip_rows(left: DataFrame, right: DataFrame, order_by: tuple[Cols, Cols], partition_by: Cols, buckets: tuple[Column, Column] | None = None) -> DataFrame:
    """The i-th row of one side with the i-th of the other; the shorter side ends it."""
    a = number(left, order_by[0], partition_by, buckets and buckets[0], "rn")
    b = number(right, order_by[1], partition_by, buckets and buckets[1], "rn")
    return a.join(b, [*partition_by, "rn"])


def combine_latest(sides: dict[str, DataFrame], value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """One row per wave with the latest value of every input, once all have delivered one."""
    rows = tagged_union(sides, [*partition_by, *order_by, value])
    waves = rows.groupBy(*partition_by, *order_by).agg(*[F.max(F.when(F.col("side") == s, F.col(value))).alias(f"_{s}") for s in sides])
    out = waves.select(*partition_by, *order_by, *[latest(f"_{s}", partition_by, order_by).alias(s) for s in sides])
    return out.dropna(subset=list(sides))


def with_latest_from(primary: DataFrame, secondary: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Primary rows with the latest value of the secondary (``other``), same wave included.

    Rows before the first secondary row wait for it and are paired with it; a key without any gives no row.
    """
    marked = primary.withColumn("_first", F.lit(1))
    other = secondary.select(*partition_by, *order_by, F.col(value).alias("other"), F.lit(0).alias("_first"))
    rows = marked.unionByName(other, allowMissingColumns=True)
    w = over(partition_by, [*order_by, "_first"])
    whole = Window.partitionBy(*partition_by).orderBy(*order_by, "_first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.last("other", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = F.coalesce(before, F.first("other", ignorenulls=True).over(whole))
    return rows.withColumn("other", found).where((F.col("_first") == 1) & F.col("other").isNotNull()).drop("_first")


def race(sides: list[DataFrame], order_by: Cols, partition_by: Cols) -> DataFrame:
    """Rows of the input whose first row comes first, per key; the lower input wins a tie."""
    rows = merge(*sides)
    start = rows.groupBy(*partition_by).agg(F.min(F.struct(*order_by, "source")).alias("_first"))
    winner = start.select(*partition_by, F.col("_first.source").alias("source"))
    return rows.join(winner, [*partition_by, "source"])


def take_until(source: DataFrame, notifier: DataFrame, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Source rows strictly before the key's first notifier; all rows of a key without one."""
    cut = notifier.groupBy(*partition_by).agg(F.min(F.struct(*order_by)).alias("_cut"))
    rows = source.join(cut, list(partition_by), "left")
    return rows.where(F.col("_cut").isNull() | (F.struct(*order_by) < F.col("_cut"))).drop("_cut")


def valve(source: DataFrame, control: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Source values while the latest control (``open``) is true, same wave included; when a control opens
    in a wave without a source value, the latest source value is emitted again. No control means closed."""
    rows = tagged_union({"source": source, "control": control}, [*partition_by, *order_by, value, "open"])
    waves = rows.groupBy(*partition_by, *order_by).agg(F.max(F.when(F.col("side") == "source", F.col(value))).alias("_x"), F.max("open").alias("_open"))
    state, held = latest("_open", partition_by, order_by), latest("_x", partition_by, order_by)
    out = waves.withColumn("_state", state).withColumn("_held", held)
    emitted = F.when(F.col("_state") & F.col("_x").isNotNull(), F.col("_x")).when(F.col("_open"), F.col("_held"))
    return out.withColumn(value, emitted).where(F.col(value).isNotNull()).select(*partition_by, *order_by, value)


def sample(source: DataFrame, notifier: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """At each notifier the latest source value, same wave included; nothing before the first."""
    src = source.select(*partition_by, *order_by, F.col(value).alias("_x"), F.lit(0).alias("_side"))
    hit = notifier.select(*partition_by, *order_by, F.lit(1).alias("_side"))
    rows = src.unionByName(hit, allowMissingColumns=True)
    found = F.last("_x", ignorenulls=True).over(so_far(partition_by, [*order_by, "_side"]))
    return rows.withColumn(value, found).where((F.col("_side") == 1) & F.col(value).isNotNull()).drop("_x", "_side")


def buffer(source: DataFrame, notifier: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """At each notifier (``flush`` numbers them from 0) the source values since the one before, same wave
    included, which may be none; what is left at the end follows if it is not empty."""
    src = source.select(*partition_by, *order_by, F.col(value).alias("_x"), F.lit(0).alias("_side"))
    hit = notifier.select(*partition_by, *order_by).distinct().withColumn("_side", F.lit(1))
    rows = src.unionByName(hit, allowMissingColumns=True)
    w = over(partition_by, [*order_by, "_side"]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("flush", F.coalesce(F.sum("_side").over(w), F.lit(0)))
    keep = F.when(F.col("_side") == 0, F.struct(*order_by, F.col("_x")))
    lists = F.transform(F.array_sort(F.collect_list(keep)), lambda s: s["_x"])
    return rows.groupBy(*partition_by, "flush").agg(lists.alias("items"), F.max("_side").alias("flushed")).where((F.col("flushed") == 1) | (F.size("items") > 0)).drop("flushed")


def switch_map(outer: DataFrame, inner: DataFrame, outer_id: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Inner rows with the outer row that is live: the latest at or before them; an inner row in the wave of
    a new outer row belongs to that one."""
    out = outer.select(*partition_by, *order_by, F.col(outer_id).alias("outer_id"), F.lit(0).alias("_side"))
    rows = inner.withColumn("_side", F.lit(1)).unionByName(out, allowMissingColumns=True)
    live = F.last("outer_id", ignorenulls=True).over(so_far(partition_by, [*order_by, "_side"]))
    return rows.withColumn("outer_id", live).where((F.col("_side") == 1) & F.col("outer_id").isNotNull()).drop("_side")


def merge_map(outer: DataFrame, items: Column, name: str = "item", concurrent: int | None = None) -> DataFrame:
    """All inner values of all outer rows, with their position; ``concurrent`` limits no rows, zero is an error."""
    if concurrent is not None and concurrent <= 0:
        raise ValueError("concurrent must be positive")
    return outer.select("*", F.posexplode(items).alias("inner_pos", name))


def exhaust_map(outer: DataFrame, start: str, end: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    """Outer rows that begin when no inner stream is live: greedy choice of intervals [start, end).

    Keys are dealt out once and their sorted rows pass as a stream of batches; only the end of the last
    row taken is carried on.
    """
    keys = list(partition_by)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, None
        for rows in batches:
            own = rows[keys].astype(object).where(rows[keys].notna(), None).to_records(index=False).tolist()
            kept = []
            for key, s, e in zip(own, rows[start], rows[end], strict=True):
                take = key != last or s >= free
                kept.append(take)
                last, free = key, e if take else free
            yield rows[kept]

    return outer.repartition(*keys).sortWithinPartitions(*keys, *order_by).mapInPandas(pick, outer.schema)


def repeat(df: DataFrame, n: int) -> DataFrame:
    """n rounds of the rows, in sequence: order by (round, own order)."""
    if n <= 0:
        raise ValueError("repeat needs a positive count")
    return df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def collected(df: DataFrame, value: str, order_by: Cols, partition_by: Cols) -> DataFrame:
    return df.groupBy(*partition_by).agg(in_order(value, order_by).alias("items"))
