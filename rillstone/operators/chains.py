"""Snapshot chains of collections: the state at every so many changes, as a persisted collection writes its snapshot frames.

A chain has collection, cursor (the seq of the last change in it) and the rows of ``collections``' snapshot of the kind, for
each point of each collection. Entries are alive from one change to another, so each tells the points it is in; no
change is replayed per point. A chain goes on after a restore: from a snapshot at a cursor and later changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import keyed_fold
from ..functions.order import over, running_max, running_sum
from ..functions.staging import stage
from . import collections
from .collections import PER_BUCKET, C


def _points(rows: DataFrame, every: int, columns: list[str]) -> DataFrame:
    """Rows (``_from`` and ``_to``, numbers of points) once per point in which they are alive."""
    if every <= 0:
        raise ValueError("a snapshot is made after a positive number of changes")
    alive = rows.where("_from <= _to").withColumn("_p", F.explode(F.sequence("_from", "_to")))
    return alive.select(*C, (F.col("_p") * every - 1).cast("long").alias("cursor"), *columns)


def _first(every: int):
    """The first point that has a change."""
    return F.greatest(F.floor(F.col("seq") / every) + 1, F.lit(1)).cast("long")


def _keyed(changes: DataFrame, every: int, key: str, columns: list[str]) -> DataFrame:
    rows = stage(running_sum(stage(changes, "chain-changes"), F.when(F.col("kind") == "clear", 1).otherwise(0), ["seq"], C, F.floor(F.col("seq") / PER_BUCKET), "_era"), "chain-eras")
    ends = rows.groupBy(*C).agg(F.max("seq").alias("_last"))
    cuts = rows.where("kind = 'clear'").select(*C, (F.col("_era") - 1).alias("_era"), F.col("seq").alias("_cut"))
    keyed = rows.where("kind <> 'clear'")
    if key == "primary":
        keyed = keyed.withColumn(key, F.explode(F.when(F.col("kind") == "deleteMany", F.col("primaries")).otherwise(F.array(key))))
    keyed = keyed.withColumn("_next", F.lead("seq").over(over([*C, "_era", key], ["seq"]))).where(F.col("kind").isin("set", "upsert"))
    keyed = keyed.join(cuts, [*C, "_era"], "left").join(ends, C)
    until = F.coalesce(F.least("_next", "_cut"), F.col("_last") + 1)  # of two deaths the first; nulls are passed over
    return _points(keyed.withColumns({"_from": _first(every), "_to": F.floor(until / every).cast("long")}), every, [key, *columns])


def map_chain(changes: DataFrame, every: int) -> DataFrame:
    """collection, cursor, k and v of maps at every point."""
    return _keyed(changes, every, "k", ["v"])


def index_chain(changes: DataFrame, every: int) -> DataFrame:
    """collection, cursor, primary, secondary and value of indexes at every point."""
    return _keyed(changes, every, "primary", ["secondary", "value"])


def log_chain(changes: DataFrame, every: int) -> DataFrame:
    """collection, cursor, position and value of logs at every point before the change at which a log is found at fault.

    A value is alive up to the last point of its era whose head is not past it; heads never go back.
    """
    rows = collections._log_lengths(changes)
    stop = collections._first_errors(rows).select(F.col("collection").alias("_of"), F.col("seq").alias("_stop"))
    rows = stage(rows.join(stop, F.col("collection") == F.col("_of"), "left").where("_stop IS NULL OR seq < _stop").drop("_of", "_stop"), "chain-lengths")
    points = rows.where((F.col("seq") + 1) % every == 0).select(*C, "_era", ((F.col("seq") + 1) / every).cast("long").alias("_p"), (F.col("_added") - F.col("_length")).cast("long").alias("_head"))
    points = stage(points, "chain-points")
    values = F.when(F.col("kind") == "append", F.array("value")).otherwise(F.col("values"))
    items = rows.where("_size > 0").select(*C, "_era", "seq", (F.col("_added") - F.col("_size")).alias("_start"), F.posexplode(values).alias("_i", "value"))
    items = items.select(*C, "_era", "seq", "value", (F.col("_start") + F.col("_i")).cast("long").alias("_at"))
    both = points.select(*C, "_era", "_p", F.col("_head").alias("_at")).unionByName(items, allowMissingColumns=True).withColumn("_item", F.col("_p").isNull())
    both = running_max(stage(both, "points-and-values"), {"_to": F.col("_p")}, ["_at", "_item", "seq"], [*C, "_era"], F.floor(F.col("_at") / PER_BUCKET))
    alive = _points(both.where("_item").withColumn("_from", _first(every)), every, ["value", "_at"])
    heads = points.select(*C, (F.col("_p") * every - 1).alias("cursor"), "_head")
    return alive.join(heads, [*C, "cursor"]).select(*C, "cursor", (F.col("_at") - F.col("_head")).alias("position"), "value")


def list_chain(changes: DataFrame, every: int) -> DataFrame:
    """As ``log_chain``, for lists: each is replayed once, in order, and written down at its points."""
    if every <= 0:
        raise ValueError("a snapshot is made after a positive number of changes")
    names = changes.columns

    def step(state, row):
        xs, stopped = state
        r = dict(zip(names, row, strict=True))
        stopped = stopped or collections.list_fault(xs, r) is not None
        if stopped:
            return (xs, True), []
        collections.list_apply(xs, r)
        point = r["seq"] >= 0 and (r["seq"] + 1) % every == 0
        return (xs, False), [(r["collection"], r["seq"], i, x) for i, x in enumerate(xs)] if point else []

    kind = lambda c: changes.schema[c].dataType.simpleString()
    return keyed_fold(changes, C, ["seq"], step, lambda: ([], False), f"collection {kind('collection')}, cursor long, position long, value {kind('value')}")


CHAINS = {"map": map_chain, "index": index_chain, "log": log_chain, "list": list_chain}


def continued(kind: str, snapshot: DataFrame, changes: DataFrame, cursors: DataFrame, every: int) -> DataFrame:
    """The points after a restore, from a snapshot of each collection at its cursor (collection, cursor) and the changes after it."""
    later = changes.join(cursors, C).where(F.col("seq") > F.col("cursor")).drop("cursor")
    if kind == "map":
        base = snapshot.join(cursors, C).select(*C, F.col("cursor").alias("seq"), F.lit("set").alias("kind"), "k", "v")
        rows = base.unionByName(later.select(*base.columns))
    elif kind == "index":
        base = snapshot.join(cursors, C).select(*C, F.col("cursor").alias("seq"), F.lit("upsert").alias("kind"), "primary", "secondary", "value")
        rows = base.unionByName(later, allowMissingColumns=True)
    else:
        rows = collections._positions_first(snapshot, changes, cursors)
    return CHAINS[kind](rows, every).join(cursors.withColumnRenamed("cursor", "_base"), C).where("cursor > _base").drop("_base")
