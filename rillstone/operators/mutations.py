"""Calls on collections as change rows: what each mutation changes depends on the collection as it is by then.

Mutation rows have ``collection``, ``ord`` and ``op``. A change row has a dense ``seq`` per collection from 0, the
``ord`` that made it and ``kind``; calls that change nothing make none. Folding the changes (``collections``) gives
what replaying the calls gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import keyed_fold
from ..functions.order import number, over, running_sum
from ..functions.staging import stage
from .collections import PER_BUCKET, C


def _numbered(changes: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    rows = number(stage(changes, "mutation-changes"), order, C, F.floor(F.col("ord") / PER_BUCKET), "_n")
    return rows.select("collection", (F.col("_n") - 1).cast("long").alias("seq"), "ord", *columns)


def _keyed(mutations: DataFrame, items: Column, puts: str, key: str) -> tuple[DataFrame, DataFrame]:
    """An item per key that a call touches, with ``_live``, whether the key is there by then, and ``_before``, the item
    that put it there; and the clears of collections that hold something, with ``count``."""
    rows = mutations.select("collection", "ord", "op", F.posexplode(items).alias("_i", "item"))
    bucket = F.floor(F.col("ord") / PER_BUCKET)
    rows = stage(rows, "mutation-items")
    rows = stage(running_sum(rows, F.when(F.col("op") == "clear", 1).otherwise(0), ["ord", "_i"], C, bucket, "_era"), "mutation-eras")
    keyed = rows.where("op <> 'clear'").withColumn("_put", F.col("op").startswith(puts)).withColumn(key, F.col(f"item.{key}"))
    w = over([*C, "_era", key], ["ord", "_i"])
    keyed = keyed.withColumns({"_live": F.coalesce(F.lag("_put").over(w), F.lit(False)), "_before": F.lag("item").over(w)})
    step = F.when(F.col("_put") & ~F.col("_live"), 1).when(~F.col("_put") & F.col("_live"), -1).otherwise(0)
    sizes = keyed.groupBy(*C, (F.col("_era") + 1).alias("_era")).agg(F.sum(step).alias("count"))
    clears = rows.where("op = 'clear'").join(sizes, [*C, "_era"]).where("count > 0")
    return keyed.where("_put OR _live"), clears


def map_changes(mutations: DataFrame) -> DataFrame:
    """Changes of maps: k, v, previous and count beside kind (set, delete, clear).

    Ops: set (k, v), set_many (entries: array of structs k and v), delete (k), delete_many (keys) and clear. Every entry
    set is a change; a delete is one if its key is there, and tells what stood there; a clear of an empty map is none.
    """
    item = mutations.schema["entries"].dataType.elementType
    at = lambda k, v: F.struct(k.cast(item["k"].dataType).alias("k"), v.cast(item["v"].dataType).alias("v"))
    none = F.lit(None)
    items = (
        F.when(F.col("op") == "set", F.array(at(F.col("k"), F.col("v")))).when(F.col("op") == "set_many", F.col("entries"))
        .when(F.col("op") == "delete", F.array(at(F.col("k"), none))).when(F.col("op") == "delete_many", F.transform("keys", lambda k: at(k, none)))
        .when(F.col("op") == "clear", F.array(at(none, none)))
    )
    keyed, clears = _keyed(mutations, items, "set", "k")
    long = F.lit(None).cast("long")
    made = keyed.select("collection", "ord", "_i", F.when(F.col("_put"), "set").otherwise("delete").alias("kind"), "k", F.when(F.col("_put"), F.col("item.v")).alias("v"), F.when(~F.col("_put"), F.col("_before.v")).alias("previous"), long.alias("count"))
    gone = clears.select("collection", "ord", "_i", F.lit("clear").alias("kind"), F.col("item.k").alias("k"), F.col("item.v").alias("v"), F.col("item.v").alias("previous"), "count")
    return _numbered(made.union(gone), ["ord", "_i"], ["kind", "k", "v", "previous", "count"])


def index_changes(mutations: DataFrame) -> DataFrame:
    """Changes of indexes: primary, secondary, value, primaries and count beside kind (upsert, delete, deleteMany, clear).

    Ops: upsert (primary, secondary, value), delete (primary), delete_many (keys) and clear. A delete_many is one change
    with the keys that were there, each once; none if none was.
    """
    at = lambda p, s, v: F.struct(p.alias("primary"), s.alias("secondary"), v.alias("value"))
    kinds = {c: mutations.schema[c].dataType for c in ("primary", "secondary", "value")}
    none = {c: F.lit(None).cast(t) for c, t in kinds.items()}
    items = (
        F.when(F.col("op") == "upsert", F.array(at(*map(F.col, kinds)))).when(F.col("op") == "delete", F.array(at(F.col("primary"), none["secondary"], none["value"])))
        .when(F.col("op") == "delete_many", F.transform("keys", lambda k: at(k.cast(kinds["primary"]), none["secondary"], none["value"]))).when(F.col("op") == "clear", F.array(at(*none.values())))
    )
    keyed, clears = _keyed(mutations, items, "upsert", "primary")
    many = F.col("op") == "delete_many"
    out = ["collection", "ord", "_i", "kind", "primary", "secondary", "value", "primaries", "count"]
    no_keys, no_count = F.lit(None).cast(T.ArrayType(kinds["primary"])), F.lit(None).cast("long")
    one = keyed.where(~many).select("collection", "ord", "_i", F.when(F.col("_put"), "upsert").otherwise("delete").alias("kind"), "primary", "item.secondary", "item.value").withColumns({"primaries": no_keys, "count": no_count})
    gone = keyed.where(many).groupBy("collection", "ord").agg(F.sort_array(F.collect_list(F.struct("_i", "primary"))).alias("_gone"))  # the keys of one call
    gone = gone.withColumns({"_i": F.lit(0), "kind": F.lit("deleteMany"), "primaries": F.transform("_gone", lambda g: g["primary"]), "count": no_count} | none)
    empty = clears.withColumns({"kind": F.lit("clear"), "primaries": no_keys} | none)
    return _numbered(one.select(out).union(gone.select(out)).union(empty.select(out)), ["ord", "_i"], out[3:])


def _sequence(mutations: DataFrame, max_size: int | None, step) -> DataFrame:
    """Changes of ordered collections: ``step(items, call)`` changes the items and gives changes or an error; capacity
    trims follow. Each collection is one stream of calls."""
    if max_size is not None and max_size <= 0:
        raise ValueError("max_size must be a positive integer")
    names = mutations.columns
    value = mutations.schema["value"].dataType

    def each(state, row):
        items, seq = state
        made = step(items, dict(zip(names, row, strict=True)))
        if max_size is not None and (over_ := items.length() - max_size) > 0:
            items.trim(over_)
            made = [*made, ("trimHead", None, None, None, over_, None, None)]
        out = []
        for change in made:
            failed = change[0] == "error"
            out.append((row[names.index("collection")], None if failed else seq, row[names.index("ord")], *change))
            seq += not failed
        return (items, seq), out

    kinds = f"collection {mutations.schema['collection'].dataType.simpleString()}, seq long, ord long, kind string, `index` long, value {value.simpleString()}, values array<{value.simpleString()}>, n long, count long, error string"
    return keyed_fold(mutations, C, ["ord"], each, lambda: (step.empty(), 0), kinds)


class _Length:
    """A log as far as its changes need it: its length."""

    def __init__(self):
        self.n = 0

    def length(self):
        return self.n

    def trim(self, n):
        self.n -= n


class _Items(list):
    def length(self):
        return len(self)

    def trim(self, n):
        del self[:n]


def _log_call(log: _Length, c: dict) -> list[tuple]:
    op, values = c["op"], c["values"] or []
    if op == "append":
        log.n += 1
        return [("append", None, c["value"], None, None, None, None)]
    if op == "append_many" and values:
        log.n += len(values)
        return [("appendMany", None, None, values, None, None, None)]
    if op == "trim_head" and (n := min(c["n"] or 0, log.n)) > 0:
        log.n -= n
        return [("trimHead", None, None, None, n, None, None)]
    if op == "clear" and log.n:
        n, log.n = log.n, 0
        return [("clear", None, None, None, None, n, None)]
    return []


def _list_call(items: _Items, c: dict) -> list[tuple]:
    op, at, values = c["op"], c["index"], c["values"] or []
    error = lambda text: [("error", c["index"], None, None, None, None, text)]
    if op == "append":
        items.append(c["value"])
        return [("append", None, c["value"], None, None, None, None)]
    if op == "append_many" and values:
        items.extend(values)
        return [("appendMany", None, None, values, None, None, None)]
    if op in ("insert", "insert_many"):
        if at is None or not 0 <= at <= len(items):
            return error("insert out of bounds")
        items[at:at] = [c["value"]] if op == "insert" else values
        if op == "insert":
            return [("insert", at, c["value"], None, None, None, None)]
        return [("insertMany", at, None, values, None, None, None)] if values else []
    if op == "pop":
        at = -1 if at is None else at
        if not -len(items) <= at < len(items):
            return error("pop out of bounds")
        at %= len(items)
        return [("pop", at, items.pop(at), None, None, None, None)]
    if op == "clear" and items:
        n = len(items)
        items.clear()
        return [("clear", None, None, None, None, n, None)]
    return []


_log_call.empty, _list_call.empty = _Length, _Items


def log_changes(mutations: DataFrame, max_size: int | None = None) -> DataFrame:
    """Changes of logs: value, values, n and count beside kind (append, appendMany, trimHead, clear).

    Ops: append (value), append_many (values), trim_head (n) and clear. A trim takes no more than there is; after
    an append a log longer than ``max_size`` is trimmed by a change of its own. A task holds the length of one log.
    """
    made = _sequence(mutations, max_size, _log_call)
    return made.drop("index", "error")


def list_changes(mutations: DataFrame, max_size: int | None = None) -> DataFrame:
    """Changes of lists: index, value, values, n and count beside kind (append, appendMany, insert, insertMany, pop, trimHead, clear).

    Ops: append, append_many, insert (``index``), insert_many, pop (``index``, from the end if negative, the last one
    if null) and clear. A call out of bounds is a row of kind error, without a seq; the list stays as it was. A
    task holds one list, whose pops tell the values that stood there.
    """
    return _sequence(mutations, max_size, _list_call)
