"""Change-log collections: folds of list, log, map and index changes, restore, retention, reads, deltas, frames, caches.

Change rows have ``collection``, ``seq`` and ``kind``; payload columns are null where a kind has none. Snapshots
come from aggregates per key (partial aggregation), not from sequential replay, wherever the semantics allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import keyed_fold
from ..functions.order import number, over, running_sum, running_sums
from ..functions.staging import stage

C = ["collection"]


def _after_clear(changes: DataFrame) -> DataFrame:
    """Rows after the collection's last clear: one aggregate per collection, joined back."""
    cut = changes.groupBy(*C).agg(F.max(F.when(F.col("kind") == "clear", F.col("seq"))).alias("_cut"))
    return changes.join(cut, C).where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))).drop("_cut")


def map_snapshot(changes: DataFrame) -> DataFrame:
    """collection, k, v after set, delete and clear changes (columns k, v)."""
    rows = _after_clear(changes).where("kind <> 'clear'")
    last = rows.groupBy(*C, "k").agg(F.max_by(F.struct("kind", "v"), "seq").alias("last"))
    return last.where("last.kind = 'set'").select(*C, "k", "last.v")


def map_errors(changes: DataFrame) -> DataFrame:
    """Changes that contradict the state before them: a delete of a missing key, a wrong ``previous`` or clear ``count``."""
    rows = stage(running_sum(changes, F.when(F.col("kind") == "clear", 1).otherwise(0), ["seq"], C, F.floor(F.col("seq") / PER_BUCKET), "_era"), "map-eras")
    w = over([*C, "_era", "k"], ["seq"])
    keyed = rows.where("kind <> 'clear'").withColumn("_before", F.lag("v").over(w)).withColumn("_was", F.lag("kind").over(w))
    live = F.coalesce(F.col("_was") == "set", F.lit(False))
    missing = (F.col("kind") == "delete") & ~live
    wrong = F.col("previous").isNotNull() & ~F.when(live, F.col("_before")).eqNullSafe(F.col("previous"))
    keyed = keyed.withColumn("error", F.when(missing, "missing key").when(wrong, "wrong previous"))
    step = F.when((F.col("kind") == "set") & ~live, 1).when((F.col("kind") == "delete") & live, -1).otherwise(0)
    sizes = keyed.groupBy(*C, "_era").agg(F.sum(step).alias("_size"))
    cleared = rows.where("kind = 'clear'").withColumn("_era", F.col("_era") - 1).join(sizes, [*C, "_era"], "left")
    bad = cleared.where(F.col("count") != F.coalesce("_size", F.lit(0))).select(*C, "seq", F.lit("wrong clear count").alias("error"))
    return keyed.where("error is not null").select(*C, "seq", "error").union(bad)


def index_snapshot(changes: DataFrame) -> DataFrame:
    """collection, primary, secondary, value after upsert, delete, deleteMany (``primaries``) and clear; read it in
    order of (secondary, primary)."""
    rows = _after_clear(changes).where("kind <> 'clear'")
    many = F.when(F.col("kind") == "deleteMany", F.col("primaries")).otherwise(F.array("primary"))
    rows = rows.withColumn("primary", F.explode(many))
    last = rows.groupBy(*C, "primary").agg(F.max_by(F.struct("kind", "secondary", "value"), "seq").alias("last"))
    return last.where("last.kind = 'upsert'").select(*C, "primary", "last.secondary", "last.value")


#: Changes of a collection that are summed up in one task.
PER_BUCKET = 1000


def _log_lengths(changes: DataFrame) -> DataFrame:
    """Log changes with ``_size`` (values added), ``_era`` (clears so far), and in it up to the change ``_added``, the
    values added, and ``_length``, the log's length if nothing was wrong before. A written table."""
    size = F.when(F.col("kind") == "append", 1).when(F.col("kind") == "appendMany", F.coalesce(F.size("values"), F.lit(0))).otherwise(0)
    bucket = F.floor(F.col("seq") / PER_BUCKET)
    rows = stage(running_sum(changes.withColumn("_size", size), F.when(F.col("kind") == "clear", 1).otherwise(0), ["seq"], C, bucket, "_era"), "log-eras")
    step = F.when(F.col("kind") == "trimHead", -F.col("n")).otherwise(F.col("_size"))
    return stage(running_sums(rows, {"_length": step, "_added": F.col("_size")}, ["seq"], [*C, "_era"], bucket), "log-lengths")


def _first_errors(rows: DataFrame) -> DataFrame:
    has = "count" in rows.columns
    rows = rows if has else rows.withColumn("count", F.lit(None).cast("long"))
    cut = (F.col("kind") == "trimHead") & (F.col("_length") < 0)
    ends = rows.groupBy(*C, "_era").agg(F.max_by("_length", "seq").alias("_held"))
    ends = ends.select(F.col("collection").alias("_of"), (F.col("_era") + 1).alias("_next"), "_held")
    rows = rows.join(ends, (F.col("collection") == F.col("_of")) & (F.col("_era") == F.col("_next")), "left")
    wrong = (F.col("kind") == "clear") & (F.col("count") != F.coalesce("_held", F.lit(0)))
    found = rows.withColumn("error", F.when(cut, "trimHead exceeds length").when(wrong, "wrong clear count")).where("error IS NOT NULL")
    return found.groupBy(*C).agg(F.min_by(F.struct("seq", "error"), "seq").alias("f")).select(*C, "f.*")


def log_errors(changes: DataFrame) -> DataFrame:
    """collection, seq and error of the first change of each log that contradicts its state: a trim of more than the
    log holds, or a clear whose ``count`` (if given) is not its length. A replay stops there."""
    return _first_errors(_log_lengths(changes))


def log_snapshot(changes: DataFrame) -> DataFrame:
    """collection, position, value of what append, appendMany, trimHead (``n``) and clear changes leave.

    A log with an error (see ``log_errors``) is left as it was before that change; later ones do not count.
    """
    rows = _log_lengths(changes)
    stop = _first_errors(rows).select(F.col("collection").alias("_of"), F.col("seq").alias("_stop"))
    rows = rows.join(stop, F.col("collection") == F.col("_of"), "left").where("_stop IS NULL OR seq < _stop").drop("_of", "_stop")
    head = rows.groupBy(*C, "_era").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trimHead", F.col("n"))), F.lit(0)).alias("_head"))
    head = head.groupBy(*C).agg(F.max_by(F.struct("_era", "_head"), "_era").alias("_h")).select(F.col("collection").alias("_of"), F.col("_h._era").alias("_last"), F.col("_h._head").alias("_head"))
    last = rows.join(head, (F.col("collection") == F.col("_of")) & (F.col("_era") == F.col("_last"))).where("_size > 0")
    values = F.when(F.col("kind") == "append", F.array("value")).otherwise(F.col("values"))
    added = last.select(*C, "_head", (F.col("_added") - F.col("_size")).alias("_start"), F.posexplode(values).alias("_i", "value"))
    position = F.col("_start") + F.col("_i") - F.col("_head")
    return added.where(position >= 0).select(*C, position.cast("long").alias("position"), "value")


def list_fault(xs: list, r: dict) -> str | None:
    """What is wrong with a change of a list as it is, or None."""
    at, n = r["index"], len(xs)
    if r["kind"] in ("insert", "insertMany"):
        return None if at is not None and 0 <= at <= n else "insert out of bounds"
    if r["kind"] == "pop":
        at = -1 if at is None else at
        if not -n <= at < n:
            return "pop out of bounds"
        return None if r["value"] is None or xs[at] == r["value"] else "wrong pop value"
    if r["kind"] == "trimHead":
        return None if r["n"] <= n else "trimHead exceeds length"
    if r["kind"] == "clear":
        return None if r.get("count") is None or r["count"] == n else "wrong clear count"
    return None


def list_apply(xs: list, r: dict) -> None:
    kind, at = r["kind"], r["index"]
    if kind in ("append", "appendMany"):
        xs.extend([r["value"]] if kind == "append" else r["values"] or [])
    elif kind in ("insert", "insertMany"):
        xs[at:at] = [r["value"]] if kind == "insert" else r["values"] or []
    elif kind == "pop":
        xs.pop(-1 if at is None else at)
    elif kind == "trimHead":
        del xs[: r["n"]]
    elif kind == "clear":
        xs.clear()


def _replay(changes: DataFrame) -> DataFrame:
    """collection, position, value of each list, and seq and error of the change at which its replay stopped.

    A list is one value of its collection, so its state is held whole by the task that replays it; the
    changes themselves pass as a stream.
    """
    names = changes.columns

    def step(state, row):
        xs, stop = state
        r = dict(zip(names, row, strict=True))
        if stop is None and (error := list_fault(xs, r)):
            stop = (r["seq"], error)
        if stop is None:
            list_apply(xs, r)
        return (xs, stop), []

    def finish(key, state):
        xs, stop = state
        yield from ((*key, i, x, None, None) for i, x in enumerate(xs))
        if stop is not None:
            yield (*key, None, None, *stop)

    kinds = f"collection {changes.schema['collection'].dataType.simpleString()}, position long, value {changes.schema['value'].dataType.simpleString()}, seq long, error string"
    return keyed_fold(changes, C, ["seq"], step, lambda: ([], None), kinds, finish)


def list_snapshot(changes: DataFrame) -> DataFrame:
    """collection, position, value after positional changes; each collection is replayed in order.

    Kinds: append, appendMany, insert, insertMany (``index``), pop (``index``, from the end if negative, the
    last one if null), trimHead (``n``), clear (``count``). A list with an error (see ``list_errors``) is
    left as it was before that change.
    """
    return _replay(changes).where("position IS NOT NULL").select(*C, "position", "value")


def list_errors(changes: DataFrame) -> DataFrame:
    """collection, seq and error of the change at which a list's replay stops: a position out of bounds, a pop whose
    ``value`` is not what stood there, a trim of more than there is, a wrong clear count. Null values are not checked."""
    return _replay(changes).where("error IS NOT NULL").select(*C, "seq", "error")


def restored(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """What a restore from a snapshot at a cursor (collection, cursor; -1 for none) and later changes is made of.

    A row per collection: applied, cursor, contiguous and source (empty, snapshot, changes,
    snapshot+changes). Contiguity is one aggregate, not a walk.
    """
    later = changes.join(cursors, C).where(F.col("seq") > F.col("cursor"))
    got = later.groupBy(*C).agg(F.count("*").alias("applied"), F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    meta = cursors.join(got, C, "left").withColumn("applied", F.coalesce("applied", F.lit(0)))
    whole = (F.col("applied") == 0) | ((F.col("_low") == F.col("cursor") + 1) & (F.col("_high") - F.col("_low") + 1 == F.col("applied")))
    source = F.when((F.col("cursor") >= 0) & (F.col("applied") > 0), "snapshot+changes").when(F.col("cursor") >= 0, "snapshot").when(F.col("applied") > 0, "changes").otherwise("empty")
    return meta.select(*C, "applied", F.coalesce("_high", "cursor").alias("cursor"), whole.alias("contiguous"), source.alias("source"))


def wrong_kinds(frames: DataFrame, kind: str) -> DataFrame:
    """Snapshot or change frames (collection, collection_kind, any others) that are not of the kind to restore."""
    return frames.where(~F.col("collection_kind").eqNullSafe(F.lit(kind)))


def restore_map(snapshot: DataFrame, changes: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State of maps from a snapshot (collection, k, v) at its cursor and later changes, and what it is made of."""
    later = changes.join(cursors, C).where(F.col("seq") > F.col("cursor"))
    base = snapshot.join(cursors, C).select(*C, F.col("cursor").alias("seq"), F.lit("set").alias("kind"), "k", "v")
    return map_snapshot(base.unionByName(later.select(*C, "seq", "kind", "k", "v"))), restored(changes, cursors)


def restore_index(snapshot: DataFrame, changes: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``restore_map``, for an index (collection, primary, secondary, value)."""
    later = changes.join(cursors, C).where(F.col("seq") > F.col("cursor")).drop("cursor")
    base = snapshot.join(cursors, C).select(*C, F.col("cursor").alias("seq"), F.lit("upsert").alias("kind"), "primary", "secondary", "value")
    return index_snapshot(base.unionByName(later, allowMissingColumns=True)), restored(changes, cursors)


#: Positions of a snapshot stand before all changes.
_BEFORE = -(1 << 40)


def _positions_first(snapshot: DataFrame, changes: DataFrame, cursors: DataFrame) -> DataFrame:
    later = changes.join(cursors, C).where(F.col("seq") > F.col("cursor")).drop("cursor")
    base = snapshot.select(*C, (F.col("position") + _BEFORE).alias("seq"), F.lit("append").alias("kind"), "value")
    return base.unionByName(later, allowMissingColumns=True)


def restore_log(snapshot: DataFrame, changes: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``restore_map``, for logs (collection, position, value)."""
    return log_snapshot(_positions_first(snapshot, changes, cursors)), restored(changes, cursors)


def restore_list(snapshot: DataFrame, changes: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``restore_map``, for lists (collection, position, value)."""
    return list_snapshot(_positions_first(snapshot, changes, cursors)), restored(changes, cursors)


def keep_last(df: DataFrame, n: int, order: list[str], keys: list[str]) -> DataFrame:
    """The last n rows of each key: capacity of a collection."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def at(df: DataFrame, i: int, keys: list[str] = C) -> DataFrame:
    """The row at a position of each collection, counted from the end if negative; out of range gives none."""
    if i >= 0:
        return df.where(F.col("position") == i)
    size = F.max("position").over(Window.partitionBy(*keys)) + 1
    return df.withColumn("_n", size).where(F.col("position") == F.col("_n") + i).drop("_n")


def tail(df: DataFrame, n: int, keys: list[str] = C) -> DataFrame:
    return keep_last(df, n, ["position"], keys)


def slice_rows(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    rows = df.where(F.col("position") >= start)
    return rows if stop is None else rows.where(F.col("position") < stop)


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return slice_rows(df, offset, offset + limit)


def key_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows with start <= key < end; none if start >= end."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is asked for."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Changes that turn one snapshot into another: set or delete per key that differs, none for the others."""
    b = before.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    both = b.join(a, keys, "full")
    kind = F.when(F.col("_in_a").isNull(), "delete").when(F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")), "set")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", F.col("_a").alias(value), F.col("_b").alias("previous"))


def frames(changes: DataFrame, path: Column, seq: Column, body: Column) -> DataFrame:
    """WAL frames: key (path and a 20-digit seq), the change's canonical JSON and its checksum."""
    key = F.concat(path, F.lit("/"), F.lpad(seq.cast("string"), 20, "0"))
    return changes.withColumns({"frame_key": key, "change": body, "checksum": F.sha2(body, 256)})


def verified(frames: DataFrame) -> DataFrame:
    return frames.withColumn("verified", F.col("checksum") == F.sha2("change", 256))


#: What a content store does in each mode: look up, report misses as errors, store, forget.
MODES = {"read": (True, False, False, False), "read-strict": (True, True, True, True), "write": (False, False, True, False), "read-write": (True, False, True, True)}


def content_lookup(requests: DataFrame, store: DataFrame, key: str = "key", mode: str = "read") -> DataFrame:
    """Requests with the stored value and hit; in mode read-strict a miss is an error row, in write all are misses."""
    looks, strict, _, _ = MODES[mode]
    kept = store.select(key, "value").dropDuplicates([key])
    out = requests.join(kept if looks else kept.where("false"), key, "left")
    hit = F.col("value").isNotNull()
    return out.withColumn("hit", hit).withColumn("error", F.when(~hit & F.lit(strict), "missing entry"))


def content_apply(store: DataFrame, asks: DataFrame, mode: str, key: str = "key") -> DataFrame:
    """A store (key, value) after asks (key, ord, kind store or forget, value), in order, as far as the mode lets them:
    read stores nothing, read and write forget nothing."""
    _, _, stores, forgets = MODES[mode]
    able = [k for k, on in (("store", stores), ("forget", forgets)) if on]
    asks = asks.where(F.col("kind").isin(*able)) if able else asks.where("false")
    return upsert(store, asks.withColumn("value", F.when(F.col("kind") == "store", F.col("value"))), key, "ord")


def tiered(keys: DataFrame, tiers: list[DataFrame], key: str = "key") -> DataFrame:
    """Keys with the value of the first tier that has it and the tier's number, -1 if none has."""
    out, values = keys, []
    for i, tier in enumerate(tiers):
        out = out.join(tier.select(key, F.col("value").alias(f"_v{i}")), key, "left")
        values.append(F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)))
    value = F.coalesce(*[f"_v{i}" for i in range(len(tiers))])
    return out.select(*keys.columns, value.alias("value"), F.coalesce(*values, F.lit(-1)).alias("tier"))


def asked(found: DataFrame, tiers: int) -> DataFrame:
    """A fact per tier that a lookup asked, with hit or miss, up to the one that answered."""
    last = F.when(F.col("tier") < 0, F.lit(tiers - 1)).otherwise(F.col("tier"))
    rows = found.withColumn("asked", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("result", F.when(F.col("asked") == F.col("tier"), "hit").otherwise("miss"))


def promotions(found: DataFrame) -> DataFrame:
    """Rows to add to the tiers before the one that answered."""
    return found.where("tier > 0").withColumn("to_tier", F.explode(F.sequence(F.lit(0), F.col("tier") - 1)))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed table after later writes: the last write per key wins, a null value deletes."""
    old = table.select(key, "value", F.lit(None).cast("long").alias("_o"))
    both = old.union(changes.select(key, "value", F.col(order).cast("long").alias("_o")))
    last = both.groupBy(key).agg(F.max_by(F.struct("value"), F.coalesce("_o", F.lit(-1))).alias("_w"))
    return last.select(key, "_w.value").where("value is not null")


def append(log: DataFrame, new: DataFrame, order: list[str], bucket: Column | None = None) -> DataFrame:
    """New rows with the dense seq that follows a log's last one, per collection; from 0 on an empty log.

    ``bucket`` keeps a collection of many new rows from being one task, see ``number``.
    """
    last = log.groupBy(*C).agg(F.max("seq").alias("_last"))
    rows = number(new, order, C, bucket, "_r").join(last, C, "left")
    return rows.withColumn("seq", (F.coalesce("_last", F.lit(-1)) + F.col("_r")).cast("long")).drop("_last", "_r")


def log_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """Per collection the next ``limit`` rows after a seq, with done and next_after. Seqs are dense, so two bounds
    per collection find the page."""
    ends = log.groupBy(F.col("collection").alias("_of")).agg(F.min("seq").alias("_head"), F.max("seq").alias("_last"))
    start = F.greatest("_head", F.lit(after + 1))
    rows = log.join(ends, F.col("collection") == F.col("_of")).where((F.col("seq") >= start) & (F.col("seq") < start + limit))
    out = rows.withColumns({"done": F.col("_last") < start + limit, "next_after": F.least(F.col("_last"), start + limit - 1)})
    return out.drop("_of", "_head", "_last")


def truncate_after(log: DataFrame, seq: int) -> DataFrame:
    """A log without the rows after a seq."""
    return log.where(F.col("seq") <= seq)


def log_sizes(log: DataFrame) -> DataFrame:
    """collection and size of each log."""
    return log.groupBy(*C).agg(F.count("*").alias("size"))


def with_prefix(table: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Entries of a keyed table whose key begins with a prefix."""
    return table.where(F.col(key).startswith(prefix))


def snapshot_points(changes: DataFrame, every: int) -> DataFrame:
    """collection and cursor of each collection's last snapshot frame, if one is written every ``every`` changes."""
    last = changes.groupBy(*C).agg(F.max("seq").alias("_last"))
    cursor = F.floor((F.col("_last") + 1) / every) * every - 1
    return last.select(*C, cursor.cast("long").alias("cursor")).where("cursor >= 0")


def compacted(changes: DataFrame, every: int, fold: Callable[[DataFrame], DataFrame] = map_snapshot) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows at each collection's last point, and the change frames after it, which is all a restore needs.

    ``fold`` is the snapshot of the collections' kind: map, index, log or list.
    """
    points = snapshot_points(changes, every)
    rows = changes.join(points, C, "left").withColumn("cursor", F.coalesce("cursor", F.lit(-1)))
    return fold(rows.where("seq <= cursor").drop("cursor")), rows.where("seq > cursor").drop("cursor")


def observed(rows: DataFrame, path: Column, prefix: str, order: list[str], bucket: Column) -> DataFrame:
    """Rows under a path prefix as an event log: path and a dense seq from 1 over all of them."""
    return number(rows.withColumn("path", path).where(F.col("path").startswith(prefix)), order, bucket=bucket, name="seq")
