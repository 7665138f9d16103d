"""The stream forms: stateless operators, windows with watermarks, keyed folds, event-time timers, idempotent sinks.

Stateless batch operators (map, keep, stratify, merge) take a streaming DataFrame as they are. Keyed folds wait
until the watermark has passed a row, so rows that come out of order within the lateness are folded in order,
in whatever micro-batches they come; later ones are dropped by the watermark.
"""

from __future__ import annotations

import contextlib
import pickle
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.staging import shared_dir, stage, staged_dir
from . import stateful


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """Parquet files of a folder (or one file) as a stream with the batch table's schema; None takes all files at once."""
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern: the source takes a plain path for a folder only
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(glob)


def tumbling(stream: DataFrame, at: str, width: str, late: str, keys: list[str], **folds: Column) -> DataFrame:
    """Tumbling windows per key that close when the watermark passes them; empty windows do not appear."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(*keys, F.window(at, width)).agg(*[c.alias(n) for n, c in folds.items()])


def dedupe(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """The first row per id; ids are forgotten when the watermark has passed them."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


class _Stepped(stateful.Ordered):
    """A fold by functions; what it keeps is one value of the key."""

    def __init__(self, step: Callable, initial, due: Callable | None, fire: Callable | None, *rest):
        super().__init__(*rest)
        self.by, self.initial, self.due_of, self.fire_of, self.timed = step, initial, due, fire, due is not None

    def begin(self, handle):
        self.value = handle.getValueState("kept", "kept binary")

    def enter(self):
        kept = None if self.fresh else self.value.get()
        self.kept = pickle.loads(kept[0]) if kept else self.initial

    def leave(self):
        self.value.update((pickle.dumps(self.kept),))

    def step(self, row):
        self.kept, made = self.by(self.kept, row)
        return made

    def due(self):
        return self.due_of(self.kept)

    def fire(self):
        self.kept, made = self.fire_of(self.kept)
        return made

    def forget(self):
        self.value.clear()


def fold(
    stream: DataFrame, key: str, at: str, late: str, order: list[str], step: Callable, initial: tuple, out: str,
    due: Callable | None = None, fire: Callable | None = None, forget_ms: int | None = None,
) -> DataFrame:
    """A fold per key in event-time order: ``step(state, row)`` gives (new state, list of output tuples).

    ``at`` is the event time (row.at_ms in milliseconds), ``late`` how long rows may come out of order,
    ``order`` the columns that order rows of one time totally. Rows wait in the key's state, see ``stateful``, until the watermark has
    passed them; rows behind it are dropped, and rows after the last watermark stay waiting. A step may set a
    timer: ``due(state)`` is its time or None, ``fire(state)`` gives (new state, outputs). A timer that is due exactly
    when a row arrives fires first. A key without a row for more than
    ``forget_ms`` of event time is forgotten and begins anew.
    """
    names = [c.split()[0] for c in out.split(", ")]
    return stateful.fold(stream, key, at, late, lambda schema: _Stepped(step, initial, due, fire, schema, [c for c in order if c != at], names, forget_ms), out)


def debounce(stream: DataFrame, key: str, at: str, value: str, ms: int, late: str) -> DataFrame:
    """key, at_ms and value of rows without a later row of their key within ``ms``, once the watermark has passed the gap."""
    kinds = dict(stream.dtypes)
    step = lambda state, row: ((getattr(row, key), row.at_ms, getattr(row, value)), [])
    due = lambda state: None if state is None else state[1] + ms
    return fold(stream.select(key, at, value), key, at, late, [at, value], step, None, f"{key} {kinds[key]}, at_ms long, {value} {kinds[value]}", due, lambda state: (None, [state]))


def audit(stream: DataFrame, key: str, at: str, value: str, ms: int, late: str) -> DataFrame:
    """A row opens a window of ``ms``; at its end (``emit_at``) the latest row's value is emitted."""
    kinds = dict(stream.dtypes)
    step = lambda state, row: ((getattr(row, key), state[1] if state else row.at_ms + ms, getattr(row, value)), [])
    due = lambda state: None if state is None else state[1]
    return fold(stream.select(key, at, value), key, at, late, [at, value], step, None, f"{key} {kinds[key]}, emit_at long, {value} {kinds[value]}", due, lambda state: (None, [state]))


def timeout(stream: DataFrame, key: str, at: str, value: str, ms: int, late: str) -> DataFrame:
    """Values of each key up to its first gap of ``ms``; there the key ends with an error row at the time the timer fired."""
    kinds = dict(stream.dtypes)

    def step(state, row):
        if state is not None and state[2]:
            return state, []
        return (getattr(row, key), row.at_ms, False), [(getattr(row, key), row.at_ms, getattr(row, value), None)]

    def fire(state):
        own, last, _ = state
        return (own, last, True), [(own, last + ms, None, f"timeout: no value within {ms}ms")]

    due = lambda state: None if state is None or state[2] else state[1] + ms
    return fold(stream.select(key, at, value), key, at, late, [at, value], step, None, f"{key} {kinds[key]}, at_ms long, {value} {kinds[value]}, error string", due, fire)


def throttle(stream: DataFrame, key: str, at: str, value: str, ms: int, late: str) -> DataFrame:
    """Leading edge: a row is emitted, then rows of its key are ignored for ``ms``."""
    step = lambda opened, row: (opened, []) if opened is not None and row.at_ms - opened < ms else (row.at_ms, [(getattr(row, value),)])
    return fold(stream.select(key, at, value), key, at, late, [at, value], step, None, f"{value} {dict(stream.dtypes)[value]}", forget_ms=ms)


def rate_limit(stream: DataFrame, key: str, at: str, value: str, most: int, ms: int, late: str) -> DataFrame:
    """Fixed windows that open at the first row after the last one's end: allowed tells whether a row is among its first ``most``."""

    def step(state, row):
        opened, n = state if state and row.at_ms - state[0] < ms else (row.at_ms, 0)
        return (opened, n + 1), [(getattr(row, value), n < most)]

    return fold(stream.select(key, at, value), key, at, late, [at, value], step, None, f"{value} {dict(stream.dtypes)[value]}, allowed boolean", forget_ms=ms)


def pairwise(stream: DataFrame, key: str, at: str, value: str, late: str) -> DataFrame:
    """previous and current value of each key from its second row on."""
    kind = dict(stream.dtypes)[value]
    step = lambda last, row: ((getattr(row, value),), [(getattr(row, key), last[0], getattr(row, value))] if last else [])
    return fold(stream.select(key, at, value), key, at, late, [at, value], step, None, f"{key} {dict(stream.dtypes)[key]}, previous {kind}, current {kind}")


def breaker(stream: DataFrame, key: str, at: str, order: str, failed: str, threshold: int, late: str) -> DataFrame:
    """The breaker's state after each row: open from ``threshold`` failures in a row on, until a success closes it."""

    def step(n, row):
        n = n + 1 if getattr(row, failed) else 0
        return n, [(getattr(row, order), n, "open" if n >= threshold else "closed")]

    return fold(stream.select(key, at, order, failed), key, at, late, [at, order], step, 0, f"{order} {dict(stream.dtypes)[order]}, failures long, state string")


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _base(spark: SparkSession, name: str, resume: bool) -> str:
    """The folder of a stream's checkpoint and tables: the one that earlier runs of the name had, or a new one that ``clear_staged`` deletes."""
    return f"{shared_dir(spark)}/streams/{name}" if resume else f"{staged_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", resume: bool = False) -> DataFrame:
    """Run a stream over all that is there now into a written table, and read that. Checkpoint and table lie
    in the shared folder; the file sink writes each batch once. With ``resume`` a later run of the name, also of another
    application, goes on where the last one ended or failed, with its state and offsets."""
    spark = stream.sparkSession
    base = _base(spark, name, resume)
    with _settings(spark, **dict([stateful.PROVIDER])):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def once_per_key(stream: DataFrame, name: str, effect: Callable[[DataFrame, int], None], resume: bool = False) -> None:
    """Run an effect per micro-batch; it gets the batch's number, by which a replay can be told. After a failure a
    run with ``resume`` begins with the batch that failed, with the same rows and number."""
    base = _base(stream.sparkSession, name, resume)
    query = stream.writeStream.foreachBatch(effect).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


class Ledger:
    """Effects that stand once per id, whatever fails between the batch's rows and its commit.

    Below the stream's folder lie ``effects`` and ``ledger``, a folder per batch number in each. A batch's
    effects are written first and its ids then, both replacing what an earlier try of the same batch left;
    effects count once the ledger has their batch. Ids of earlier batches are passed over. So a replay, which has
    the batch's rows and number again, leaves what a first run would have left.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, _base(spark, name, True)
        self.name = name

    def _table(self, folder: str) -> DataFrame | None:
        path = f"{self.base}/{folder}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.option("recursiveFileLookup", False).option("basePath", path).parquet(path) if there else None

    def apply(self, rows: DataFrame, batch: int, key: str, effect: Callable[[DataFrame], DataFrame], broken: bool = False) -> None:
        """The effects of a batch's rows whose ``key`` no earlier batch had, one row per key: the first by all columns.

        ``broken`` makes it fail where it hurts most, with the effects written and their ids not.
        """
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*rows.columns))
        fresh = rows.withColumn("_n", nth).where("_n = 1").drop("_n")
        if (done := self._table("ledger")) is not None:
            fresh = fresh.join(done.where(F.col("batch") < batch).select(F.col("id").alias(key)), key, "left_anti")
        fresh = stage(fresh, "ledger-batch")
        self.write("effects", effect(fresh), batch)
        if broken:
            raise RuntimeError("broken between effects and ledger")
        self.write("ledger", fresh.select(F.lit(self.name).alias("query"), F.col(key).alias("id")), batch)

    def write(self, folder: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{folder}/batch={batch}")

    def applied(self) -> DataFrame:
        """query, id and batch of every id whose effect stands."""
        return self._table("ledger")

    def effects(self) -> DataFrame:
        """The effects of all batches that the ledger has."""
        return self._table("effects").join(self.applied().select("batch").distinct(), "batch", "left_semi").drop("batch")


def effect_once(stream: DataFrame, name: str, key: str, effect: Callable[[DataFrame], DataFrame], broken_at: int | None = None) -> Ledger:
    """Run an effect that gives rows, once per value of ``key`` over all runs of the name; see ``Ledger``.

    ``broken_at`` is a drill: this run fails in the batch of that number.
    """
    ledger = Ledger(stream.sparkSession, name)
    once_per_key(stream, name, lambda rows, batch: ledger.apply(rows, batch, key, effect, batch == broken_at), resume=True)
    return ledger
