"""Keyed stream folds on structured state: values and maps of a key's own.

Rows wait in blocks, sorted runs of what a micro-batch brought, until the watermark has passed them; one timer of the
first time of a block then passes them on in order. A micro-batch adds its blocks, and takes out those whose time has
begun; what is left of them waits on in a new one, others stay untouched. Each call on a state is a message to the
JVM, so a fold reads its state once before rows are stepped and writes it once after them, and ids that were seen lie
in pages (``Ids``). ``idle_ms`` bounds what is remembered in event time: a key without a row for so long is forgotten.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import cqrs, queue

#: The state store that has lists, maps and timers. It is set for the queries that need it, see ``run_to_table``.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_LONG, _TEXT, _FLAG, _BYTES = T.LongType(), T.StringType(), T.BooleanType(), T.BinaryType()

#: Rows of a block: what came in together is cut into short times, so that few rows of a long wait are held at once.
BLOCK = 256
#: Output rows that are handed on at once.
RUN = 10_000


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _plain(x):
    """A pandas value as Python has it."""
    if getattr(x, "ndim", 0):
        return x.tolist()
    return None if x is None or x != x else x.item() if hasattr(x, "item") else x


def _values(column: pd.Series, whole: bool) -> list:
    """A column's values; whole numbers come as decimals, which nulls beside them leave exact, and arrays as numpy's."""
    if whole:
        return [None if x is None or x != x else int(x) for x in column.tolist()]
    return [x if type(x) is str else _plain(x) for x in column.tolist()]


class Ids:
    """A set of ids in pages of a map state, by their hash. A page is read when an id of it is asked for, and written once
    after the rows; when ids are more than PAGE a page, all are dealt out over twice as many."""

    PAGE = 512
    HEAD = (-1,)

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getMapState(name, _struct(page=_LONG), _struct(ids=_BYTES))

    def enter(self, fresh: bool) -> None:
        head = None if fresh else self.state.getValue(self.HEAD)
        self.count, self.of = pickle.loads(head[0]) if head else (0, 1)
        self.stored = self.of if head else 0
        self.pages: dict[int, set] = {}
        self.changed: set[int] = set()

    def _page(self, n: int) -> set:
        if n not in self.pages:
            kept = self.state.getValue((n,)) if n < self.stored else None
            self.pages[n] = pickle.loads(kept[0]) if kept else set()
        return self.pages[n]

    def _place(self, i: str) -> int:
        return zlib.crc32(i.encode()) & (self.of - 1)

    def __contains__(self, i: str) -> bool:
        return i in self._page(self._place(i))

    def add(self, i: str) -> None:
        place = self._place(i)
        page = self._page(place)
        if i not in page:
            page.add(i)
            self.changed.add(place)
            self.count += 1
            if self.count > self.PAGE * self.of:
                self._spread()

    def _spread(self) -> None:
        ids = [i for n in range(self.of) for i in self._page(n)]
        self.of *= 2
        self.pages = {n: set() for n in range(self.of)}
        for i in ids:
            self.pages[self._place(i)].add(i)
        self.changed = set(self.pages)

    def leave(self) -> None:
        for n in self.changed:
            self.state.updateValue((n,), (pickle.dumps(self.pages[n]),))
        if self.changed:
            self.state.updateValue(self.HEAD, (pickle.dumps((self.count, self.of)),))

    def clear(self) -> None:
        self.state.clear()


class Ordered(StatefulProcessor):
    """Passes a key's rows to ``step`` in event-time order. A fold declares its states in ``begin``, reads them in ``enter``,
    writes them in ``leave`` and clears them in ``forget``. ``fresh`` tells that there is nothing to be read yet."""

    #: Whether the fold sets timers of its own, see ``due``.
    timed = False

    def __init__(self, schema: T.StructType, order: list[str], out: list[str], idle_ms: int | None = None):
        self.schema, self.order, self.out, self.idle_ms = schema, order, out, idle_ms

    def begin(self, handle: StatefulProcessorHandle) -> None: ...

    def enter(self) -> None:
        """Called before rows of a key are stepped, and ``leave`` after them."""

    def leave(self) -> None: ...

    def step(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None: ...

    def due(self) -> int | None:
        """The time of the fold's own timer, and ``fire`` what it gives then; one due exactly when a row arrives fires first."""

    def fire(self) -> list[tuple]: ...

    def restart(self) -> None:
        """After a gap of more than ``idle_ms`` between two rows."""
        self.forget()
        self.fresh = True
        self.enter()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row_of = handle, namedtuple("row_of", self.schema.names, rename=True)._make
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in self.schema]
        self.at = self.schema.names.index("at_ms")
        self.places = [self.at, *[self.schema.names.index(c) for c in self.order if c != "at_ms"]]
        self.waiting = handle.getMapState("waiting", _struct(first=_LONG, last=_LONG, id=_TEXT), _struct(rows=_BYTES))
        self.last = handle.getValueState("last", _struct(at_ms=_LONG))
        self.begin(handle)

    def _place(self, row: tuple) -> list[tuple]:
        return [(row[p] is not None, row[p]) for p in self.places]

    def _wait(self, rows: list[tuple]) -> None:
        """Rows in order as blocks; a timer for the first one, which sets that of the next."""
        for i in range(0, len(rows), BLOCK):
            run = rows[i : i + BLOCK]
            self.waiting.updateValue((run[0][self.at], run[-1][self.at], uuid.uuid4().hex), (pickle.dumps(run),))
        if rows:
            self.handle.registerTimer(rows[0][self.at])

    def _ready(self, blocks: list[tuple], now: int) -> Iterator[tuple]:
        """Rows up to ``now`` in order, merged from blocks; a block is opened when the rows have come to its first time."""
        opened: list[tuple] = []
        n = 0
        while opened or n < len(blocks):
            while n < len(blocks) and (not opened or blocks[n][0] <= opened[0][2][self.at]):
                rows = iter(pickle.loads(self.waiting.getValue(blocks[n])[0]))
                self.waiting.removeKey(blocks[n])
                row = next(rows)
                heapq.heappush(opened, (self._place(row), n, row, rows))
                n += 1
            _, own, row, rows = opened[0]
            if row[self.at] > now:
                break
            yield row
            if (row := next(rows, None)) is not None:
                heapq.heapreplace(opened, (self._place(row), own, row, rows))
            else:
                heapq.heappop(opened)
        self._wait(sorted((r for _, _, row, rows in opened for r in (row, *rows)), key=self._place))

    def _advance(self, until: int) -> list[tuple]:
        made = []
        while (due := self.due()) is not None and due <= until:
            made += self.fire()
        return made

    def _table(self, made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([m[i] for m in made], dtype=object) for i, c in enumerate(self.out)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            columns = [_values(batch[c], whole) for c, whole in zip(self.schema.names, self.whole, strict=True)]
            self._wait(sorted(zip(*columns, strict=True), key=self._place))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        there = [tuple(k) for k in self.waiting.keys()]
        blocks = sorted(k for k in there if k[0] <= now)
        kept = self.last.get()
        last, self.fresh = (None, True) if kept is None else (kept[0], False)
        made: list[tuple] = []
        if blocks or (self.timed and not self.fresh):
            self.enter()
            for row in self._ready(blocks, now):
                at = row[self.at]
                if self.timed:
                    made += self._advance(at)
                if self.idle_ms is not None and last is not None and at - last > self.idle_ms:
                    self.restart()
                made += self.step(self.row_of(row))
                last = at
                if len(made) >= RUN:
                    yield self._table(made)
                    made = []
            if self.timed:
                made += self._advance(now)
                if (due := self.due()) is not None:
                    self.handle.registerTimer(due)
            self.leave()
            self.last.update((last,))
            if blocks and self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms + 1)
            if blocks and len(there) > len(blocks):
                self.handle.registerTimer(min(k[0] for k in there if k[0] > now))
        if self.idle_ms is not None and last is not None and last + self.idle_ms < now and not there and (not self.timed or self.due() is None):
            self.forget()
            self.last.clear()
        if made:
            yield self._table(made)

    def close(self) -> None: ...


def fold(stream: DataFrame, key: str, at: str, late: str, make: Callable[[T.StructType], Ordered], out: str) -> DataFrame:
    """The rows that a fold gives; ``make`` gets the schema of rows as they wait, the event time as at_ms in milliseconds."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).withColumn("at_ms", F.unix_millis(at))
    schema = T.StructType([f for f in rows.schema if f.name != at])
    exact = {f.name: F.col(f.name).cast("decimal(19,0)") for f in schema if isinstance(f.dataType, T.LongType) and f.name not in (key, "at_ms")}
    rows = rows.withColumns(exact)
    return rows.groupBy(key).transformWithStateInPandas(make(schema), out, "Append", "EventTime")


def _names(out: str) -> list[str]:
    return [c.split()[0] for c in out.split(", ")]


class _Buffer(Ordered):
    def __init__(self, key: str, value: str, size: int, *rest):
        super().__init__(*rest)
        self.key, self.value, self.size = key, value, size

    def begin(self, handle):
        self.state = handle.getValueState("values", _struct(values=T.ArrayType(self.schema[self.value].dataType)))

    def enter(self):
        self.before = kept = None if self.fresh else self.state.get()
        self.values = list(kept[0]) if kept else []

    def step(self, row):
        self.values.append(getattr(row, self.value))
        if len(self.values) < self.size:
            return []
        out, self.values = self.values, []
        return [(getattr(row, self.key), out)]

    def leave(self):
        if self.values:
            self.state.update((self.values,))
        elif self.before:
            self.state.clear()

    def forget(self):
        self.state.clear()


def buffer_count(stream: DataFrame, key: str, at: str, order: list[str], value: str, size: int, late: str, idle_ms: int | None = None) -> DataFrame:
    """key and ``values``: every ``size`` values of a key, in order; fewer stay waiting."""
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, values array<{kinds[value]}>"
    return fold(stream, key, at, late, lambda schema: _Buffer(key, value, size, schema, order, _names(out), idle_ms), out)


class _Publish(Ordered):
    def __init__(self, strict: bool, *rest):
        super().__init__(*rest)
        self.strict = strict

    def begin(self, handle):
        self.topic = handle.getValueState("topic", _struct(opened=_FLAG, closed=_FLAG, next_seq=_LONG))
        self.commands, self.keys = Ids(handle, "commands"), Ids(handle, "keys")

    def enter(self):
        self.kept = (None if self.fresh else self.topic.get()) or (False, False, 1)
        self.commands.enter(self.fresh)
        self.keys.enter(self.fresh)

    def step(self, row):
        if not row.topic:
            return [(row.ord, "malformed-command", None)] if row.kind == "publish" else []
        status, seq = None, None
        opened, closed, nxt = self.kept
        if row.command_id is not None:
            if row.command_id in self.commands:
                status = "duplicate-command"
            else:
                self.commands.add(row.command_id)
        if status is None and row.kind == "ensure_topic":
            opened = True
        elif status is None and row.kind == "close_topic":
            closed = closed or opened
        elif status is None and row.kind == "publish":
            if row.idempotency_key is not None and row.idempotency_key in self.keys:
                status = "duplicate-command"
            elif not opened and self.strict:
                status = "unknown-topic"
            elif closed:
                status = "closed-topic"
            else:
                status, seq, opened, nxt = "published", nxt, True, nxt + 1
                if row.idempotency_key is not None:
                    self.keys.add(row.idempotency_key)
        self.kept = opened, closed, nxt
        return [(row.ord, status, seq)] if row.kind == "publish" else []

    def leave(self):
        self.topic.update(self.kept)
        self.commands.leave()
        self.keys.leave()

    def forget(self):
        for state in (self.topic, self.commands, self.keys):
            state.clear()


def publish(stream: DataFrame, at: str, late: str, strict: bool = True) -> DataFrame:
    """ord, status and seq of publish commands, as ``bus.publish`` gives them, topic by topic.

    Commands (ord, kind, topic, command_id, idempotency_key) of one topic share its state, so command ids are told apart
    within their topic only.
    """
    out = "ord long, status string, seq long"
    return fold(stream, "topic", at, late, lambda schema: _Publish(strict, schema, ["ord"], _names(out)), out)


class _Handle(Ordered):
    def __init__(self, handlers: dict[str, Callable], *rest):
        super().__init__(*rest)
        self.handlers = handlers

    def begin(self, handle):
        self.seen = Ids(handle, "commands")
        self.events = handle.getValueState("events", _struct(n=_LONG))

    def enter(self):
        self.seen.enter(self.fresh)
        (self.n,) = (None if self.fresh else self.events.get()) or (0,)

    def step(self, row):
        drafts: list = []
        if not row.id or not row.command_type:
            status = "malformed-command"
        elif row.id in self.seen:
            status = "duplicate-command"
        else:
            self.seen.add(row.id)
            status = "accepted" if row.command_type in self.handlers else "unknown-command"
            if status == "accepted":
                try:
                    drafts = self.handlers[row.command_type](row)
                except Exception:
                    status = "handler-failed"
        out = [(row.ord, status, None, None, None, None)]
        out += [(row.ord, "event", cqrs.event_id(row.id, i), self.n + i, kind, value) for i, (kind, value) in enumerate(drafts, 1)]
        self.n += len(drafts)
        return out

    def leave(self):
        self.seen.leave()
        self.events.update((self.n,))

    def forget(self):
        self.seen.clear()
        self.events.clear()


def handle(stream: DataFrame, key: str, at: str, late: str, handlers: dict[str, Callable]) -> DataFrame:
    """Commands (ord, id, command_type, any others) to events, aggregate by aggregate: a row per command with its status,
    then its events with id, seq (dense from 1 in the aggregate), type and payload.

    A handler gets the row and gives (type, payload) drafts, or raises. Ids are told apart within their aggregate.
    """
    out = "ord long, status string, id string, seq long, type string, payload long"
    return fold(stream, key, at, late, lambda schema: _Handle(handlers, schema, ["ord"], _names(out)), out)


class _Process(Ordered):
    def __init__(self, reduce: Callable, initial, kind: T.DataType, *rest):
        super().__init__(*rest)
        self.reduce, self.initial, self.kind = reduce, initial, kind

    def begin(self, handle):
        self.state = handle.getValueState("process", _struct(state=self.kind, events=_LONG, effects=_LONG, commands=_LONG, errors=_LONG, audits=_LONG))
        self.ids = Ids(handle, "events"), Ids(handle, "effects")

    def enter(self):
        kept = None if self.fresh else self.state.get()
        self.kept = cqrs.Kept(*kept) if kept else cqrs.Kept(self.initial)
        self.kept.seen = self.ids
        for ids in self.ids:
            ids.enter(self.fresh)

    def step(self, row):
        return cqrs.reduce_command(self.kept, row, self.reduce)

    def leave(self):
        kept = self.kept
        self.state.update((kept.state, kept.events, kept.effects, kept.commands, kept.errors, kept.audits))
        for ids in self.ids:
            ids.leave()

    def forget(self):
        for state in (self.state, *self.ids):
            state.clear()


def process(stream: DataFrame, at: str, late: str, reduce: Callable, initial, state_type: str) -> DataFrame:
    """The facts of ``cqrs.process``, process by process: its state, counters and remembered ids are states of the key."""
    out = cqrs.facts_type(stream.schema["process_id"].dataType, state_type)
    return fold(stream, "process_id", at, late, lambda schema: _Process(reduce, initial, out["state"].dataType, schema, ["ord"], out.names), out)


class _Works(dict):
    """A queue's works in a map state, read when asked for; ``flush`` writes those that changed."""

    def __init__(self, state, fields: tuple[str, ...]):
        super().__init__()
        self.state, self.fields, self.before = state, fields, {}

    def _load(self, i) -> bool:
        if i not in self.before and self.state.containsKey((i,)):
            self.before[i] = tuple(self.state.getValue((i,)))
            super().__setitem__(i, {"id": i} | dict(zip(self.fields, self.before[i], strict=True)))
        return super().__contains__(i)

    def __contains__(self, i):
        return self._load(i)

    def __getitem__(self, i):
        self._load(i)
        return super().__getitem__(i)

    def get(self, i, default=None):
        return self[i] if i is not None and i in self else default

    def flush(self):
        for i, work in self.items():
            now = tuple(work.get(f) for f in self.fields)
            if self.before.get(i) != now:
                self.state.updateValue((i,), now)


class _QueueFold(Ordered):
    FIELDS = {"seq": _LONG, "attempt": _LONG, "state": _TEXT, "due": _LONG, "lease": _TEXT, "worker": _TEXT, "until": _LONG}

    def __init__(self, make: Callable[[], object], *rest):
        super().__init__(*rest)
        self.make = make

    def begin(self, handle):
        self.works = handle.getMapState("works", _struct(id=_TEXT), _struct(**self.FIELDS))
        self.lines = handle.getMapState("lines", _struct(line=_TEXT, at=_LONG, seq=_LONG, id=_TEXT), _struct(there=_FLAG))
        self.seen = handle.getMapState("commands", _struct(id=_TEXT), _struct(seen=_FLAG))
        self.keys = handle.getMapState("keys", _struct(id=_TEXT), _struct(seen=_FLAG))
        self.numbers = handle.getValueState("numbers", _struct(record=_LONG, lease=_LONG, admission=_LONG))

    @staticmethod
    def entries(q) -> set[tuple]:
        return {("ready", None, s, i) for s, i in q.ready} | {("delayed", *e) for e in q.delayed} | {("leases", *e) for e in q.leases}

    def enter(self):
        """The queue as an object over the states: lines are read once, works as they are asked for."""
        self.queue = q = self.make()
        q.works = _Works(self.works, tuple(self.FIELDS))
        for line, at, seq, i in map(tuple, self.lines.keys()):
            getattr(q, line).append((seq, i) if line == "ready" else (at, seq, i))
        for line in (q.ready, q.delayed, q.leases):
            heapq.heapify(line)
        if self.numbers.exists():
            q.numbers = dict(zip(("record", "lease", "admission"), self.numbers.get(), strict=True))
        self.before = self.entries(q)

    def leave(self):
        after = self.entries(self.queue)
        for entry in self.before - after:
            self.lines.removeKey(entry)
        for entry in after - self.before:
            self.lines.updateValue(entry, (True,))
        self.queue.works.flush()
        self.numbers.update(tuple(self.queue.numbers[n] for n in ("record", "lease", "admission")))

    def step(self, row):
        c = row._asdict()
        formed = queue.is_formed(c)
        used = [(state, (i,)) for state, i in ((self.seen, c["command_id"]), (self.keys, c.get("idempotency_key"))) if i]
        c["_again"] = formed and any(state.containsKey(i) for state, i in used)
        if formed and not c["_again"]:
            for state, i in used:
                state.updateValue(i, (True,))
        return self.queue.apply(c)

    def forget(self):
        for state in (self.works, self.lines, self.seen, self.keys, self.numbers):
            state.clear()


def work_queue(stream: DataFrame, at: str, late: str, lease_ms: int, attempts: int, retry_ms: int = 0) -> DataFrame:
    """The records and issues of ``queue.fold``, queue by queue: works, lines and seen command ids and keys are maps of the key.

    A micro-batch reads the entries of the queue's lines once, and of its works those that commands touch.
    """
    return fold(stream, "queue_id", at, late, lambda schema: _QueueFold(lambda: queue.Queue(lease_ms, attempts, retry_ms), schema, ["ord"], _names(queue.RECORD)), queue.RECORD)
