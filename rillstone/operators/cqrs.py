"""Commands to events: dedupe, handlers, event numbering, audit, projections, process folds and effects."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import keyed_fold
from ..functions.ids import prefixed_key
from ..functions.order import number, over
from ..functions.staging import stage
from . import graphs


def handle(commands: DataFrame, handlers: dict[str, Column], bucket: Column, known_events: list[str] | None = None) -> DataFrame:
    """Commands (ord, id, command_type, any others) with status and ``drafts``, what their handler gives.

    Reject order: empty id or type, an id seen before (whatever became of it), no handler, a handler
    that fails (null drafts), then the first draft at fault: an empty type, a type that is not one of
    ``known_events``, an event id that an accepted command or an earlier draft has. A handler is a column:
    an array of draft structs with ``type``, ``payload`` and, if it names events itself, ``id``.
    ``bucket`` grows with ord, see ``number``; it numbers events over all commands.
    """
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rows = commands.withColumn("_bad", blank("id") | blank("command_type"))
    # Rows without an id are all malformed and need no rank: their ord parts them, lest they meet in one task.
    rank = F.row_number().over(over(["id", "_bad", "_apart"], ["ord"]))
    drafts = F.lit(None)
    for kind, column in handlers.items():
        drafts = F.when(F.col("command_type") == kind, column).otherwise(drafts)
    rows = rows.withColumn("_apart", F.when(F.col("_bad"), F.col("ord"))).withColumn("_rank", rank).withColumn("drafts", drafts)
    status = (
        F.when(F.col("_bad"), "malformed-command").when(F.col("_rank") > 1, "duplicate-command")
        .when(~F.col("command_type").isin(*handlers), "unknown-command").when(F.col("drafts").isNull(), "handler-failed").otherwise("accepted")
    )
    rows = rows.withColumn("status", status).drop("_bad", "_rank", "_apart")
    named = "id" in rows.schema["drafts"].dataType.elementType.names
    ids = F.transform("drafts", lambda d, i: _event_id(F.col("id"), d["id"] if named else None, i))
    fault = lambda d, i: (
        F.when(F.coalesce(d["type"] == "", F.lit(True)), "malformed-event")
        .when(~d["type"].isin(*known_events) if known_events is not None else F.lit(False), "unknown-event")
        .when(F.array_contains(F.slice(ids, 1, i), F.get(ids, i)), "duplicate-event")
    )
    faults = F.transform("drafts", lambda d, i: F.struct(i.alias("index"), fault(d, i).alias("code")))
    rows = rows.withColumn("_fault", F.when(F.col("status") == "accepted", F.get(F.filter(faults, lambda f: f["code"].isNotNull()), F.lit(0))))
    if named:
        rows = rows.join(_taken(rows.where("status = 'accepted'").select("ord", "_fault", F.posexplode(ids).alias("index", "event"))), "ord", "left")
        first = F.when(F.col("_fault").isNull() | (F.col("_index") < F.col("_fault.index")), F.col("_index"))
        rows = rows.withColumn("status", F.when((F.col("status") == "accepted") & first.isNotNull(), "duplicate-event").otherwise(F.col("status"))).drop("_index")
    status = F.when((F.col("status") == "accepted") & F.col("_fault").isNotNull(), F.col("_fault.code")).otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_fault").withColumn("_bucket_of", bucket)


def _event_id(command: Column, own: Column | None, index: Column) -> Column:
    """A draft's own id unless it is empty, else one of the command's id and the draft's number from 1."""
    made = prefixed_key("cqrs-event", command, index + 1)
    return made if own is None else F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(made)


def _taken(drafts: DataFrame) -> DataFrame:
    """ord and ``_index``, the first draft whose event id an accepted command before it has; for drafts (ord,
    _fault, index, event) of commands that may be accepted.

    Whether a command is accepted depends on those before it that share an id, and so on. Commands that hang
    together by shared ids form components (``graphs.components``, rounds by the logarithm of a component's width); each is one
    ordered stream of commands, with the ids taken so far as its state.
    """
    drafts = stage(drafts, "drafts")
    shared = drafts.groupBy("event").agg(F.min("ord").alias("first"), F.max("ord").alias("_last")).where("first < _last").drop("_last")
    linked = stage(drafts.join(shared, "event"), "shared-drafts")
    parts = graphs.components(linked.where("ord <> first").select(F.col("ord").alias("a"), F.col("first").alias("b")))
    own = linked.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("index", "event"))).alias("drafts"), F.max(F.col("_fault").isNotNull()).alias("bad"))
    rows = own.join(parts, F.col("ord") == F.col("node")).select("component", "ord", "drafts", "bad")

    def step(taken, r):
        met = next((x["index"] for x in r.drafts if x["event"] in taken), None)
        if met is None and not r.bad:
            taken.update(x["event"] for x in r.drafts)
        return taken, [] if met is None else [(r.ord, met)]

    kind = linked.schema
    out = T.StructType([T.StructField("ord", kind["ord"].dataType), T.StructField("_index", kind["index"].dataType)])
    return keyed_fold(rows, ["component"], ["ord"], step, set, out)


def events(handled: DataFrame) -> DataFrame:
    """Events of accepted commands: their own id or ``cqrs-event:[command,number]`` with numbers from 1 in each
    command, and a dense seq from 1 over all commands."""
    rows = handled.where("status = 'accepted'").select("ord", F.col("id").alias("command_id"), "aggregate_id", "_bucket_of", F.posexplode("drafts").alias("index", "draft"))
    own = F.col("draft.id") if "id" in rows.schema["draft"].dataType.names else None
    rows = rows.select("*", "draft.type", "draft.payload", _event_id(F.col("command_id"), own, F.col("index")).alias("id"))
    rows = stage(rows.drop("draft"), "events")  # numbering reads it twice
    return number(rows, ["ord", "index"], bucket=F.col("_bucket_of"), name="seq").drop("_bucket_of")


def bounded_dedupe(commands: DataFrame, most: int, keys: list[str], most_events: int | None = None) -> DataFrame:
    """Commands with ``code``, and how many command and event ids were forgotten so far: only the last ``most``
    command ids and ``most_events`` event ids (column ``event_id``, if given) are remembered, first in first out.

    A command id is remembered whatever becomes of the command, an event id of accepted ones. What is
    remembered depends on what was accepted, so each key (a stream of commands) is replayed in order;
    rows have ord, id and any others.
    """
    place = {c: commands.columns.index(c) for c in ("id", "event_id") if c in commands.columns}

    def remember(ids: OrderedDict, i, limit: int) -> int:
        ids[i] = None
        if len(ids) > limit:
            ids.popitem(last=False)
            return 1
        return 0

    def step(state, row):
        seen, made, gone, lost = state
        i, code = row[place["id"]], "accepted"
        if i is None or i == "":
            code = "malformed-command"
        elif i in seen:
            code = "duplicate-command"
        else:
            gone += remember(seen, i, most)
            if most_events is not None:
                event = row[place["event_id"]]
                if event in made:
                    code = "duplicate-event"
                else:
                    lost += remember(made, event, most_events)
        return (seen, made, gone, lost), [(*row, code, gone, lost)]

    more = [T.StructField("code", T.StringType()), T.StructField("commands_evicted", T.LongType()), T.StructField("events_evicted", T.LongType())]
    return keyed_fold(commands, keys, ["ord"], step, lambda: (OrderedDict(), OrderedDict(), 0, 0), T.StructType([*commands.schema.fields, *more]))


def audit(handled: DataFrame) -> DataFrame:
    """A row per command: its outcome, how many events it made, and counts of its aggregate so far."""
    w = over(["aggregate_id"], ["ord"]).rowsBetween(Window.unboundedPreceding, 0)
    made = F.when(F.col("status") == "accepted", F.size("drafts")).otherwise(0)
    rows = handled.withColumn("events", made)
    return rows.select("ord", "id", "aggregate_id", F.when(F.col("status") == "accepted", "success").otherwise("failure").alias("outcome"), "events", F.sum("events").over(w).alias("event_count"), F.count("*").over(w).alias("command_count"))


def project(events: DataFrame, types: list[str], keys: list[str], **folds: Column) -> DataFrame:
    """State per aggregate from its events of some types, as aggregates."""
    return events.where(F.col("type").isin(types)).groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def event_id(command: str, number: int, kind: str = "cqrs-event") -> str:
    """The default id of a command's event: the kind and a JSON array of strings."""
    return f"{kind}:{json.dumps([command, str(number)], separators=(',', ':'), ensure_ascii=False)}"


class Kept:
    """A process: its state, how many events, effects, commands, errors and audit rows there were, and the ids it gave out."""

    def __init__(self, state, events: int = 0, effects: int = 0, commands: int = 0, errors: int = 0, audits: int = 0):
        self.state, self.events, self.effects, self.commands, self.errors, self.audits = state, events, effects, commands, errors, audits
        self.seen: tuple = (set(), set())


def _drafted(drafts: Iterable, kind: str, command: str, before: int, seen) -> list[tuple[str, str, object]]:
    """(id, type, payload) of drafts; a ValueError if one has no type or an id that was given out before."""
    out, own = [], set()
    for n, draft in enumerate(drafts, before + 1):
        type_, payload, id_ = draft if isinstance(draft, tuple) else (draft, None, None)
        if not type_:
            raise ValueError(f"{kind} draft without a type")
        id_ = id_ or event_id(command, n, f"process-{kind}")
        if id_ in own or id_ in seen:
            raise ValueError(f"duplicate {kind} {id_}")
        own.add(id_)
        out.append((id_, type_, payload))
    return out


def reduce_command(kept: Kept, c: tuple, step: Callable) -> list[tuple]:
    """One command's facts (see ``process``); all of it happens or nothing does."""
    kept.commands += 1
    code, made = None, ([], [])
    if not c.id or not c.command_type:
        code = "malformed-command"
    else:
        try:
            new, *drafts = step(kept.state, c)
        except Exception:
            code = "reducer-threw"
        else:
            try:
                kind = "event"
                made = (_drafted(drafts[0], kind, c.id, kept.events, kept.seen[0]), [])
                kind = "effect"
                made = (made[0], _drafted(drafts[1], kind, c.id, kept.effects, kept.seen[1]))
            except ValueError:
                code, made = f"malformed-{kind}", ([], [])
    rows = []
    if code is None:
        kept.state = new
    else:
        kept.errors += 1
    for n, (kind, drafts) in enumerate((("event", made[0]), ("effect", made[1]))):
        for id_, type_, payload in drafts:
            kept.seen[n].add(id_)
            if kind == "event":
                kept.events += 1
            else:
                kept.effects += 1
            rows.append((kind, id_, type_, kept.events if kind == "event" else kept.effects, payload, None))
    kept.audits += 1
    status = ("accepted" if code is None else "failed", None, None, kept.audits, None, code)
    counters = (kept.events, kept.effects, kept.commands, kept.errors, kept.state)
    return [(c.process_id, c.ord, *row, *counters) for row in [status, *rows]]


def facts_type(process_id: T.DataType, state_type: str, payload_type: str = "long") -> T.StructType:
    kinds = T.StructType.fromDDL(
        f"ord long, kind string, id string, name string, seq long, payload {payload_type}, code string, event_seq long, effect_seq long, command_count long, error_count long, state {state_type}"
    )
    return T.StructType([T.StructField("process_id", process_id), *kinds.fields])


def process(commands: DataFrame, step: Callable, initial, state_type: str, payload_type: str = "long") -> DataFrame:
    """A state machine per process over commands (process_id, ord, id, command_type, any others).

    ``step(state, command)`` gives (state, event drafts, effect drafts); a draft is a type, or (type, payload, id), an
    empty id standing for the default one. A command's facts: a row of kind accepted or failed with its ``code`` and
    the audit number, then, if it was accepted, its events and effects with id, name (their type) and seq,
    dense per process from 1. All rows tell the cursor and the state after the command.

    Codes, in order: malformed-command (an empty id or type), reducer-threw, malformed-event, malformed-effect (an
    empty type, or an id that another draft or an accepted command of the process has). Whatever the
    code, state and ids stay as they were; commands and errors are counted. A task holds the ids of one process.
    """

    def each(kept, c):
        return kept, reduce_command(kept, c, step)

    return keyed_fold(commands, ["process_id"], ["ord"], each, lambda: Kept(initial), facts_type(commands.schema["process_id"].dataType, state_type, payload_type))


def effect_commands(outcomes: DataFrame) -> DataFrame:
    """Effect outcomes (effect_id, kind, value, error, reason) as ``effect.*`` commands, or an error.

    A result may carry a value only, a failure needs an error, cancel and timeout may carry a reason.
    """
    has = lambda c: F.col(c).isNotNull()
    error = (
        F.when(F.coalesce(F.col("effect_id") == "", F.lit(True)), "malformed-outcome")
        .when(~F.col("kind").isin("result", "failure", "cancel", "timeout"), "unknown-kind")
        .when((F.col("kind") == "result") & (has("error") | has("reason")), "unexpected-field")
        .when((F.col("kind") == "failure") & ~has("error"), "missing-error")
        .when((F.col("kind") == "failure") & (has("value") | has("reason")), "unexpected-field")
        .when(F.col("kind").isin("cancel", "timeout") & (has("value") | has("error")), "unexpected-field")
    )
    command = F.when(error.isNull(), F.concat(F.lit("effect."), "kind"))
    return outcomes.withColumn("command_type", command).withColumn("command_id", F.when(error.isNull(), prefixed_key("effect", "effect_id", "kind"))).withColumn("outcome_error", error)


def acknowledgements(deliveries: DataFrame, statuses: DataFrame, rejected_too: bool = True) -> DataFrame:
    """Deliveries (command_id, seq) paired first-in first-out with statuses of the same command, to be acknowledged."""
    d = deliveries.withColumn("_n", F.row_number().over(over(["command_id"], ["seq"])))
    s = statuses.withColumn("_n", F.row_number().over(over(["command_id"], ["ord"])))
    both = d.join(s.select("command_id", "_n", "status"), ["command_id", "_n"])
    return (both if rejected_too else both.where("status = 'accepted'")).drop("_n")


def dispositions(attempts: DataFrame, outcomes: DataFrame, deterministic: list[str]) -> DataFrame:
    """Attempts (work_id, command_id) with what becomes of their work: complete, fail (retryable or not).

    Failures of the handler or the clock fail the attempt, retryable unless listed as deterministic; every
    other reject completes the work, since a retry could not change it.
    """
    rows = attempts.join(outcomes, "command_id")
    failed = F.col("status").isin("handler-failed", "clock-failed")
    return rows.withColumn("disposition", F.when(failed, "fail").otherwise("complete")).withColumn("retryable", F.when(failed, ~F.col("status").isin(*deterministic) if deterministic else F.lit(True)))


def outbox(events: DataFrame, topic: Column) -> DataFrame:
    """Events as publish commands: key, command id ``cqrs-outbox:["id"]`` and the event id as idempotency key."""
    return events.select(topic.alias("topic"), F.col("aggregate_id").cast("string").alias("key"), prefixed_key("cqrs-outbox", "id").alias("command_id"), F.col("id").alias("idempotency_key"), "payload")
