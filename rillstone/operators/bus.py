"""Message bus: publish fold, dead letters, retention, pages, subscriptions and payload checks.

Command rows have ord, kind, topic, command_id, idempotency_key, payload and now_ms (subscription_id, seq,
start and policy where a kind has them), in order of ``ord``. Everything that one command finds as an earlier one
left it (the policy, a topic's head and tail) is looked up as of its ``ord``.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import keyed_fold
from ..functions.order import number, over, running_max
from ..functions.staging import sized, stage


#: Rows of a topic's order, by ``ord``, that are numbered in one task.
PER_BUCKET = 1000


def fresh(commands: DataFrame) -> DataFrame:
    """Commands with ``_stop``: malformed-command (an empty topic or subscription id), else duplicate-command
    (a command id that a well-formed command of any kind had before), else null.

    Rows that cannot have a duplicate are parted by their ord, lest all rows without an id meet in one task.
    """
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    bad = blank("topic") & (F.col("kind") != "topic_policy")
    if "subscription_id" in commands.columns:
        bad = bad | (F.col("kind").isin("ack", "seek", "close_subscription") & blank("subscription_id"))
    rows = commands.withColumn("_bad", bad).withColumn("_apart", F.when(F.col("_bad") | F.col("command_id").isNull(), F.col("ord")))
    nth = F.row_number().over(over(["command_id", "_apart"], ["ord"]))
    stop = F.when(F.col("_bad"), "malformed-command").when(nth > 1, "duplicate-command")
    return rows.withColumn("_stop", stop).drop("_bad", "_apart")


def topics(commands: DataFrame, strict: bool = True, per_bucket: int = PER_BUCKET) -> DataFrame:
    """topic, opened and closed: the ord from which it exists and of the first close after that (null if none).

    ``commands`` as ``fresh`` gives them, staged. A publish makes its topic by the last topic_policy command (``policy``:
    strict or create) before it, and by ``strict`` before the first; without a policy column that alone counts. Only the
    few columns that this takes are brought in order.
    """
    able = commands.where("_stop IS NULL")
    makes = able.where("kind = 'publish'").select("ord", "topic")
    if "policy" in commands.columns:
        rows = able.where("kind IN ('publish', 'topic_policy')").select("ord", "topic", "kind", "policy")
        set_ = F.when(F.col("kind") == "topic_policy", F.struct("ord", "policy"))
        rows = running_max(rows, {"_policy": set_}, ["ord"], bucket=F.floor(F.col("ord") / per_bucket))
        makes = rows.where((F.col("kind") == "publish") & F.coalesce(F.col("_policy.policy") == "create", F.lit(not strict))).select("ord", "topic")
    elif strict:
        makes = makes.where(F.lit(False))
    opened = able.where("kind = 'ensure_topic'").select("ord", "topic").union(makes).groupBy("topic").agg(F.min("ord").alias("opened"))
    closes = able.where("kind = 'close_topic'").groupBy("topic", "ord").count().join(opened, "topic").where("ord > opened")
    return opened.join(closes.groupBy("topic").agg(F.min("ord").alias("closed")), "topic", "left")


def checked(commands: DataFrame, strict: bool = True, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Commands as ``fresh`` gives them and their ``topics``, both staged: what ``publish``, ``as_of`` and ``issues`` begin with.

    They take it as ``known``, so that several of them on the same commands order these once.
    """
    rows = stage(fresh(commands), "commands")
    return rows, stage(topics(rows, strict, per_bucket), "topics")


def publish(commands: DataFrame, strict: bool = True, per_bucket: int = PER_BUCKET, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Publish commands with ``status`` (published, duplicate-command, malformed-command, unknown-topic,
    closed-topic) and the dense seq per topic, from 1, of published ones.

    Checks go in order: an empty topic; a command id that a well-formed command of any kind had before,
    whatever became of it; an idempotency key of a message *published* before; a topic that is not open. A
    topic is open from its first ensure to the first close after it; a publish opens it too if the policy
    of its time is to create (``strict`` says so before the first policy command). ``known`` is what ``checked`` gives.
    """
    rows, made = known or checked(commands, strict, per_bucket)
    made = made.select(F.col("topic").alias("_topic"), F.col("opened").alias("_from"), F.col("closed").alias("_to"))
    rows = rows.where("kind = 'publish'").join(sized(made), F.col("topic") == F.col("_topic"), "left")
    closed = F.coalesce(F.col("ord") > F.col("_to"), F.lit(False))
    opened = F.coalesce(F.col("ord") >= F.col("_from"), F.lit(False))
    rows = rows.withColumn("_bad_topic", F.when(~opened, "unknown-topic").when(closed, "closed-topic"))
    able = F.col("_stop").isNull() & F.col("_bad_topic").isNull()
    # The key of a message published earlier turns a later command into a duplicate, whether or not its topic still is open.
    keyed = Window.partitionBy("topic", "idempotency_key", F.when(F.col("idempotency_key").isNull(), F.col("ord")))
    first = F.min(F.when(able, F.col("ord"))).over(keyed)
    again = F.coalesce(first < F.col("ord"), F.lit(False))
    status = F.coalesce("_stop", F.when(again, "duplicate-command"), "_bad_topic", F.lit("published"))
    rows = stage(rows.withColumn("status", status).drop("_topic", "_from", "_to", "_stop", "_bad_topic"), "publishes")  # numbering reads it twice
    rows = number(rows, ["ord"], ["topic", "status"], F.floor(F.col("ord") / per_bucket), "seq")
    return rows.withColumn("seq", F.when(F.col("status") == "published", F.col("seq").cast("long")))


#: What an event message may carry beside id, type and payload.
EVENT_FIELDS = ("key", "subject_id", "correlation_id", "causation_id", "occurred_at_ms", "actor", "evidence_refs", "schema", "metadata")


def event_message(rows: DataFrame, id_: Column, type_: Column, payload: Column, **fields: Column) -> DataFrame:
    """Rows with id, type, payload and the given EVENT_FIELDS of an event message, and ``error``: null, or what is wrong with it (the type first)."""
    if unknown := fields.keys() - set(EVENT_FIELDS):
        raise ValueError(f"no field of an event message: {', '.join(sorted(unknown))}")
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    error = F.when(blank(type_), "eventMessage.type must be non-empty").when(blank(id_), "eventMessage.id must be non-empty")
    return rows.withColumns({"id": id_, "type": type_, "payload": payload, "error": error} | fields)


def to_topic(rows: DataFrame, topic: str, payload: str, order: str, now_ms: str | None = None) -> DataFrame:
    """Publish commands of a source's rows, in its order, without ids or keys: what a topic fed by the source is sent."""
    none = F.lit(None).cast("string")
    now = F.col(now_ms) if now_ms else F.lit(None).cast("long")
    return rows.select(F.col(order).alias("ord"), F.lit("publish").alias("kind"), F.lit(topic).alias("topic"), none.alias("command_id"), none.alias("idempotency_key"), F.col(payload).alias("payload"), now.alias("now_ms"))


def dead_letters(published: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Rejected commands, numbered over all topics from 1 in order of ``ord`` without one task holding them."""
    bad = published.where(F.col("status").isin("malformed-command", "unknown-topic", "closed-topic"))
    return number(bad, ["ord"], bucket=F.floor(F.col("ord") / per_bucket), name="entry_seq")


def dead_letter_page(letters: DataFrame, after: int = 0, limit: int = 100, topic: str | None = None, code: str | None = None) -> DataFrame:
    """The next ``limit`` dead letters after an entry seq, of a topic and status if given, with has_more."""
    rows = letters.where(F.col("entry_seq") > after)
    rows = rows if topic is None else rows.where(F.col("topic") == topic)
    rows = rows if code is None else rows.where(F.col("status") == code)
    return _page(rows, "entry_seq", limit)


def _page(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows and whether there are more: at most one row more than that is looked at."""
    if limit <= 0:
        raise ValueError("a page needs a positive limit")
    some = rows.orderBy(order).limit(limit + 1)
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
    return some.withColumn("_r", nth).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_r") <= limit).drop("_r")


def catalog(commands: DataFrame, messages: DataFrame, left: DataFrame, strict: bool = True) -> DataFrame:
    """topic, closed, head_seq, next_seq and message_count of every topic that was made."""
    made = checked(commands, strict)[1].select("topic", F.col("closed").isNotNull().alias("closed"))
    kept = left.groupBy("topic").agg(F.count("*").alias("message_count"))
    out = made.join(heads(messages, left), "topic", "left").join(kept, "topic", "left")
    return out.select(
        "topic", "closed", F.coalesce("head_seq", F.lit(1)).cast("long").alias("head_seq"), F.coalesce("tail_seq", F.lit(1)).cast("long").alias("next_seq"),
        F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"),
    )


def catalog_page(entries: DataFrame, after: str = "", limit: int = 100, include_closed: bool = False) -> DataFrame:
    """The next ``limit`` entries of a catalog after a topic, in order of topics, with has_more."""
    rows = entries.where(F.col("topic") > after)
    return _page(rows if include_closed else rows.where("not closed"), "topic", limit)


def retained(messages: DataFrame, most: int | None = None, max_age_ms: int | None = None) -> DataFrame:
    """Messages that are left after the last publish to their topic: the newest ``most``, none older than the age.

    The clock of a topic never goes back, so what age leaves is the end of the topic, and as seqs are
    dense two aggregates per topic tell the rest.
    """
    if most is not None and most <= 0:
        raise ValueError("policy-rejected: retention must leave a positive number of messages")
    last = messages.groupBy(F.col("topic").alias("_topic")).agg(F.max("seq").alias("_last"), F.max_by("now_ms", "seq").alias("_now"))
    rows = messages.join(last, F.col("topic") == F.col("_topic"))
    if max_age_ms is not None:
        rows = rows.where(F.col("_now") - F.col("now_ms") <= max_age_ms)
    if most is not None:
        rows = rows.where(F.col("seq") > F.col("_last") - most)
    return rows.drop("_topic", "_last", "_now")


#: Milliseconds of a topic's clock whose messages are counted in one task.
SLOT = 600_000


def timed(messages: DataFrame, most: int | None = None, max_age_ms: int | None = None, per_bucket: int = PER_BUCKET, slot: int = SLOT) -> DataFrame:
    """Published messages with head_seq after each publish and trimmed, by how much it moved the head.

    A publish to a topic drops what is older than the age by the topic's clock (the greatest now_ms so far),
    then all but the newest ``most``. Seqs are dense, so the head follows from the number of messages whose
    time is before the age. Where the clock goes on, the seq before tells how many messages the time before has behind it,
    and the publish asks at its own time less the age; others find what the last such publish did.
    """
    if most is not None and most <= 0:
        raise ValueError("policy-rejected: retention must leave a positive number of messages")
    by_seq = F.floor(F.col("seq") / per_bucket)
    rows = messages.select("topic", "ord", "seq", "now_ms")
    head = lambda seq, gone: F.greatest(F.lit(1), F.lit(1) if most is None else seq - most + 1, gone + 1).cast("long")
    if max_age_ms is not None:
        rows = stage(rows, "messages")
        clocks = stage(running_max(rows, {"clock": F.col("now_ms")}, ["seq"], ["topic"], by_seq, "_before").drop("now_ms"), "clocks")
        goes_on = F.coalesce(F.col("clock") > F.col("clock_before"), F.col("clock").isNotNull())
        none = F.lit(None).cast("long")
        asks = clocks.where(goes_on).select("topic", "ord", "seq", (F.col("clock") - max_age_ms).alias("at"), F.lit(0).alias("n"), none.alias("past"))
        tells = clocks.where(goes_on).select("topic", "ord", "seq", F.col("clock_before").alias("at"), F.lit(1).alias("n"), (F.col("seq") - 1).alias("past"))
        found = running_max(asks.union(tells), {"past": F.col("past")}, ["at", "n"], ["topic"], F.floor(F.col("at") / slot)).where("n = 0")
        still = clocks.where(~goes_on).select("topic", "ord", "seq", none.alias("past"))
        rows = stage(found.select("topic", "ord", "seq", "past").union(still), "past")
        rows = running_max(rows, {"gone": F.col("past")}, ["seq"], ["topic"], by_seq, "_before")
    gone, before = (F.coalesce(F.col(c), F.lit(0)) if max_age_ms is not None else F.lit(0) for c in ("gone", "gone_before"))
    # Seqs are dense, so the head before a publish is that of one seq earlier.
    last = F.when(F.col("seq") > 1, head(F.col("seq") - 1, before)).otherwise(F.lit(1))
    rows = rows.withColumn("head_seq", head(F.col("seq"), gone)).withColumn("trimmed", F.col("head_seq") - last)
    return rows.select("topic", "ord", "seq", "head_seq", "trimmed")


def trims(log: DataFrame) -> DataFrame:
    """A RetentionTrimmed fact per publish that moved its topic's head: topic, ord, seq that did, head_seq and trim_count. ``log`` is ``timed``'s."""
    return log.where("trimmed > 0").select("topic", "ord", "seq", "head_seq", F.col("trimmed").alias("trim_count"))


def heads(messages: DataFrame, left: DataFrame) -> DataFrame:
    """topic, head_seq (the first message left, or one past the last) and tail_seq (one past the last)."""
    tail = messages.groupBy("topic").agg((F.max("seq") + 1).alias("tail_seq"))
    head = left.groupBy("topic").agg(F.min("seq").alias("_head"))
    return tail.join(head, "topic", "left").select("topic", F.coalesce("_head", "tail_seq").alias("head_seq"), "tail_seq")


def topic_page(messages: DataFrame, after: int | None = None, limit: int = 100) -> DataFrame:
    """Per topic the next ``limit`` messages after a seq (None: from the head), with has_more and next_after (null
    on the last page). Seqs of retained messages are dense, so two bounds per topic find the page."""
    if limit <= 0:
        raise ValueError("a page needs a positive limit")
    ends = messages.groupBy(F.col("topic").alias("_topic")).agg(F.min("seq").alias("_head"), F.max("seq").alias("_last"))
    start = F.greatest("_head", F.lit(0 if after is None else after + 1))
    rows = messages.join(ends, F.col("topic") == F.col("_topic")).where((F.col("seq") >= start) & (F.col("seq") < start + limit))
    more = F.col("_last") >= start + limit
    return rows.withColumns({"has_more": more, "next_after": F.when(more, start + limit - 1)}).drop("_topic", "_head", "_last")


def available(cursors: DataFrame, left: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """The next messages of each subscription (subscription_id, topic, next_seq); none if retention has passed it.

    Only the first ``limit`` messages at a cursor can be asked for, so the join is on topic and seq.
    """
    ok = cursors.join(ends, "topic").where(F.col("next_seq") >= F.col("head_seq"))
    wanted = ok.withColumn("seq", F.explode(F.sequence(F.col("next_seq"), F.col("next_seq") + limit - 1)))
    return wanted.select("subscription_id", "topic", "seq").join(left, ["topic", "seq"])


def as_of(commands: DataFrame, log: DataFrame, strict: bool = True, per_bucket: int = PER_BUCKET, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Well-formed subscription commands (subscribe, ack, seek, close_subscription) with head_seq and tail_seq of their
    topic at their time, null before it exists. ``log`` is ``timed``'s, of the same commands, ``known`` what ``checked`` gives."""
    rows, made = known or checked(commands, strict, per_bucket)
    own = rows.where(F.col("kind").isin("subscribe", "ack", "seek", "close_subscription") & F.col("_stop").isNull())
    opened = made.select("topic", F.col("opened").alias("ord"), F.lit(1).cast("long").alias("_head"), F.lit(1).cast("long").alias("_tail"))
    moved = log.select("topic", "ord", F.col("head_seq").alias("_head"), (F.col("seq") + 1).alias("_tail"))
    names = ["ord", "topic", "subscription_id", "kind", "seq", "start"]
    both = own.select(*names).unionByName(opened.union(moved), allowMissingColumns=True)
    both = running_max(both, {"head_seq": F.col("_head"), "tail_seq": F.col("_tail")}, ["ord"], ["topic"], F.floor(F.col("ord") / per_bucket))
    return both.where("kind IS NOT NULL").select(*names, "head_seq", "tail_seq")


_FACTS = "ord long, topic string, subscription_id string, code string, next_seq long, closed boolean, retention_gap boolean"


def _facts(commands: DataFrame) -> DataFrame:
    """The facts of ``subscriptions``, and a row without ord wherever a cursor may be overtaken by retention after it: with
    code overtaken where a later command has found it so, else open."""

    def step(state, r):
        cursor, closed, gap = state
        out = []
        if cursor is not None and not closed and not gap and r.head_seq is not None and max(cursor, 1) < r.head_seq:
            gap = True
            out.append((None, r.topic, r.subscription_id, "overtaken", cursor, False, True))
        if r.kind == "subscribe":
            code = "kept"
            if cursor is None and r.head_seq is None:
                code, cursor = "subscribed", r.seq if r.start is None else 1
            elif cursor is None:
                want = r.head_seq if r.start == "earliest" else r.tail_seq if r.start == "latest" else r.seq
                inside = want is not None and r.head_seq <= want <= r.tail_seq
                code, cursor = ("subscribed", want) if inside else ("cursor-out-of-range", r.head_seq)
        elif r.head_seq is None:
            code = "unknown-topic"
        elif cursor is None:
            code = "unknown-subscription"
        elif r.kind == "close_subscription":
            code, closed = "closed", True
        elif closed:
            code = "subscription-closed"
        elif r.kind == "ack":
            code = "retention-gap" if gap else "source-cursor-stale" if r.seq < cursor else "cursor-out-of-range" if r.seq >= r.tail_seq else "acked"
            cursor = r.seq + 1 if code == "acked" else cursor
        else:
            code = "retention-gap" if r.seq < r.head_seq else "cursor-out-of-range" if r.seq > r.tail_seq else "sought"
            cursor, gap = (r.seq, False) if code == "sought" else (cursor, gap)
        return (cursor, closed, gap), [*out, (r.ord, r.topic, r.subscription_id, code, cursor, closed, gap)]

    def end(key, state):
        cursor, closed, gap = state
        return [] if cursor is None or closed or gap else [(None, *key, "open", cursor, False, False)]

    return keyed_fold(commands, ["topic", "subscription_id"], ["ord"], step, lambda: (None, False, False), _FACTS, end)


def subscriptions(commands: DataFrame) -> DataFrame:
    """A fact per subscribe (start), ack, seek and close command: its code, and the cursor after it.

    Columns: ord, topic, subscription_id, kind, seq, start (earliest, latest or null with seq) and the
    topic's head_seq and tail_seq (one past the last message) of its time, as ``as_of`` gives them; null: no such topic.
    Codes: subscribed, kept (it was there already), acked, sought, closed, or the issue. A start outside
    the topic is an issue and counts as its head; one at a topic that is not there yet is taken as it is.
    A cursor that retention has passed is a gap until it seeks. Each subscription is one ordered
    stream. The last fact is its cursor, see ``cursors``.
    """
    return _facts(commands).where("ord IS NOT NULL")


def subscription_gaps(commands: DataFrame, log: DataFrame, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The facts of ``subscriptions`` over commands as ``as_of`` gives them, and a row per time that a trim overtakes an open cursor.

    A gap has topic, subscription_id, ord of the publish whose trim did it, next_seq and head_seq after
    it; a subscription has the next one only after a seek. A cursor is overtaken by the trim that takes
    its message: the last one that began at or before it.
    """
    facts = stage(_facts(commands), "subscription-facts")
    moves = log.where("trimmed > 0").select("topic", (F.col("head_seq") - F.col("trimmed")).alias("at"), F.struct((F.col("head_seq") - F.col("trimmed")).alias("from"), "head_seq", "ord").alias("trim"))
    cursors_ = facts.where("ord IS NULL").select("topic", "subscription_id", "next_seq", F.greatest("next_seq", F.lit(1)).alias("at"))
    both = moves.unionByName(cursors_, allowMissingColumns=True).withColumn("asks", F.col("trim").isNull())
    found = running_max(both, {"last": F.col("trim")}, ["at", "asks", "subscription_id"], ["topic"], F.floor(F.col("at") / per_bucket))
    gone = found.where(F.col("asks") & (F.col("last.head_seq") > F.col("at")))
    return facts.where("ord IS NOT NULL"), gone.select("topic", "subscription_id", F.col("last.ord").alias("ord"), "next_seq", F.col("last.head_seq").alias("head_seq"))


ISSUES = ("malformed-command", "unknown-topic", "closed-topic", "unknown-subscription", "subscription-closed", "retention-gap", "source-cursor-stale", "cursor-out-of-range")


def issues(commands: DataFrame, published: DataFrame, facts: DataFrame, gaps: DataFrame, strict: bool = True, duplicates: bool = False, per_bucket: int = PER_BUCKET, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every dead letter of the bus, numbered from 1 as they came: entry_seq, ord, topic, subscription_id and code.

    Of a publish come its own issue and then those of the subscriptions that its trim overtook, by their id.
    Duplicates are issues if asked, else they are status facts only.
    """
    text = lambda c: F.col(c) if isinstance(c, str) else c
    row = lambda df, code, topic="topic", sub=None: df.select("ord", text(topic).alias("topic"), (F.lit(None).cast("string") if sub is None else text(sub)).alias("subscription_id"), text(code).alias("code"))
    rows, made = known or checked(commands, strict, per_bucket)
    stopped = row(rows.where("kind <> 'publish' AND _stop IS NOT NULL"), "_stop")
    made = made.select(F.col("topic").alias("_topic"), "opened")
    closes = rows.where("kind = 'close_topic' AND _stop IS NULL").join(made, F.col("topic") == F.col("_topic"), "left").where("opened IS NULL OR ord < opened")
    every = row(published.where("status <> 'published'"), "status").union(stopped).union(row(closes, F.lit("unknown-topic")))
    every = every.union(row(facts, "code", sub="subscription_id")).union(row(gaps, F.lit("retention-gap"), F.lit(None).cast("string"), "subscription_id"))
    every = stage(every.where(F.col("code").isin(*ISSUES, *(["duplicate-command"] if duplicates else []))), "issues")
    return number(every, ["ord", "subscription_id"], bucket=F.floor(F.col("ord") / per_bucket), name="entry_seq")


def cursors(facts: DataFrame) -> DataFrame:
    """topic, subscription_id, next_seq, closed and retention_gap of each subscription after its last command."""
    last = facts.groupBy("topic", "subscription_id").agg(F.max_by(F.struct("next_seq", "closed", "retention_gap"), "ord").alias("c"))
    return last.select("topic", "subscription_id", "c.*").where("next_seq IS NOT NULL")


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, (int, float)) and not isinstance(value, bool) and float(value).is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, {"string": str, "boolean": bool, "null": type(None), "array": list, "object": dict}[kind])


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def schema_error(value, schema: dict, root: dict, path: str = "$") -> tuple[str, str] | None:
    """The first (path, message) at which a value breaks a schema of the supported subset, or None."""
    if "$ref" in schema:
        schema = root.get("definitions", {}).get(schema["$ref"].rpartition("/")[2], {})
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return path, f"expected {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "const" in schema and not _same(value, schema["const"]):
        return path, "not the constant"
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        return path, "not in the enumeration"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}", "required"
        for name, item in value.items():
            rule = own.get(name, schema.get("additionalProperties", True))
            if rule is False:
                return f"{path}.{name}", "not allowed"
            if isinstance(rule, dict) and (found := schema_error(item, rule, root, f"{path}.{name}")):
                return found
    if isinstance(value, list):
        items = schema.get("items", {})
        for i, item in enumerate(value):
            rule = (items[i] if i < len(items) else {}) if isinstance(items, list) else items
            if found := schema_error(item, rule, root, f"{path}[{i}]"):
                return found
    return None


def validate_payloads(df: DataFrame, payload: str, schema: dict) -> DataFrame:
    """``df`` with valid, path and message of its JSON payloads against one schema; null or broken JSON is invalid."""

    def check(batches):
        for batch in batches:
            valid, paths, messages = [], [], []
            for text in batch.column(batch.schema.get_field_index(payload)).to_pylist():
                try:
                    found = schema_error(json.loads(text), schema, schema)
                except (TypeError, ValueError):
                    found = ("$", "not JSON")
                valid.append(found is None)
                paths.append(found and found[0])
                messages.append(found and found[1])
            arrays = [*batch.columns, pa.array(valid), pa.array(paths, pa.string()), pa.array(messages, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "valid", "path", "message"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(check, f"{kinds}, valid boolean, path string, message string")
