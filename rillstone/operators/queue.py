"""Work queue: admission, command fold per queue, state from records, pages, readiness handoff.

A queue's claims look at all its ready work in first-in order, so one queue is one ordered stream: queues
are the unit of parallelism. Everything around the fold is plain aggregates and joins.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import keyed_fold
from ..functions.ids import prefixed_key
from ..functions.order import over

RECORD = (
    "queue_id string, record_seq long, kind string, work_id string, command_id string, lease_id string, attempt long, "
    "worker_id string, due_ms long, reason string, now_ms long"
)
TERMINAL = ("completed", "dead", "canceled")
#: What no two commands may share, and what tells that it comes again.
USED = (("command_id", "_id_more"), ("idempotency_key", "_key_more"))


def admit(messages: DataFrame) -> DataFrame:
    """Messages (queue_id, topic, seq, work_id or null, not_before_ms, now_ms) as admissions: one per work id.

    kind is WorkAdmitted, or AdmissionDeduped for a known id; state is scheduled or ready.
    """
    default = prefixed_key("work-queue-work", "queue_id", "topic", "seq")
    rows = messages.withColumn("work_id", F.coalesce("work_id", default))
    first = F.row_number().over(over(["queue_id", "work_id"], ["topic", "seq"])) == 1
    late = F.coalesce(F.col("not_before_ms") > F.col("now_ms"), F.lit(False))
    return rows.withColumn("kind", F.when(first, "WorkAdmitted").otherwise("AdmissionDeduped")).withColumn("state", F.when(late, "scheduled").otherwise("ready"))


class Queue:
    """The works of one queue. Ready works wait in a heap by admission, delayed ones and leases in heaps by time;
    entries that no longer fit their work are passed over when they come up."""

    def __init__(self, lease_ms: int, attempts: int, retry_ms: int):
        self.lease_ms, self.attempts, self.retry_ms = lease_ms, attempts, retry_ms
        self.works: dict[str, dict] = {}
        self.ready: list[tuple] = []
        self.delayed: list[tuple] = []
        self.leases: list[tuple] = []
        self.numbers = {"record": 0, "lease": 0, "admission": 0}
        self.out: list[tuple] = []
        self.seen: set[tuple] = set()

    def known(self, c) -> bool:
        """Whether an earlier command that stood has this one's id or idempotency key. Kept are those that come again
        only, as ``_id_more`` and ``_key_more`` of a command tell; the key of a refused duplicate is not taken."""
        formed = c["_formed"] = is_formed(c)
        seen, again = self.seen, False
        used = [(name, value, c.get(more)) for name, more in USED if (value := c.get(name))]
        for name, value, _ in used:
            again = again or (name, value) in seen
        for name, value, more in used:
            if not more:
                seen.discard((name, value))
            elif formed and not again:
                seen.add((name, value))
        return formed and again

    def emit(self, kind, c, work=None, due=None, reason=None):
        if kind != "Issue":
            self.numbers["record"] += 1
        w = work or {}
        seq = self.numbers["record"] if kind != "Issue" else None
        self.out.append((c["queue_id"], seq, kind, w.get("id", c["work_id"]), c["command_id"], w.get("lease"), w.get("attempt"), w.get("worker"), due, reason, c["now_ms"]))

    def free(self, work, state, due=None):
        work.update(state=state, due=due, lease=None, worker=None, until=None)
        if state == "ready":
            heapq.heappush(self.ready, (work["seq"], work["id"]))
        elif state in ("scheduled", "retry-wait"):
            heapq.heappush(self.delayed, (due, work["seq"], work["id"]))

    def finish(self, work, state):
        """A finished work is known by its id and state alone from now on."""
        self.works[work["id"]] = {"id": work["id"], "seq": work["seq"], "state": state}

    def expire(self, work, c):
        self.emit("LeaseExpired", c, work)
        self.free(work, "ready")

    def expired(self, c, named: list[str], most: int | None = None) -> list[dict]:
        """Works whose lease has ended, by their id, as many as asked for; of the named ones if some are named."""
        now = c["now_ms"]
        if named:
            works = [w for i in sorted(named) if (w := self.works.get(i))]
            return [w for w in works if w["state"] == "leased" and w["until"] <= now][:most]
        found = {}
        while self.leases and self.leases[0][0] <= now:
            entry = heapq.heappop(self.leases)
            work = self.works[entry[2]]
            if work["state"] == "leased" and work["until"] == entry[0]:
                found[work["id"]] = (work, entry)
        order = sorted(found)
        for i in order[most:] if most is not None else []:
            heapq.heappush(self.leases, found[i][1])
        return [found[i][0] for i in order[:most]]

    def is_ready(self, work, now) -> bool:
        return work["state"] == "ready" or (work["state"] in ("scheduled", "retry-wait") and work["due"] <= now)

    def able(self, c, named: list[str]) -> list[dict]:
        """The first ready works, of the named ones if some are named, as many as the claim's limit (one, or all that are named)."""
        now, most = c["now_ms"], int(c["limit"] or max(len(named), 1))
        if named:
            works = [w for i in named if (w := self.works.get(i)) and self.is_ready(w, now)]
            return sorted(works, key=lambda w: w["seq"])[:most]
        while self.delayed and self.delayed[0][0] <= now:
            due, seq, work_id = heapq.heappop(self.delayed)
            work = self.works[work_id]
            if work["state"] in ("scheduled", "retry-wait") and work["due"] == due:
                heapq.heappush(self.ready, (seq, work_id))
        found, later = [], []
        while self.ready and len(found) < most:
            seq, work_id = heapq.heappop(self.ready)
            work = self.works[work_id]
            if work in found:
                continue
            if self.is_ready(work, now):
                found.append(work)
            elif work["state"] in ("scheduled", "retry-wait"):  # the clock went back
                later.append((work["due"], seq, work_id))
        for entry in later:
            heapq.heappush(self.delayed, entry)
        return found

    def held(self, c):
        work = self.works.get(c["work_id"])
        if work is None:
            return None, "unknown-work"
        if work["state"] in TERMINAL:
            return None, "terminal-work"
        if work["state"] != "leased":
            return None, "lease-not-current"
        for name, want, reason in (("lease", c["lease_id"], "stale-lease"), ("attempt", c["attempt"], "attempt-mismatch"), ("worker", c["worker_id"], "worker-mismatch")):
            if want is not None and work[name] != want:
                return None, reason
        if work["until"] <= c["now_ms"]:
            self.expire(work, c)
            return None, "lease-expired"
        return work, None

    def lease(self, work, c):
        work["until"] = c["now_ms"] + (c.get("lease_duration_ms") or self.lease_ms)
        heapq.heappush(self.leases, (work["until"], work["seq"], work["id"]))

    def apply(self, c: dict) -> list[tuple]:
        """One command's records and issues."""
        self.out = []
        kind = c["kind"]
        if not (c["_formed"] if "_formed" in c else is_formed(c)):
            self.emit("Issue", c, reason="malformed-command")
        elif c["_again"]:
            self.emit("Issue", c, reason="duplicate-command")
        elif kind == "submit":
            self.submit(c)
        elif kind in ("claim", "expire_leases"):
            self.claim(c)
        elif kind in ("cancel", "schedule"):
            self.move(c)
        else:
            work, reason = self.held(c)
            if work is None:
                self.emit("Issue", c, reason=reason)
            elif kind == "renew_lease":
                self.lease(work, c)
                self.emit("LeaseRenewed", c, work, work["until"])
            elif kind == "release":
                self.emit("WorkReleased", c, work)
                self.free(work, "ready")
            elif kind == "complete":
                self.emit("AttemptCompleted", c, work)
                self.emit("WorkCompleted", c, work)
                self.finish(work, "completed")
            elif kind == "fail":
                self.fail(c, work)
            else:
                self.emit("Issue", c, reason="malformed-command")
        return self.out

    def submit(self, c):
        if c["work_id"] in self.works:
            self.emit("AdmissionDeduped", c)
            return
        self.numbers["admission"] += 1
        due = c["not_before_ms"]
        self.works[c["work_id"]] = work = {"id": c["work_id"], "seq": self.numbers["admission"], "attempt": 0}
        self.free(work, "scheduled" if due is not None and due > c["now_ms"] else "ready", due)
        self.emit("WorkAdmitted", c, work, due)

    def claim(self, c):
        expiring, named = c["kind"] == "expire_leases", named_works(c)
        for work in self.expired(c, named, c["limit"] if expiring else None):
            self.expire(work, c)
        if expiring:
            return
        able = self.able(c, named)
        for work in able:
            self.numbers["lease"] += 1
            work.update(state="leased", lease=lease_id(work["id"], self.numbers["lease"]), attempt=work["attempt"] + 1, worker=c["worker_id"], due=None)
            self.lease(work, c)
            self.emit("WorkClaimed", c, work, work["until"])
        if not able and not named:
            self.emit("Issue", c, reason="not-ready")
        taken = {w["id"] for w in able}
        for i in sorted(i for i in named if i not in taken):
            if reason := self.miss(i, c["now_ms"]):
                self.emit("Issue", c, {"id": i}, reason=reason)

    def miss(self, work_id, now) -> str | None:
        """Why a claim did not get a work; None if it was beyond the limit alone."""
        work = self.works.get(work_id)
        if work is None:
            return "unknown-work"
        if self.is_ready(work, now):
            return None
        return "terminal-work" if work["state"] in TERMINAL else "already-leased" if work["state"] == "leased" else "not-ready"

    def move(self, c):
        work, cancel = self.works.get(c["work_id"]), c["kind"] == "cancel"
        if work is None or work["state"] in TERMINAL or (work["state"] == "leased" and not cancel):
            self.emit("Issue", c, reason="unknown-work" if work is None else "terminal-work" if work["state"] in TERMINAL else "schedule-conflict")
        elif cancel:
            self.free(work, "canceled")
            self.emit("WorkCanceled", c, work)
            self.finish(work, "canceled")
        else:
            self.free(work, "scheduled", c["not_before_ms"] or c["now_ms"])
            self.emit("WorkScheduled", c, work, work["due"])

    def fail(self, c, work):
        self.emit("AttemptFailed", c, work)
        if c["retryable"] is not False and work["attempt"] < self.attempts:
            self.free(work, "retry-wait" if self.retry_ms else "ready", c["now_ms"] + self.retry_ms)
            self.emit("RetryScheduled", c, work, work["due"], "retry-policy")
        else:
            self.emit("WorkDeadLettered", c, work, reason="attempts-exhausted")
            self.finish(work, "dead")


def lease_id(work_id: str, number: int) -> str:
    """The id of the queue's lease of that number."""
    return f"work-queue-lease:{_encode([work_id, str(number)])}"


_encode = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def named_works(c: dict) -> list[str]:
    """The works that a claim or an expiry names, each once: those of ``work_ids``, or else ``work_id``."""
    named = [i for i in c.get("work_ids") or [] if i is not None] or [c["work_id"]]
    return list(dict.fromkeys(i for i in named if i is not None))


def is_formed(c: dict) -> bool:
    """Whether a command has an id, and what its kind needs: a work, or a worker and sound options for a claim."""
    if not c["command_id"]:
        return False
    if c["kind"] == "claim":
        return bool(c["worker_id"]) and c["limit"] != 0 and c.get("lease_duration_ms") != 0 and "" not in named_works(c)
    return c["kind"] == "expire_leases" or bool(c["work_id"])


def fold(commands: DataFrame, lease_ms: int, attempts: int, retry_ms: int = 0) -> DataFrame:
    """Commands (queue_id, ord, command_id, kind, work_id, lease_id, attempt, worker_id, limit, not_before_ms, retryable, now_ms;
    lease_duration_ms if leases differ, work_ids if claims or expiries name several works, idempotency_key if there are such) of all
    queues as records and issues.

    A claim that names works takes those that are ready, first admitted first, and says of each other one why it is not
    to be had (unknown-work, terminal-work, already-leased, not-ready), by id. A lease that ended makes its work ready again,
    whatever its attempts; expire_leases ends as many as its limit, by work id. A command whose id or key an earlier one
    used that was itself no duplicate is a duplicate; empty keys are none.

    Spark deals queues out once, marks the ids and keys that come again and passes each queue's commands on in order, as a stream; what a task holds is the
    works of one queue, of finished ones the id and state, and ids and keys between their uses. A command costs the logarithm of
    the works' number.
    """
    rows = commands.repartition("queue_id")  # which the windows below keep to, as they are within queues
    for name, more in USED:
        if name in rows.columns:
            rows = rows.withColumn("_apart", F.when(F.coalesce(F.col(name), F.lit("")) == "", F.col("ord")))
            rows = rows.withColumn(more, F.lead("ord").over(over(["queue_id", name, "_apart"], ["ord"])).isNotNull()).drop("_apart")
    names = rows.columns

    def step(queue, row):
        c = dict(zip(names, row, strict=True))
        c["_again"] = queue.known(c)
        return queue, queue.apply(c)

    return keyed_fold(rows, ["queue_id"], ["ord"], step, lambda: Queue(lease_ms, attempts, retry_ms), RECORD, dealt=True)


#: The state a record leaves its work in; other kinds change none.
STATES = {
    "WorkAdmitted": "ready", "WorkClaimed": "leased", "LeaseRenewed": "leased", "WorkReleased": "ready", "WorkCompleted": "completed",
    "RetryScheduled": "retry-wait", "WorkDeadLettered": "dead", "WorkCanceled": "canceled", "WorkScheduled": "scheduled", "LeaseExpired": "ready",
}


def states(records: DataFrame) -> DataFrame:
    """State of each work from its last record that changes one: partial aggregation, no window."""
    rows = records.where(F.col("kind").isin(*STATES))
    last = rows.groupBy("queue_id", "work_id").agg(F.max_by(F.struct("kind", "due_ms", "record_seq", "lease_id"), "record_seq").alias("r"), F.min("record_seq").alias("admission_seq"))
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    state = F.when((F.col("r.kind") == "WorkAdmitted") & F.col("r.due_ms").isNotNull(), "scheduled").otherwise(names[F.col("r.kind")])
    return last.select("queue_id", "work_id", state.alias("state"), F.col("r.due_ms").alias("due_ms"), F.col("r.lease_id").alias("lease_id"), "admission_seq", F.col("r.record_seq").alias("record_seq"))


def available(state: DataFrame, now_ms: int, limit: int, after: int = 0) -> DataFrame:
    """Per queue the next ready work, or waiting work that is due, first admitted first."""
    due = (F.col("state") == "ready") | (F.col("state").isin("scheduled", "retry-wait") & (F.col("due_ms") <= now_ms))
    rows = state.where(due & (F.col("admission_seq") > after))
    return rows.withColumn("_r", F.row_number().over(over(["queue_id"], ["admission_seq", "work_id"]))).where(F.col("_r") <= limit).drop("_r")


def dead_letters(records: DataFrame) -> DataFrame:
    return records.where("kind = 'WorkDeadLettered'")


def dead_letter_page(records: DataFrame, limit: int, after: int = 0) -> DataFrame:
    """Per queue the next ``limit`` dead letters after a record seq, with has_more and next_after (null on the last page)."""
    if limit <= 0:
        raise ValueError("a page needs a positive limit")
    w = over(["queue_id"], ["record_seq"])
    rows = dead_letters(records).where(F.col("record_seq") > after).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit + 1)
    rows = rows.withColumn("has_more", F.max("_r").over(Window.partitionBy("queue_id")) > limit).where(F.col("_r") <= limit)
    return rows.withColumn("next_after", F.when(F.col("has_more"), F.max("record_seq").over(Window.partitionBy("queue_id")))).drop("_r")


def work_snapshots(records: DataFrame) -> DataFrame:
    """queue_id, work_id, state, active_lease (of leased works), records and as_of_record_seq (of the queue) of each work."""
    per_work = records.where("record_seq IS NOT NULL").groupBy("queue_id", "work_id").agg(F.count("*").alias("records"), F.max("record_seq").alias("_last"))
    per_queue = per_work.groupBy("queue_id").agg(F.max("_last").alias("as_of_record_seq"))
    out = states(records).join(per_work.drop("_last"), ["queue_id", "work_id"]).join(per_queue, "queue_id")
    return out.select("queue_id", "work_id", "state", F.when(F.col("state") == "leased", F.col("lease_id")).alias("active_lease"), "records", "as_of_record_seq")


def command_errors(commands: DataFrame, queue_id: str | None = None) -> DataFrame:
    """Commands with ``error``: what can be told without the queue's state."""
    needs_lease = F.col("kind").isin("renew_lease", "release", "complete", "fail")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    claim = F.col("kind") == "claim"
    error = F.when(blank("command_id"), "malformed-command")
    if queue_id is not None:
        error = error.when(F.col("queue_id") != queue_id, "queue-mismatch")
    error = (
        error.when(~F.col("kind").isin("claim", "expire_leases") & blank("work_id"), "malformed-command")
        .when(needs_lease & (blank("lease_id") | blank("worker_id")), "malformed-command")
        .when(claim & (blank("worker_id") | F.coalesce(F.col("limit") <= 0, F.lit(False))), "malformed-command")
    )
    return commands.withColumn("error", error)


def schedules(records: DataFrame) -> DataFrame:
    """Readiness schedules that records ask for: admission delays, schedules, retries and lease ends."""
    reason = F.when((F.col("kind") == "WorkAdmitted") & F.col("due_ms").isNotNull(), "admission-delay").when(F.col("kind") == "WorkScheduled", "scheduled").when(F.col("kind") == "RetryScheduled", "retry").when(F.col("kind").isin("WorkClaimed", "LeaseRenewed"), "lease-expiration")
    rows = records.withColumn("reason", reason).where("reason is not null")
    return rows.select(prefixed_key("work-queue-readiness", "queue_id", "work_id", "record_seq").alias("schedule_id"), "queue_id", "work_id", "record_seq", "lease_id", "reason", F.col("due_ms").alias("ready_at_ms"))


def handoff(ready: DataFrame, state: DataFrame) -> DataFrame:
    """Ready schedules joined with the state of their work: an outcome per schedule, or why it is ignored."""
    now = state.select("queue_id", "work_id", "state", F.col("lease_id").alias("_lease"), F.col("record_seq").alias("_last"))
    rows = ready.join(now, ["queue_id", "work_id"], "left")
    lease = F.col("reason") == "lease-expiration"
    outcome = (
        F.when(F.col("state").isNull(), "unknown-work")
        .when(lease & (F.col("state") != "leased"), "stale-readiness-kind")
        .when(lease & ~F.col("lease_id").eqNullSafe(F.col("_lease")), "stale-lease-readiness")
        .when(~lease & ~F.col("state").isin("scheduled", "retry-wait"), "stale-readiness-kind")
        .when(F.col("record_seq") < F.col("_last"), "superseded-readiness")
        .when(lease, "lease-expiration-eligible")
        .otherwise("claim-eligible")
    )
    return rows.withColumn("outcome", outcome).drop("_lease", "_last", "state")


def expire_commands(handed: DataFrame) -> DataFrame:
    """Commands that expire the leases found due."""
    own = handed.where("outcome = 'lease-expiration-eligible'")
    return own.select("queue_id", prefixed_key("expire", "schedule_id").alias("command_id"), F.lit("expire_leases").alias("kind"), "work_id", F.lit(1).alias("limit"))

