"""Jobs over work queues, schedules, CQRS commands and processes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators import cqrs, queue, readiness
from ..sources.tables import EVENTS_SQL, epoch_ms, events, read
from .registry import job

E = f"WITH {EVENTS_SQL}"
DAY = 86_400_000


def text(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def messages(spark, d):
    e, n = events(spark, d), F.col("event_id")
    return e.select(
        text("q", F.col("user_id") % 20).alias("queue_id"), F.col("event_type").alias("topic"), n.alias("seq"),
        F.when(n % 3 == 0, text("w", n % 2000)).alias("work_id"), F.when(n % 5 == 0, F.col("ms") + 1000).alias("not_before_ms"), F.col("ms").alias("now_ms"),
    )


@job("q1_admission", f"""{E}, m AS (SELECT 'q' || (user_id % 20) AS queue_id, event_type AS topic, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'w' || (event_id % 2000) END AS w, event_id % 5 = 0 AS late FROM e),
n AS (SELECT *, coalesce(w, 'work-queue-work:["' || queue_id || '","' || topic || '","' || seq || '"]') AS work_id FROM m)
SELECT queue_id, seq, work_id, CASE WHEN row_number() OVER (PARTITION BY queue_id, work_id ORDER BY topic, seq) = 1 THEN 'WorkAdmitted' ELSE 'AdmissionDeduped' END AS kind, CASE WHEN late THEN 'scheduled' ELSE 'ready' END AS state FROM n""")
def q1(spark, d):
    return queue.admit(messages(spark, d)).select("queue_id", "seq", "work_id", "kind", "state")


LEASE, RETRY, ATTEMPTS = 3_000, 1_500, 2


def queue_commands(spark, d):
    """Up to four commands of an order, of all nine kinds; a queue per priority and customers. Ids and idempotency keys come again,
    claims name works or not, and some commands are malformed, stale, or meant for works that are not theirs."""
    n, i = F.col("o_orderkey"), F.col("i")
    o = read(spark, d, "orders").withColumn("i", F.explode(F.array(*[F.lit(x).cast("long") for x in range(4)])))
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    ends = F.when(n % 2 == 0, F.when(F.col("o_orderstatus") == "F", "fail").otherwise("complete")).otherwise(pick(F.floor(n / 2) % 4, "release", "renew_lease", "cancel", "schedule"))
    last = F.when(n % 5 == 0, "expire_leases").when(n % 7 == 1, "cancel").when(n % 7 == 2, "schedule").when(n % 7 == 3, "complete").when(n % 7 == 4, "submit")
    rows = o.withColumn("kind", F.when(i == 0, "submit").when(i == 1, "claim").when(i == 2, ends).otherwise(last)).where("kind IS NOT NULL")
    kind, now = F.col("kind"), n * 10 + i
    several = F.when((kind == "claim") & (n % 4 < 2), F.when(n % 9 == 0, F.array(text("w", n), text("w", n - 1), F.lit("missing"))).otherwise(F.array(text("w", n), text("w", n - 1))))
    return rows.select(
        F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 40).cast("string")).alias("queue_id"), (n * 4 + i).alias("ord"), kind,
        F.when(n % 41 == 0, "").when(n % 17 == 0, text("again", n % 3)).otherwise(F.concat(kind, i.cast("string"), text("-", n))).alias("command_id"),
        F.when((i == 0) & (n % 3 == 0), text("k", n % 11)).alias("idempotency_key"), F.when(~kind.isin("claim", "expire_leases"), text("w", n)).alias("work_id"),
        several.when((kind == "expire_leases") & (n % 2 == 0), F.array(text("w", n - 5), text("w", n))).alias("work_ids"),
        F.when((i == 2) & (n % 31 == 0), "stale").alias("lease_id"), F.when((i == 2) & (n % 23 == 0), 7).cast("long").alias("attempt"),
        F.when((kind == "claim") & (n % 29 == 0), "").when((i == 2) & (n % 19 == 0), "b").otherwise("a").alias("worker_id"),
        F.when((kind == "expire_leases") | ((kind == "claim") & (n % 3 == 0)), 2).when((kind == "claim") & (n % 37 == 0), 0).cast("long").alias("limit"),
        F.when((kind == "submit") & (n % 6 == 0), now + 2500).when(kind == "schedule", now + 2000).alias("not_before_ms"),
        (n % 10 > 0).alias("retryable"), now.alias("now_ms"), F.when(n % 8 == 1, 2 * LEASE).cast("long").alias("lease_duration_ms"),
    )


#: The same commands, and a queue's works replayed command by command: a row per queue and step holds them as a list.
COMMANDS = f"""WITH RECURSIVE c0 AS (SELECT o_orderpriority || '/' || (o_custkey % 40) AS queue_id, o_orderkey AS n, i, CASE i WHEN 0 THEN 'submit' WHEN 1 THEN 'claim'
  WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'complete' END ELSE ['release', 'renew_lease', 'cancel', 'schedule'][o_orderkey // 2 % 4 + 1] END
  ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'expire_leases' WHEN o_orderkey % 7 = 1 THEN 'cancel' WHEN o_orderkey % 7 = 2 THEN 'schedule' WHEN o_orderkey % 7 = 3 THEN 'complete' WHEN o_orderkey % 7 = 4 THEN 'submit' END END AS kind, o_orderkey * 10 + i AS now_ms FROM orders, range(4) AS t(i)),
c AS (SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY n, i) AS k, kind, CASE WHEN n % 41 = 0 THEN '' WHEN n % 17 = 0 THEN 'again' || (n % 3) ELSE kind || i || '-' || n END AS command_id,
  CASE WHEN i = 0 AND n % 3 = 0 THEN 'k' || (n % 11) END AS key, CASE WHEN kind NOT IN ('claim', 'expire_leases') THEN 'w' || n END AS work_id,
  CASE WHEN kind = 'claim' AND n % 4 < 2 THEN CASE WHEN n % 9 = 0 THEN ['w' || n, 'w' || (n - 1), 'missing'] ELSE ['w' || n, 'w' || (n - 1)] END WHEN kind = 'expire_leases' AND n % 2 = 0 THEN ['w' || (n - 5), 'w' || n] ELSE [] END AS named,
  CASE WHEN i = 2 AND n % 31 = 0 THEN 'stale' END AS lease_id, CASE WHEN i = 2 AND n % 23 = 0 THEN 7 END AS attempt, CASE WHEN kind = 'claim' AND n % 29 = 0 THEN '' WHEN i = 2 AND n % 19 = 0 THEN 'b' ELSE 'a' END AS worker_id,
  CASE WHEN kind = 'expire_leases' OR (kind = 'claim' AND n % 3 = 0) THEN 2 WHEN kind = 'claim' AND n % 37 = 0 THEN 0 END AS lim, CASE WHEN kind = 'submit' AND n % 6 = 0 THEN now_ms + 2500 WHEN kind = 'schedule' THEN now_ms + 2000 END AS later,
  n % 10 > 0 AS retryable, now_ms, CASE WHEN n % 8 = 1 THEN {2 * LEASE} ELSE {LEASE} END AS duration FROM c0 WHERE kind IS NOT NULL)"""
WORK = "STRUCT(id VARCHAR, seq BIGINT, state VARCHAR, due BIGINT, lease VARCHAR, attempt BIGINT, worker VARCHAR, until BIGINT)"
OUT = "STRUCT(kind VARCHAR, work_id VARCHAR, lease_id VARCHAR, attempt BIGINT, worker_id VARCHAR, due_ms BIGINT, reason VARCHAR)"


def _w(state, due="NULL", lease="NULL", worker="NULL", until="NULL", attempt="w.attempt", of="w"):
    return f"CAST(struct_pack(id := {of}.id, seq := {of}.seq, state := {state}, due := {due}, lease := {lease}, attempt := {attempt}, worker := {worker}, until := {until}) AS {WORK})"


def _o(kind, work="w", due="NULL", reason="NULL", held=True):
    """A record of a work, with its lease or without."""
    lease, attempt, worker = (f"{work}.lease", f"{work}.attempt", f"{work}.worker") if held else ("NULL", f"{work}.attempt", "NULL")
    return f"CAST(struct_pack(kind := '{kind}', work_id := {work}.id, lease_id := {lease}, attempt := {attempt}, worker_id := {worker}, due_ms := {due}, reason := {reason}) AS {OUT})"


def _i(kind, work="work_id", reason="NULL"):
    return f"CAST(struct_pack(kind := '{kind}', work_id := {work}, lease_id := NULL, attempt := NULL, worker_id := NULL, due_ms := NULL, reason := {reason}) AS {OUT})"


DONE = "('completed', 'dead', 'canceled')"
READY = "({0}.state = 'ready' OR ({0}.state IN ('scheduled', 'retry-wait') AND {0}.due <= now_ms))"
ENDED = "list_sort(list_filter(works, lambda x: x.state = 'leased' AND x.until <= now_ms AND (len(named) = 0 OR list_contains(named, x.id))))"
REPLAY = f"""{COMMANDS},
st AS (SELECT DISTINCT queue_id, CAST(0 AS BIGINT) AS k, CAST([] AS {WORK}[]) AS works, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS keys, CAST(0 AS BIGINT) AS leases, CAST(NULL AS VARCHAR) AS command_id, CAST(NULL AS BIGINT) AS now_ms, CAST([] AS {OUT}[]) AS out FROM c0
UNION ALL
SELECT queue_id, k, CASE WHEN verb = 'submit' AND w IS NULL THEN list_append(works, CAST(struct_pack(id := work_id, seq := len(works) + 1, state := CASE WHEN later > now_ms THEN 'scheduled' ELSE 'ready' END, due := later, lease := NULL, attempt := 0, worker := NULL, until := NULL) AS {WORK}))
  WHEN new IS NULL THEN works ELSE list_transform(works, lambda x: CASE WHEN x.id = new.id THEN new ELSE x END) END, ids, keys, leases, command_id, now_ms,
  CASE WHEN fault IS NOT NULL THEN list_append(before, {_i("Issue", reason="fault")}) WHEN verb = 'submit' THEN CASE WHEN w IS NULL THEN [CAST(struct_pack(kind := 'WorkAdmitted', work_id := work_id, lease_id := NULL, attempt := 0, worker_id := NULL, due_ms := later, reason := NULL) AS {OUT})] ELSE [{_i("AdmissionDeduped")}] END
  WHEN verb = 'claim' THEN list_concat(before, list_transform(took, lambda x: {_o("WorkClaimed", "x", "x.until")}), CASE WHEN len(took) = 0 AND len(named) = 0 THEN [{_i("Issue", reason="'not-ready'")}] ELSE list_transform(missed, lambda x: {_i("Issue", "x.id", "x.reason")}) END)
  WHEN verb = 'expire_leases' THEN before WHEN verb = 'renew_lease' THEN [{_o("LeaseRenewed", "new", "new.until")}] WHEN verb = 'release' THEN [{_o("WorkReleased")}] WHEN verb = 'complete' THEN [{_o("AttemptCompleted")}, {_o("WorkCompleted")}]
  WHEN verb = 'fail' THEN [{_o("AttemptFailed")}, CASE WHEN new.state = 'dead' THEN {_o("WorkDeadLettered", reason="'attempts-exhausted'")} ELSE {_o("RetryScheduled", "new", "new.due", "'retry-policy'")} END]
  WHEN verb = 'cancel' THEN [{_o("WorkCanceled", held=False)}] ELSE [{_o("WorkScheduled", "new", "new.due")}] END
FROM (SELECT *, list_transform(gone, lambda x: {_o("LeaseExpired", "x")}) AS before, CASE WHEN fault IS NOT NULL THEN NULL WHEN verb = 'renew_lease' THEN {_w("'leased'", "w.due", "w.lease", "w.worker", "now_ms + duration")} WHEN verb = 'release' THEN {_w("'ready'")} WHEN verb = 'complete' THEN {_w("'completed'")}
   WHEN verb = 'fail' THEN CASE WHEN retryable AND w.attempt < {ATTEMPTS} THEN {_w("'retry-wait'", f"now_ms + {RETRY}")} ELSE {_w("'dead'")} END WHEN verb = 'cancel' THEN {_w("'canceled'")} WHEN verb = 'schedule' THEN {_w("'scheduled'", "later")} END AS new
 FROM (SELECT * EXCLUDE (works, leases), leases + len(took) AS leases, list_transform(works, lambda x: coalesce(list_filter(took, lambda y: y.id = x.id)[1], x)) AS works,
   list_filter(list_transform(list_sort(list_filter(CASE WHEN verb = 'claim' THEN named ELSE [] END, lambda a: len(list_filter(took, lambda y: y.id = a)) = 0)), lambda a: struct_pack(id := a, reason := CASE WHEN len(list_filter(works, lambda x: x.id = a)) = 0 THEN 'unknown-work'
     ELSE list_transform(list_filter(works, lambda x: x.id = a), lambda x: CASE WHEN {READY.format("x")} THEN NULL WHEN x.state IN {DONE} THEN 'terminal-work' WHEN x.state = 'leased' THEN 'already-leased' ELSE 'not-ready' END)[1] END)), lambda m: m.reason IS NOT NULL) AS missed
  FROM (SELECT *, CASE WHEN verb = 'claim' THEN list_transform(list_filter(works, lambda x: {READY.format("x")} AND (len(named) = 0 OR list_contains(named, x.id)))[1:coalesce(lim, greatest(len(named), 1))],
     lambda x, j: {_w("'leased'", "NULL", "'work-queue-lease:[" + chr(34) + "' || x.id || '" + chr(34) + "," + chr(34) + "' || (leases + j) || '" + chr(34) + "]'", "worker_id", "now_ms + duration", "x.attempt + 1", "x")}) ELSE [] END AS took
   FROM (SELECT * EXCLUDE (works), list_transform(works, lambda x: CASE WHEN len(list_filter(gone, lambda y: y.id = x.id)) > 0 THEN {_w("'ready'", attempt="x.attempt", of="x")} ELSE x END) AS works
    FROM (SELECT *, CASE WHEN verb = 'claim' THEN {ENDED} WHEN verb = 'expire_leases' THEN {ENDED}[1:lim] WHEN fault = 'lease-expired' THEN [w] ELSE [] END AS gone
     FROM (SELECT * EXCLUDE (fault, ids, keys), CASE WHEN fault IS NULL THEN kind END AS verb, CASE WHEN fault IS NULL THEN list_append(ids, command_id) ELSE ids END AS ids, CASE WHEN fault IS NULL AND key IS NOT NULL THEN list_append(keys, key) ELSE keys END AS keys,
       CASE WHEN fault IS NOT NULL THEN fault WHEN kind IN ('submit', 'claim', 'expire_leases') THEN NULL WHEN w IS NULL THEN 'unknown-work' WHEN w.state IN {DONE} THEN 'terminal-work' WHEN kind = 'cancel' THEN NULL WHEN kind = 'schedule' THEN CASE WHEN w.state = 'leased' THEN 'schedule-conflict' END
        WHEN w.state <> 'leased' THEN 'lease-not-current' WHEN lease_id <> w.lease THEN 'stale-lease' WHEN attempt <> w.attempt THEN 'attempt-mismatch' WHEN worker_id <> w.worker THEN 'worker-mismatch' WHEN w.until <= now_ms THEN 'lease-expired' END AS fault
      FROM (SELECT c.*, st.works, st.ids, st.keys, st.leases, list_filter(st.works, lambda x: x.id = c.work_id)[1] AS w, CASE WHEN c.command_id = '' OR (kind = 'claim' AND (worker_id = '' OR lim = 0)) THEN 'malformed-command' WHEN list_contains(st.ids, c.command_id) OR list_contains(st.keys, c.key) THEN 'duplicate-command' END AS fault
       FROM st JOIN c ON c.queue_id = st.queue_id AND c.k = st.k + 1))))))))"""
RECORDS = f"""{REPLAY}, un AS (SELECT queue_id, k, command_id, now_ms, unnest(range(len(out))) AS place, unnest(out) AS o FROM st WHERE len(out) > 0),
recs AS (SELECT queue_id, k, place, CASE WHEN o.kind <> 'Issue' THEN count(*) FILTER (WHERE o.kind <> 'Issue') OVER (PARTITION BY queue_id ORDER BY k, place) END AS record_seq, o.kind AS kind, o.work_id AS work_id, command_id, o.lease_id AS lease_id, o.attempt AS attempt, o.worker_id AS worker_id, o.due_ms AS due_ms, o.reason AS reason, now_ms FROM un)"""


def records(spark, d):
    return queue.fold(queue_commands(spark, d), LEASE, ATTEMPTS, RETRY)


@job("q2_command_fold", f"{RECORDS} SELECT * EXCLUDE (k, place) FROM recs")
def q2(spark, d):
    return records(spark, d)


#: Works by their last record that changes one.
STATE = f"""{RECORDS}, rr AS (SELECT * FROM recs WHERE record_seq IS NOT NULL), ch AS (SELECT *, row_number() OVER (PARTITION BY queue_id, work_id ORDER BY record_seq DESC) AS back, min(record_seq) OVER (PARTITION BY queue_id, work_id) AS admission_seq FROM rr WHERE kind NOT IN ('AttemptCompleted', 'AttemptFailed', 'AdmissionDeduped')),
ws AS (SELECT queue_id, work_id, CASE kind WHEN 'WorkAdmitted' THEN CASE WHEN due_ms IS NULL THEN 'ready' ELSE 'scheduled' END WHEN 'WorkClaimed' THEN 'leased' WHEN 'LeaseRenewed' THEN 'leased' WHEN 'WorkCompleted' THEN 'completed' WHEN 'RetryScheduled' THEN 'retry-wait'
 WHEN 'WorkDeadLettered' THEN 'dead' WHEN 'WorkCanceled' THEN 'canceled' WHEN 'WorkScheduled' THEN 'scheduled' ELSE 'ready' END AS state, due_ms, lease_id, admission_seq, record_seq FROM ch WHERE back = 1)"""


@job("q3_work_states", f"{STATE} SELECT queue_id, work_id, state, due_ms, admission_seq FROM ws")
def q3(spark, d):
    return queue.states(records(spark, d)).select("queue_id", "work_id", "state", "due_ms", "admission_seq")


@job("q4_available_page", f"{STATE} SELECT queue_id, work_id FROM ws WHERE state = 'ready' OR (state IN ('scheduled', 'retry-wait') AND due_ms <= 60000) QUALIFY row_number() OVER (PARTITION BY queue_id ORDER BY admission_seq, work_id) <= 3")
def q4(spark, d):
    return queue.available(queue.states(records(spark, d)), 60_000, 3).select("queue_id", "work_id")


@job("q4_work_snapshots", f"""{STATE}, m AS (SELECT queue_id, max(record_seq) AS as_of_record_seq FROM rr GROUP BY 1), t AS (SELECT queue_id, work_id, count(*) AS records FROM rr GROUP BY 1, 2)
SELECT queue_id, work_id, state, CASE WHEN state = 'leased' THEN lease_id END AS active_lease, records, as_of_record_seq FROM ws JOIN m USING (queue_id) JOIN t USING (queue_id, work_id)""")
def q4_snapshots(spark, d):
    return queue.work_snapshots(stage(records(spark, d), "records"))


@job("q4_dead_letter_page", f"""{STATE}, p AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY record_seq) AS r, count(*) OVER (PARTITION BY queue_id) AS c FROM rr WHERE kind = 'WorkDeadLettered' AND record_seq > 5)
SELECT queue_id, work_id, record_seq, c > 1 AS has_more, CASE WHEN c > 1 THEN record_seq END AS next_after FROM p WHERE r = 1""")
def q4_dead_letters(spark, d):
    return queue.dead_letter_page(records(spark, d), 1, 5).select("queue_id", "work_id", "record_seq", "has_more", "next_after")


@job("q5_command_errors", """WITH c AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'c' || event_id END AS command_id, ['claim', 'complete', 'submit'][event_id % 3 + 1] AS kind, CASE WHEN event_id % 7 > 0 THEN 'w' END AS work_id, CASE WHEN event_id % 11 > 0 THEN 'l' END AS lease_id, event_id % 13 AS lim, 'q' || (user_id % 2) AS queue_id FROM events)
SELECT event_id, CASE WHEN command_id = '' THEN 'malformed-command' WHEN queue_id <> 'q0' THEN 'queue-mismatch' WHEN (kind <> 'claim' AND work_id IS NULL) OR (kind = 'complete' AND (lease_id IS NULL OR event_id % 17 = 0)) OR (kind = 'claim' AND (lim <= 0 OR event_id % 17 = 0)) THEN 'malformed-command' END AS error FROM c""")
def q5(spark, d):
    n = F.col("event_id")
    c = events(spark, d).select(
        "event_id", F.when(n % 50 == 0, "").otherwise(text("c", n)).alias("command_id"), F.element_at(F.array(*map(F.lit, ["claim", "complete", "submit"])), (n % 3 + 1).cast("int")).alias("kind"),
        F.when(n % 7 > 0, "w").alias("work_id"), F.when(n % 11 > 0, "l").alias("lease_id"), F.when(n % 17 > 0, "a").alias("worker_id"), (n % 13).alias("limit"), text("q", F.col("user_id") % 2).alias("queue_id"),
    )
    return queue.command_errors(c, "q0").select("event_id", "error")


SCH = """sc AS (SELECT 'work-queue-readiness:["' || queue_id || '","' || work_id || '","' || record_seq || '"]' AS schedule_id, queue_id, work_id, record_seq, lease_id, CASE kind WHEN 'WorkAdmitted' THEN 'admission-delay' WHEN 'WorkScheduled' THEN 'scheduled' WHEN 'RetryScheduled' THEN 'retry' ELSE 'lease-expiration' END AS reason, due_ms AS ready_at_ms
 FROM rr WHERE kind IN ('WorkScheduled', 'RetryScheduled', 'WorkClaimed', 'LeaseRenewed') OR (kind = 'WorkAdmitted' AND due_ms IS NOT NULL))"""


@job("q6_readiness_schedules", f"{STATE}, {SCH} SELECT schedule_id, reason, ready_at_ms FROM sc")
def q6(spark, d):
    return queue.schedules(records(spark, d)).select("schedule_id", "reason", "ready_at_ms")


HAND = f"""{STATE}, {SCH}, h AS (SELECT sc.*, CASE WHEN reason = 'lease-expiration' AND state <> 'leased' THEN 'stale-readiness-kind' WHEN reason = 'lease-expiration' AND sc.lease_id IS DISTINCT FROM ws.lease_id THEN 'stale-lease-readiness'
 WHEN reason <> 'lease-expiration' AND state NOT IN ('scheduled', 'retry-wait') THEN 'stale-readiness-kind' WHEN sc.record_seq < ws.record_seq THEN 'superseded-readiness' WHEN reason = 'lease-expiration' THEN 'lease-expiration-eligible' ELSE 'claim-eligible' END AS outcome FROM sc JOIN ws USING (queue_id, work_id))"""


def handed(spark, d):
    r = stage(records(spark, d), "records")
    return queue.handoff(queue.schedules(r), queue.states(r))


@job("q7_readiness_handoff", f"{HAND} SELECT schedule_id, outcome FROM h")
def q7(spark, d):
    return handed(spark, d).select("schedule_id", "outcome")


@job("q8_expire_commands", f"""{HAND} SELECT queue_id, work_id, 1 AS "limit" FROM h WHERE outcome = 'lease-expiration-eligible'""")
def q8(spark, d):
    return queue.expire_commands(handed(spark, d)).select("queue_id", "work_id", "limit")


def order_schedules(spark, d):
    o, n = read(spark, d, "orders"), F.col("o_orderkey")
    day = F.floor(epoch_ms("o_orderdate") / DAY)
    return o.select((n * 2).alias("ord"), text("s", n % 9000).alias("schedule_id"), (day * DAY).alias("ready_at_ms"), F.when(n % 4 == 0, day * DAY + 20 * DAY).alias("deadline_ms"))


def clocks(spark, d):
    """A tick per month of order dates, some before and some after the schedules; every seventh goes back a little."""
    o = read(spark, d, "orders")
    months = o.select(F.floor(epoch_ms("o_orderdate") / (30 * DAY)).alias("m")).distinct()
    return months.select(((F.col("m") - 260) * 101 + 1).alias("ord"), (F.col("m") * 30 * DAY - F.when(F.col("m") % 7 == 0, 45 * DAY).otherwise(0)).alias("now_ms"))


RDY = f"""WITH s AS (SELECT o_orderkey * 2 AS ord, 's' || (o_orderkey % 9000) AS schedule_id, epoch_ms(o_orderdate) // {DAY} * {DAY} AS ready_at_ms, CASE WHEN o_orderkey % 4 = 0 THEN epoch_ms(o_orderdate) // {DAY} * {DAY} + {20 * DAY} END AS deadline_ms FROM orders),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY schedule_id ORDER BY ord) = 1), m AS (SELECT DISTINCT epoch_ms(o_orderdate) // {30 * DAY} AS m FROM orders),
c AS (SELECT (m - 260) * 101 + 1 AS ord, m * {30 * DAY} - CASE WHEN m % 7 = 0 THEN {45 * DAY} ELSE 0 END AS now_ms FROM m), cc AS (SELECT * FROM c QUALIFY now_ms >= coalesce(max(now_ms) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), now_ms))"""


@job("r1_readiness", f"""{RDY}, l AS (SELECT k.*, (SELECT arg_max(now_ms, cc.ord) FROM cc WHERE cc.ord < k.ord) AS lt FROM k),
x AS (SELECT *, CASE WHEN lt >= ready_at_ms THEN lt ELSE (SELECT arg_min(now_ms, cc.ord) FROM cc WHERE cc.ord > l.ord AND now_ms >= ready_at_ms) END AS ready,
 CASE WHEN lt > greatest(ready_at_ms, deadline_ms) THEN lt ELSE (SELECT arg_min(now_ms, cc.ord) FROM cc WHERE cc.ord > l.ord AND now_ms > greatest(ready_at_ms, deadline_ms)) END AS over FROM l)
SELECT schedule_id, 'pending' AS fact, lt AS now_ms FROM x WHERE lt IS NULL OR lt < ready_at_ms UNION ALL SELECT schedule_id, 'ready', ready FROM x WHERE ready IS NOT NULL
UNION ALL SELECT schedule_id, 'overdue', over FROM x WHERE deadline_ms IS NOT NULL AND over IS NOT NULL""")
def r1(spark, d):
    return readiness.project(order_schedules(spark, d), clocks(spark, d))


@job("r1_schedule_states", f"""{RDY}, f AS (SELECT *, first_value(ready_at_ms) OVER w AS r0, first_value(deadline_ms) OVER w AS d0, row_number() OVER w AS rk FROM s WINDOW w AS (PARTITION BY schedule_id ORDER BY ord))
SELECT ord, CASE WHEN rk = 1 THEN 'kept' WHEN ready_at_ms = r0 AND deadline_ms IS NOT DISTINCT FROM d0 THEN 'replay' ELSE 'conflict' END AS state FROM f""")
def r1_states(spark, d):
    return readiness.first_schedules(order_schedules(spark, d)).select("ord", "state")


@job("r2_parse_requests", """WITH j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN 'old-alias' WHEN 2 THEN 'missing scheduleId' WHEN 3 THEN 'missing readyAtMs' END AS c FROM events)
SELECT event_id, CASE c WHEN 'broken' THEN 'malformed' ELSE c END AS issue, CASE WHEN c IS NULL THEN event_id END AS ready_at_ms FROM j""")
def r2(spark, d):
    n = F.col("event_id").cast("string")
    body = (
        F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"scheduleId":"a","readyAt":'), n, F.lit("}")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"readyAtMs":'), n, F.lit("}"))).when(F.col("event_id") % 5 == 3, F.lit('{"scheduleId":"a"}')).otherwise(F.concat(F.lit('{"scheduleId":"a","readyAtMs":'), n, F.lit("}")))
    )
    parsed = readiness.parse_requests(read(spark, d, "events").select("event_id", body.alias("body")), "body")
    return parsed.select("event_id", "issue", F.when(F.col("issue").isNull(), F.col("ready_at_ms")).alias("ready_at_ms"))


def commands(spark, d):
    e, n = events(spark, d), F.col("event_id")
    return e.select(n.alias("ord"), F.when(n % 301 == 0, "").otherwise(text("c", F.when(n % 8 == 0, n - n % 24).otherwise(n))).alias("id"), F.col("event_type").alias("command_type"), F.col("user_id").alias("aggregate_id"), "cents", "k")


def handled(spark, d):
    draft = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.alias("payload"))
    return cqrs.handle(commands(spark, d), {
        "click": F.array(draft("clicked", F.col("cents"))),
        "purchase": F.array(draft("paid", F.col("cents")), draft("counted", F.lit(1).cast("long"))),
        "view": F.when(F.col("k") % 5 > 0, F.array(draft("viewed", F.col("k").cast("long")))),
    }, F.floor(F.col("ord") / 500))


CQ = f"""{E}, c AS (SELECT event_id AS ord, CASE WHEN event_id % 301 = 0 THEN '' ELSE 'c' || (CASE WHEN event_id % 8 = 0 THEN event_id - event_id % 24 ELSE event_id END) END AS id, event_type AS command_type, user_id AS aggregate_id, cents, k FROM e),
h AS (SELECT *, CASE WHEN id = '' THEN 'malformed-command' WHEN row_number() OVER (PARTITION BY id ORDER BY ord) > 1 THEN 'duplicate-command' WHEN command_type NOT IN ('click', 'purchase', 'view') THEN 'unknown-command' WHEN command_type = 'view' AND k % 5 = 0 THEN 'handler-failed' ELSE 'accepted' END AS status FROM c),
ev AS (SELECT ord, id AS command_id, aggregate_id, i, CASE command_type WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'viewed' ELSE ['paid', 'counted'][i + 1] END AS type, CASE WHEN command_type = 'view' THEN k WHEN i = 1 THEN 1 ELSE cents END AS payload FROM (SELECT *, unnest(range(0, CASE WHEN command_type = 'purchase' THEN 2 ELSE 1 END)) AS i FROM h WHERE status = 'accepted')),
es AS (SELECT *, 'cqrs-event:["' || command_id || '","' || (i + 1) || '"]' AS id, row_number() OVER (ORDER BY ord, i) AS seq FROM ev)"""


@job("e1_cqrs_status", f"{CQ} SELECT ord, status FROM h")
def e1(spark, d):
    return handled(spark, d).select("ord", "status")


@job("e1_cqrs_events", f"{CQ} SELECT id, seq, type, payload, aggregate_id FROM es")
def e1_events(spark, d):
    return cqrs.events(handled(spark, d)).select("id", "seq", "type", "payload", "aggregate_id")


CHECKED = f"""{E}, c AS (SELECT event_id AS ord, 'c' || event_id AS id, user_id AS aggregate_id, CASE WHEN k % 7 = 0 THEN '' WHEN k % 5 = 0 THEN 'odd' ELSE event_type END AS type, CASE WHEN k % 4 > 0 THEN 'e' || (event_id % 1500) END AS ev, cents FROM e),
h AS (SELECT *, CASE WHEN type = '' THEN 'malformed-event' WHEN type = 'odd' THEN 'unknown-event' WHEN ev IS NOT NULL AND row_number() OVER (PARTITION BY ev, type IN ('', 'odd') ORDER BY ord) > 1 THEN 'duplicate-event' ELSE 'accepted' END AS status FROM c)"""


def checked(spark, d):
    """Commands with two drafts: the first at fault at times, with an id of its own at others; the second plain."""
    n, k = F.col("event_id"), F.col("k")
    kind = F.when(k % 7 == 0, "").when(k % 5 == 0, "odd").otherwise(F.col("event_type"))
    rows = events(spark, d).select(n.alias("ord"), text("c", n).alias("id"), F.lit("do").alias("command_type"), F.col("user_id").alias("aggregate_id"), kind.alias("t"), F.when(k % 4 > 0, text("e", n % 1500)).alias("ev"), "cents")
    draft = lambda t, p, i: F.struct(t.alias("type"), p.alias("payload"), i.cast("string").alias("id"))
    drafts = F.array(draft(F.col("t"), F.col("cents"), F.col("ev")), draft(F.lit("counted"), F.lit(1).cast("long"), F.lit("")))
    return cqrs.handle(rows, {"do": drafts}, F.floor(F.col("ord") / 500), ["click", "view", "purchase", "signup", "error", "counted"])


@job("e1_event_checks", f"{CHECKED} SELECT ord, status FROM h")
def e1_checks(spark, d):
    return checked(spark, d).select("ord", "status")


@job("e1_named_events", f"""{CHECKED} SELECT CASE WHEN i = 1 AND ev IS NOT NULL THEN ev ELSE 'cqrs-event:["' || id || '","' || i || '"]' END AS id, row_number() OVER (ORDER BY ord, i) AS seq, CASE WHEN i = 1 THEN type ELSE 'counted' END AS type, CASE WHEN i = 1 THEN cents ELSE 1 END AS payload
FROM (SELECT *, unnest([1, 2]) AS i FROM h WHERE status = 'accepted')""")
def e1_named(spark, d):
    return cqrs.events(checked(spark, d)).select("id", "seq", "type", "payload")


@job("e2_bounded_dedupe", f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT user_id, event_id AS ord, CAST(k % 12 AS VARCHAR) AS id, event_type || (k % 3) AS ev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e),
f AS (SELECT user_id, ord, rn, 'accepted' AS code, [id] AS s, [ev] AS m, 0 AS ce, 0 AS ee FROM n WHERE rn = 1 UNION ALL
 SELECT n.user_id, n.ord, n.rn, CASE WHEN list_contains(f.s, n.id) THEN 'duplicate-command' WHEN list_contains(f.m, n.ev) THEN 'duplicate-event' ELSE 'accepted' END,
  CASE WHEN list_contains(f.s, n.id) THEN f.s ELSE list_append(f.s, n.id)[-5:] END, CASE WHEN list_contains(f.s, n.id) OR list_contains(f.m, n.ev) THEN f.m ELSE list_append(f.m, n.ev)[-3:] END,
  f.ce + CASE WHEN NOT list_contains(f.s, n.id) AND len(f.s) >= 5 THEN 1 ELSE 0 END, f.ee + CASE WHEN NOT list_contains(f.s, n.id) AND NOT list_contains(f.m, n.ev) AND len(f.m) >= 3 THEN 1 ELSE 0 END
 FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT user_id, ord, code, ce AS commands_evicted, ee AS events_evicted FROM f""")
def e2(spark, d):
    c = events(spark, d).select(F.col("event_id").alias("ord"), (F.col("k") % 12).cast("string").alias("id"), F.concat("event_type", (F.col("k") % 3).cast("string")).alias("event_id"), "user_id")
    return cqrs.bounded_dedupe(c, 5, ["user_id"], 3).select("user_id", "ord", "code", "commands_evicted", "events_evicted")


@job("e3_audit", f"""{CQ}, n AS (SELECT *, CASE WHEN status = 'accepted' THEN CASE WHEN command_type = 'purchase' THEN 2 ELSE 1 END ELSE 0 END AS events FROM h)
SELECT ord, id, aggregate_id, CASE WHEN status = 'accepted' THEN 'success' ELSE 'failure' END AS outcome, events, CAST(sum(events) OVER w AS BIGINT) AS event_count, count(*) OVER w AS command_count FROM n WINDOW w AS (PARTITION BY aggregate_id ORDER BY ord)""")
def e3(spark, d):
    return cqrs.audit(handled(spark, d))


@job("e4_projection", f"{CQ} SELECT aggregate_id, CAST(sum(payload) AS BIGINT) AS total, count(*) AS n, arg_max(payload, seq) AS last FROM es WHERE type IN ('paid', 'clicked') GROUP BY 1")
def e4(spark, d):
    made = cqrs.events(handled(spark, d))
    return cqrs.project(made, ["paid", "clicked"], ["aggregate_id"], total=F.sum("payload"), n=F.count("*"), last=F.max_by("payload", "seq"))


PROCESS = """WITH RECURSIVE {events}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn, CASE WHEN event_id % 41 = 0 THEN '' ELSE 'c' || event_id END AS id, CASE WHEN event_id % 43 = 0 THEN '' ELSE event_type END AS ct FROM e WHERE {where}),
f AS (SELECT DISTINCT user_id, 0 AS rn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS code, 0::BIGINT AS state, 0::BIGINT AS es, 0::BIGINT AS fs, 0::BIGINT AS errors, []::VARCHAR[] AS seen, []::VARCHAR[] AS made, []::VARCHAR[] AS eff, CAST(NULL AS BIGINT) AS cents, CAST(NULL AS VARCHAR) AS ct FROM n
 UNION ALL SELECT user_id, rn, ord, code, CASE WHEN code IS NOT NULL THEN state WHEN ct = 'signup' THEN 0 ELSE state + cents END, CASE WHEN code IS NULL THEN es + len(ev) ELSE es END, CASE WHEN code IS NULL THEN fs + len(ef) ELSE fs END, errors + CASE WHEN code IS NULL THEN 0 ELSE 1 END,
  CASE WHEN code IS NULL THEN list_concat(seen, list_concat(list_transform(ev, lambda x: 'e' || x), list_transform(ef, lambda x: 'f' || x))) ELSE seen END, CASE WHEN code IS NULL THEN ev ELSE [] END, CASE WHEN code IS NULL THEN ef ELSE [] END, cents, ct FROM (
  SELECT *, CASE WHEN id = '' OR ct = '' THEN 'malformed-command' WHEN ct = 'error' THEN 'reducer-threw' WHEN k = 34 OR list_contains(seen, 'e' || ev[1]) THEN 'malformed-event' WHEN k = 55 OR (len(ef) > 0 AND list_contains(seen, 'f' || ef[1])) THEN 'malformed-effect' END AS code FROM (
   SELECT n.user_id, n.rn, n.event_id AS ord, n.id, n.ct, n.k, n.cents, f.state, f.es, f.fs, f.errors, f.seen,
    list_concat([CASE WHEN n.k % 3 = 0 THEN 'x' || (n.event_id % 50) ELSE 'process-event:["' || n.id || '","' || (f.es + 1) || '"]' END], CASE WHEN n.ct = 'purchase' THEN ['process-event:["' || n.id || '","' || (f.es + 2) || '"]'] ELSE [] END) AS ev,
    CASE WHEN n.ct = 'purchase' THEN ['f' || (n.event_id % 40)] ELSE [] END AS ef FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)))
"""
FACTS = """SELECT user_id AS process_id, ord, CASE WHEN code IS NULL THEN 'accepted' ELSE 'failed' END AS kind, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS name, rn AS seq, CAST(NULL AS BIGINT) AS payload, code, es AS event_seq, fs AS effect_seq, rn AS command_count, errors AS error_count, state FROM f WHERE rn > 0
UNION ALL SELECT user_id, ord, 'event', made[i], CASE WHEN i = 2 THEN 'paid' WHEN ct = 'signup' THEN 'reset' ELSE 'added' END, es - len(made) + i, CASE WHEN i = 1 THEN cents END, NULL, es, fs, rn, errors, state FROM (SELECT *, unnest(range(1, len(made) + 1)) AS i FROM f)
UNION ALL SELECT user_id, ord, 'effect', eff[i], 'notify', fs - len(eff) + i, state, NULL, es, fs, rn, errors, state FROM (SELECT *, unnest(range(1, len(eff) + 1)) AS i FROM f)"""


def reduce_event(state, c):
    """Events as commands of their user's process: some ids are given, some drafts are malformed, errors raise."""
    if c.command_type == "error":
        raise ValueError(c.command_type)
    new = 0 if c.command_type == "signup" else state + c.cents
    kind = "" if c.k == 34 else "reset" if c.command_type == "signup" else "added"
    made = [(kind, c.cents, f"x{c.ord % 50}" if c.k % 3 == 0 else None)]
    asked = [("" if c.k == 55 else "notify", new, f"f{c.ord % 40}")] if c.command_type == "purchase" else [("", None, None)] if c.k == 55 else []
    return new, made + (["paid"] if c.command_type == "purchase" else []), asked


def process_commands(rows):
    n = F.col("event_id")
    return rows.withColumns({"process_id": F.col("user_id"), "ord": n, "id": F.when(n % 41 == 0, "").otherwise(text("c", n)), "command_type": F.when(n % 43 == 0, "").otherwise(F.col("event_type"))})


@job("e5_process", PROCESS.format(events=EVENTS_SQL, order="event_id", where="true") + FACTS)
def e5(spark, d):
    """Every fact: outcomes, events and effects, with cursor and state."""
    return cqrs.process(process_commands(events(spark, d)), reduce_event, 0, "long")


@job("e6_effect_commands", """WITH o AS (SELECT event_id, ['result', 'failure', 'cancel', 'other'][event_id % 4 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN 1 END AS value, CASE WHEN event_id % 5 = 0 THEN 'x' END AS error FROM events)
SELECT event_id, CASE WHEN kind = 'other' THEN 'unknown-kind' WHEN kind = 'result' AND error IS NOT NULL THEN 'unexpected-field' WHEN kind = 'failure' AND error IS NULL THEN 'missing-error' WHEN kind = 'failure' AND value IS NOT NULL THEN 'unexpected-field' WHEN kind = 'cancel' AND (value IS NOT NULL OR error IS NOT NULL) THEN 'unexpected-field' END AS outcome_error FROM o""")
def e6(spark, d):
    n = F.col("event_id")
    o = read(spark, d, "events").select("event_id", text("e", n).alias("effect_id"), F.element_at(F.array(*map(F.lit, ["result", "failure", "cancel", "other"])), (n % 4 + 1).cast("int")).alias("kind"), F.when(n % 3 == 0, 1).alias("value"), F.when(n % 5 == 0, "x").alias("error"), F.lit(None).cast("string").alias("reason"))
    return cqrs.effect_commands(o).select("event_id", "outcome_error")


@job("e7_acknowledgements", f"""{CQ}, dl AS (SELECT id AS command_id, ord AS seq, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM h WHERE id <> ''), ss AS (SELECT id AS command_id, status, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM h WHERE id <> '')
SELECT command_id, seq, status FROM dl JOIN ss USING (command_id, n)""")
def e7(spark, d):
    h = handled(spark, d).where("id <> ''")
    return cqrs.acknowledgements(h.select(F.col("id").alias("command_id"), F.col("ord").alias("seq")), h.select(F.col("id").alias("command_id"), "ord", "status")).select("command_id", "seq", "status")


@job("e8_dispositions", f"{CQ} SELECT ord AS work_id, CASE WHEN status = 'handler-failed' THEN 'fail' ELSE 'complete' END AS disposition, CASE WHEN status = 'handler-failed' THEN true END AS retryable FROM h WHERE status <> 'duplicate-command' AND id <> ''")
def e8(spark, d):
    h = handled(spark, d).where("status <> 'duplicate-command' and id <> ''")
    attempts = h.select(F.col("ord").alias("work_id"), F.col("id").alias("command_id"))
    return cqrs.dispositions(attempts, h.select(F.col("id").alias("command_id"), "status"), ["clock-failed"]).select("work_id", "disposition", "retryable")


@job("s8_outbox", f"""{CQ} SELECT type AS topic, CAST(aggregate_id AS VARCHAR) AS key, 'cqrs-outbox:["' || replace(id, '"', '\\"') || '"]' AS command_id, id AS idempotency_key, payload FROM es""")
def s8(spark, d):
    return cqrs.outbox(cqrs.events(handled(spark, d)), F.col("type"))
