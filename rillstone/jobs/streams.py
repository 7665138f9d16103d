"""The event table as a file stream: each job's rows equal those of its batch form."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import basic
from ..sources import files
from ..sources.tables import EVENTS_SQL, epoch_ms, events
from ..streaming import operators as streaming
from ..streaming import stateful
from . import workflows
from .registry import job

E = f"WITH {EVENTS_SQL}"
W = "(PARTITION BY user_id ORDER BY ms, event_id)"
HALF_DAY = 43_200_000


def stream(spark, d):
    """The table's files are in no order of time, so one micro-batch takes them all: rows of a later one would come too late."""
    rows = streaming.read_stream(spark, f"{d}/events.parquet", None)
    return rows.withColumn("ms", epoch_ms("ts")).withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int")).drop("value", "props")


@job("st1_stateless", f"{E} SELECT event_id, 'large' AS branch FROM e WHERE cents > 8000 AND event_type <> 'error' UNION ALL SELECT event_id, 'paid' FROM e WHERE event_type = 'purchase'")
def st1(spark, d):
    rows = basic.keep(stream(spark, d), F.col("event_type") != "error")
    out = basic.stratify(rows, {"large": F.col("cents") > 8000, "paid": F.col("event_type") == "purchase"}).select("event_id", "branch")
    return streaming.run_to_table(out, "stateless")


@job("st2_tumbling", """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT user_id, epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM events, m WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= w GROUP BY 1, 2""")
def st2(spark, d):
    out = streaming.tumbling(stream(spark, d), "ts", "1 day", "1 hour", ["user_id"], n=F.count("*"), cents=F.sum("cents"))
    return streaming.run_to_table(out.select("user_id", F.unix_millis("window.start").alias("start_ms"), "n", "cents"), "tumbling")


#: A fold has seen what the last watermark has passed.
PASSED = "ms <= (SELECT max(ms) - 3600000 FROM e)"
LATE = "1 hour"


@job("st3_distinct", f"{E} SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER {W} AS p, row_number() OVER {W} AS rn FROM e) WHERE (rn = 1 OR p <> event_type) AND {PASSED}")
def st3_distinct(spark, d):
    def step(state, row):
        return (row.event_type,), [] if state[0] == row.event_type else [(row.event_id, row.event_type)]

    return streaming.run_to_table(streaming.fold(stream(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", LATE, ["event_id"], step, (None,), "event_id long, event_type string"), "distinct")


@job("st3_scan", f"{E} SELECT event_id, CAST(sum(cents) OVER {W} AS BIGINT) AS total, lag(cents) OVER {W} AS previous FROM e WHERE {PASSED}")
def st3_scan(spark, d):
    def step(state, row):
        total = state[0] + row.cents
        return (total, row.cents), [(row.event_id, total, state[1])]

    return streaming.run_to_table(streaming.fold(stream(spark, d).select("user_id", "ts", "event_id", "cents"), "user_id", "ts", LATE, ["event_id"], step, (0, None), "event_id long, total long, previous long"), "scan")


GREEDY = f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER {W} AS rn FROM e WHERE {PASSED}),
f AS (SELECT user_id, event_id, ms, rn, ms AS w FROM n WHERE rn = 1 UNION ALL
 SELECT n.user_id, n.event_id, n.ms, n.rn, CASE WHEN n.ms - f.w >= {HALF_DAY} THEN n.ms ELSE f.w END FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)"""


@job("st3_throttle", f"{GREEDY} SELECT event_id FROM f WHERE w = ms")
def st3_throttle(spark, d):
    return streaming.run_to_table(streaming.throttle(stream(spark, d), "user_id", "ts", "event_id", HALF_DAY, LATE), "throttle")


@job("st3_rate_limit", f"{GREEDY} SELECT event_id, row_number() OVER (PARTITION BY user_id, w ORDER BY rn) <= 2 AS allowed FROM f")
def st3_rate_limit(spark, d):
    return streaming.run_to_table(streaming.rate_limit(stream(spark, d), "user_id", "ts", "event_id", 2, HALF_DAY, LATE), "rate-limit")


@job("st3_pairwise", f"{E} SELECT * FROM (SELECT user_id, lag(event_id) OVER {W} AS previous, event_id AS current FROM e WHERE {PASSED}) WHERE previous IS NOT NULL")
def st3_pairwise(spark, d):
    return streaming.run_to_table(streaming.pairwise(stream(spark, d), "user_id", "ts", "event_id", LATE), "pairwise")


@job("st3_breaker", f"""{E}, x AS (SELECT *, max(CASE WHEN event_type NOT IN ('error', 'view') THEN rn END) OVER {W} AS ok FROM (SELECT *, row_number() OVER {W} AS rn FROM e WHERE {PASSED}))
SELECT event_id, rn - coalesce(ok, 0) AS failures, CASE WHEN rn - coalesce(ok, 0) >= 2 THEN 'open' ELSE 'closed' END AS state FROM x""")
def st3_breaker(spark, d):
    rows = stream(spark, d).withColumn("failed", F.col("event_type").isin("error", "view"))
    return streaming.run_to_table(streaming.breaker(rows, "user_id", "ts", "event_id", "failed", 2, LATE), "breaker")


@job("st3_buffer_count", f"{E} SELECT user_id, list(cents ORDER BY ms, event_id) AS values FROM (SELECT *, row_number() OVER {W} AS rn FROM e WHERE {PASSED}) GROUP BY user_id, (rn - 1) // 5 HAVING count(*) = 5")
def st3_buffer_count(spark, d):
    rows = stream(spark, d).select("user_id", "ts", "event_id", "cents")
    return streaming.run_to_table(stateful.buffer_count(rows, "user_id", "ts", ["event_id"], "cents", 5, LATE), "buffer-count")


@job("st3_publish", f"""{E}, cm AS (SELECT event_id AS ord, ms, event_type AS topic, CASE WHEN event_type = 'signup' AND k = 89 AND event_id % 3 = 0 THEN 'close_topic' WHEN k < 3 THEN 'ensure_topic' ELSE 'publish' END AS kind, CASE WHEN event_id % 7 = 0 THEN 'c' || (event_id % 1050) END AS cid,
 CASE WHEN event_id % 5 = 0 THEN 'i' || (event_id % 1400) END AS ik FROM e WHERE {PASSED}), fr AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ms, ord) AS rn, cid IS NOT NULL AND row_number() OVER (PARTITION BY topic, cid ORDER BY ms, ord) > 1 AS dup FROM cm),
op AS (SELECT topic, min(rn) AS f FROM fr WHERE kind = 'ensure_topic' AND NOT dup GROUP BY 1), cl AS (SELECT fr.topic, min(rn) AS t FROM fr JOIN op ON op.topic = fr.topic AND rn > f WHERE kind = 'close_topic' AND NOT dup GROUP BY 1),
a AS (SELECT fr.*, CASE WHEN coalesce(rn < f, true) THEN 'unknown-topic' WHEN rn > t THEN 'closed-topic' END AS bad FROM fr LEFT JOIN op USING (topic) LEFT JOIN cl USING (topic) WHERE kind = 'publish'),
s AS (SELECT *, CASE WHEN dup OR (ik IS NOT NULL AND coalesce(min(CASE WHEN NOT dup AND bad IS NULL THEN rn END) OVER (PARTITION BY topic, ik) < rn, false)) THEN 'duplicate-command' ELSE coalesce(bad, 'published') END AS status FROM a)
SELECT ord, status, CASE WHEN status = 'published' THEN row_number() OVER (PARTITION BY topic, status ORDER BY rn) END AS seq FROM s""")
def st3_publish(spark, d):
    n, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")
    given = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = stream(spark, d).select(
        "ts", n.alias("ord"), kind.alias("topic"), F.when((kind == "signup") & (k == 89) & (n % 3 == 0), "close_topic").when(k < 3, "ensure_topic").otherwise("publish").alias("kind"),
        F.when(n % 7 == 0, given("c", n % 1050)).alias("command_id"), F.when(n % 5 == 0, given("i", n % 1400)).alias("idempotency_key"),
    )
    return streaming.run_to_table(stateful.publish(rows, "ts", LATE), "publish")


def _views(row):
    if row.k % 5 == 0:
        raise ValueError(row.k)
    return [("viewed", row.k)]


@job("st3_cqrs", f"""{E}, h AS (SELECT *, 'c' || (event_id % 900) AS id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_id % 900 ORDER BY ms, event_id) > 1 THEN 'duplicate-command' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'unknown-command' WHEN event_type = 'view' AND k % 5 = 0 THEN 'handler-failed' ELSE 'accepted' END AS status FROM e WHERE {PASSED}),
v AS (SELECT *, unnest(CASE event_type WHEN 'click' THEN [1] WHEN 'view' THEN [1] ELSE [1, 2] END) AS i FROM h WHERE status = 'accepted')
SELECT event_id AS ord, status, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS BIGINT) AS payload FROM h UNION ALL
SELECT event_id, 'event', 'cqrs-event:["' || id || '","' || i || '"]', row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id, i), CASE event_type WHEN 'click' THEN 'clicked' WHEN 'view' THEN 'viewed' ELSE ['paid', 'counted'][i] END, CASE WHEN event_type = 'view' THEN k WHEN i = 2 THEN 1 ELSE cents END FROM v""")
def st3_cqrs(spark, d):
    handlers = {"click": lambda r: [("clicked", r.cents)], "purchase": lambda r: [("paid", r.cents), ("counted", 1)], "view": _views}
    rows = stream(spark, d).select("user_id", "ts", "cents", "k", F.col("event_id").alias("ord"), F.concat(F.lit("c"), (F.col("event_id") % 900).cast("string")).alias("id"), F.col("event_type").alias("command_type"))
    return streaming.run_to_table(stateful.handle(rows, "user_id", "ts", LATE, handlers), "cqrs")


@job("st3_process", workflows.PROCESS.format(events=EVENTS_SQL, order="ms, event_id", where=PASSED) + workflows.FACTS)
def st3_process(spark, d):
    rows = workflows.process_commands(stream(spark, d)).select("process_id", "ts", "ord", "id", "command_type", "cents", "k")
    return streaming.run_to_table(stateful.process(rows, "ts", LATE, workflows.reduce_event, 0, "long"), "process")


@job("st7_effects", f"""{E} SELECT 'sales' AS topic, 'u' || user_id || 'k' || k AS idempotency_key, count(*) OVER () AS effects FROM (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'purchase')""")
def st7_effects(spark, d):
    """Purchases to an outbox, once per key: the run breaks between the effects of its batch and their ledger, and is begun again."""
    rows = stream(spark, d).where("event_type = 'purchase'").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("k"), F.col("k").cast("string")).alias("idempotency_key"), "event_id")
    name = f"sales-{uuid.uuid4().hex}"
    sent = lambda fresh: fresh.select(F.lit("sales").alias("topic"), "idempotency_key")
    try:
        streaming.effect_once(rows, name, "idempotency_key", sent, broken_at=0)
    except StreamingQueryException:
        pass
    ledger = streaming.effect_once(rows, name, "idempotency_key", sent)
    return ledger.effects().withColumn("effects", F.lit(ledger.applied().count()))


@job("st4_debounce", f"""{E}, n AS (SELECT *, lead(ms) OVER {W} AS nx FROM e), m AS (SELECT max(ms) - 3600000 AS w FROM e)
SELECT user_id, ms AS at_ms, event_id FROM n, m WHERE (nx IS NULL OR nx - ms >= {HALF_DAY}) AND ms + {HALF_DAY} <= w""")
def st4(spark, d):
    return streaming.run_to_table(streaming.debounce(stream(spark, d), "user_id", "ts", "event_id", HALF_DAY, LATE), "debounce")


@job("st4_audit", f"{GREEDY} SELECT user_id, w + {HALF_DAY} AS emit_at, arg_max(event_id, rn) AS event_id FROM f WHERE w + {HALF_DAY} <= (SELECT max(ms) - 3600000 FROM e) GROUP BY user_id, w")
def st4_audit(spark, d):
    return streaming.run_to_table(streaming.audit(stream(spark, d), "user_id", "ts", "event_id", HALF_DAY, LATE), "audit")


@job("st4_timeout", f"""{E}, m AS (SELECT max(ms) - 3600000 AS w FROM e), n AS (SELECT *, coalesce(lead(ms) OVER {W}, 9000000000000) - ms >= {2 * HALF_DAY} AND ms + {2 * HALF_DAY} <= w AS gap FROM e, m),
g AS (SELECT user_id, min(ms) FILTER (gap) AS at FROM n GROUP BY 1) SELECT user_id, ms AS at_ms, event_id, CAST(NULL AS VARCHAR) AS error FROM n JOIN g USING (user_id) WHERE {PASSED} AND (at IS NULL OR ms <= at)
UNION ALL SELECT user_id, at + {2 * HALF_DAY}, NULL, 'timeout: no value within {2 * HALF_DAY}ms' FROM g WHERE at IS NOT NULL""".replace(" AS at ", " AS gap_at ").replace("at IS", "gap_at IS").replace("ms <= at)", "ms <= gap_at)").replace("user_id, at +", "user_id, gap_at +"))
def st4_timeout(spark, d):
    return streaming.run_to_table(streaming.timeout(stream(spark, d), "user_id", "ts", "event_id", 2 * HALF_DAY, LATE), "timeout")


@job("st6_dedupe", f"{E} SELECT DISTINCT user_id, event_type FROM e")
def st6(spark, d):
    return streaming.run_to_table(streaming.dedupe(stream(spark, d), "ts", "60 days", ["user_id", "event_type"]).select("user_id", "event_type"), "dedupe")


@job("s5_file_events", f"""{E}, fl AS (SELECT event_type AS t, user_id, count(*) AS length, max(ms) AS modified, count(*) FILTER (ms <= half) AS length0, max(ms) FILTER (ms <= half) AS modified0 FROM e, (SELECT avg(ms) AS half FROM e) GROUP BY 1, 2),
b AS (SELECT t || '/' || user_id || '.log' AS path, t || user_id AS id, length0 AS length, modified0 AS modified FROM fl WHERE length0 > 0 AND user_id % 10 <> 9 AND t <> 'signup'),
a AS (SELECT (CASE t WHEN 'view' THEN 'viewed' ELSE t END) || '/' || user_id || '.log' AS path, t || user_id AS id, length, modified FROM fl WHERE t NOT IN ('error', 'signup') AND user_id % 10 <> 9)
SELECT a.path, CASE WHEN b.id IS NULL THEN 'create' WHEN a.path <> b.path THEN 'rename' ELSE 'change' END AS kind, CASE WHEN a.path <> b.path THEN b.path END AS old_path FROM a LEFT JOIN b USING (id) WHERE b.id IS NULL OR a.path <> b.path OR a.length <> b.length OR a.modified <> b.modified
UNION ALL SELECT path, 'delete', NULL FROM b WHERE id NOT IN (SELECT id FROM a)""")
def s5(spark, d):
    """A log file per type and user, as it was at half of the time and is now: errors are gone, views have another folder."""
    e = events(spark, d)
    half = e.agg(F.avg("ms").alias("half"))  # one row
    at = lambda rows, folder: rows.groupBy("event_type", "user_id").agg(F.count("*").alias("length"), F.max("ms").alias("modified")).select(F.concat(folder, F.lit("/"), F.col("user_id").cast("string"), F.lit(".log")).alias("path"), "length", "modified", F.concat("event_type", F.col("user_id").cast("string")).alias("file_id"))
    before = at(e.join(F.broadcast(half)).where(F.col("ms") <= F.col("half")), F.col("event_type"))
    after = at(e.where("event_type <> 'error'"), F.when(F.col("event_type") == "view", "viewed").otherwise(F.col("event_type")))
    return files.file_events(before, after, ["click/**", "view*/*.log", "purchase/*", "error/**"], ["**/*9.log"])


@job("s5_initial_scan", f"{E} SELECT DISTINCT event_type || '/' || user_id AS path, 'create' AS kind FROM e WHERE event_type IN ('click', 'error')")
def s5_scan(spark, d):
    found = events(spark, d).select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path")).distinct()
    return files.file_events(None, found, ["click/*", "error/?**"]).select("path", "kind")
