"""Jobs over change logs and the message bus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.order import over
from ..functions.staging import stage
from ..operators import bus, caches, chains, collections, mutations
from ..sources.tables import EVENTS_SQL, KEY, ORDER, events, read
from .registry import job

E = f"WITH {EVENTS_SQL}"
W = "(PARTITION BY user_id ORDER BY ms, event_id)"
N = f"n AS (SELECT user_id AS collection, row_number() OVER {W} - 1 AS seq, event_id, event_type, cents, k FROM e)"
#: The rare events whose k is 0 clear a user's collection.
CLEARS = "event_type = 'signup' AND k < 10"


def changes(spark, d):
    seq = (F.row_number().over(over(KEY, ORDER)) - 1).cast("long")
    return events(spark, d).select(F.col("user_id").alias("collection"), seq.alias("seq"), "event_id", "event_type", "cents", "k")


def map_changes(spark, d):
    kind = F.when(F.expr(CLEARS), "clear").when(F.col("event_type") == "error", "delete").otherwise("set")
    rows = changes(spark, d).withColumn("kind", kind)
    return rows.select("collection", "seq", "kind", F.when(F.col("kind") != "clear", F.col("k") % 10).alias("k"), F.when(F.col("kind") == "set", F.col("cents")).alias("v"), F.when(F.col("kind") == "clear", F.lit(4)).alias("count"), F.when((F.col("kind") == "set") & (F.col("k") % 7 == 0), F.lit(1)).cast("long").alias("previous"))


MAP = f"""{E}, {N}, c AS (SELECT collection, seq, CASE WHEN {CLEARS} THEN 'clear' WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS kind, k % 10 AS k, cents AS v FROM n)"""


@job("c1_map_snapshot", f"""{MAP}, cl AS (SELECT collection, max(seq) FILTER (kind = 'clear') AS cut FROM c GROUP BY 1),
r AS (SELECT c.* FROM c JOIN cl USING (collection) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut))
SELECT collection, k, v FROM r QUALIFY row_number() OVER (PARTITION BY collection, k ORDER BY seq DESC) = 1 AND kind = 'set'""")
def c1(spark, d):
    return collections.map_snapshot(map_changes(spark, d))


@job("c1_map_errors", f"""{MAP}, er AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY collection ORDER BY seq) AS era FROM c),
kd AS (SELECT *, lag(kind) OVER w AS was, lag(CASE WHEN kind = 'set' THEN v END) OVER w AS before FROM er WHERE kind <> 'clear' WINDOW w AS (PARTITION BY collection, era, k ORDER BY seq)),
orig AS (SELECT collection, seq, n.k AS full_k FROM n),
x AS (SELECT kd.*, full_k % 7 = 0 AND kind = 'set' AS claims FROM kd JOIN orig USING (collection, seq)),
sz AS (SELECT collection, era, sum(CASE WHEN kind = 'set' AND coalesce(was, '') <> 'set' THEN 1 WHEN kind = 'delete' AND was = 'set' THEN -1 ELSE 0 END) AS size FROM x GROUP BY 1, 2)
SELECT collection, seq, CASE WHEN kind = 'delete' AND coalesce(was, '') <> 'set' THEN 'missing key' ELSE 'wrong previous' END AS error FROM x
WHERE (kind = 'delete' AND coalesce(was, '') <> 'set') OR (claims AND (CASE WHEN was = 'set' THEN before END) IS DISTINCT FROM 1)
UNION ALL SELECT er.collection, er.seq, 'wrong clear count' FROM er LEFT JOIN sz ON sz.collection = er.collection AND sz.era = er.era - 1 WHERE kind = 'clear' AND coalesce(size, 0) <> 4""")
def c1_errors(spark, d):
    return collections.map_errors(map_changes(spark, d))


INDEX = f"""{MAP}, ix AS (SELECT c.collection, c.seq, CASE WHEN c.kind = 'clear' THEN 'clear' WHEN c.kind = 'delete' AND n.cents % 2 = 0 THEN 'deleteMany' WHEN c.kind = 'delete' THEN 'delete' ELSE 'upsert' END AS kind, n.k % 20 AS p, n.event_type AS secondary, n.cents AS value FROM c JOIN n USING (collection, seq)),
cl AS (SELECT collection, max(seq) FILTER (kind = 'clear') AS cut FROM ix GROUP BY 1), r AS (SELECT ix.* FROM ix JOIN cl USING (collection) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut)),
x AS (SELECT collection, seq, kind, unnest(CASE WHEN kind = 'deleteMany' THEN [p, (p + 1) % 20] ELSE [p] END) AS prim, secondary, value FROM r)
SELECT collection, prim AS primary, secondary, value FROM x QUALIFY row_number() OVER (PARTITION BY collection, prim ORDER BY seq DESC) = 1 AND kind = 'upsert'"""


def index_changes(spark, d):
    p = F.col("k") % 20
    kind = F.when(F.expr(CLEARS), "clear").when(F.col("event_type") == "error", F.when(F.col("cents") % 2 == 0, "deleteMany").otherwise("delete")).otherwise("upsert")
    rows = changes(spark, d).withColumn("kind", kind).select("collection", "seq", "kind", p.alias("primary"), F.col("event_type").alias("secondary"), F.col("cents").alias("value"), F.array(p, (p + 1) % 20).alias("primaries"))
    return rows


@job("c2_index_snapshot", INDEX)
def c2(spark, d):
    return collections.index_snapshot(index_changes(spark, d))


@job("c5_restored_index", INDEX)
def c5_index(spark, d):
    return through_snapshot(index_changes(spark, d), collections.index_snapshot, collections.restore_index)


LOG = f"""{E}, {N}, c0 AS (SELECT collection, seq, CASE WHEN {CLEARS} THEN 'clear' WHEN event_type = 'error' AND seq > 30 THEN 'trimHead' WHEN event_type = 'view' THEN 'appendMany' ELSE 'append' END AS kind, cents, k FROM n),
ce AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY collection ORDER BY seq) AS era, CASE kind WHEN 'append' THEN 1 WHEN 'appendMany' THEN 2 WHEN 'trimHead' THEN -(1 + k % 3) ELSE 0 END AS d, CASE WHEN kind = 'clear' AND k > 7 THEN 5 END AS claim FROM c0),
cn AS (SELECT *, sum(d) OVER (PARTITION BY collection, era ORDER BY seq) AS len FROM ce), held AS (SELECT collection, era + 1 AS era, arg_max(len, seq) AS len FROM cn GROUP BY 1, 2),
le AS (SELECT collection, min(seq) AS seq, arg_min(error, seq) AS error FROM (SELECT cn.collection, cn.seq, CASE WHEN kind = 'trimHead' AND cn.len < 0 THEN 'trimHead exceeds length' WHEN claim <> coalesce(held.len, 0) THEN 'wrong clear count' END AS error FROM cn LEFT JOIN held ON held.collection = cn.collection AND held.era = cn.era) WHERE error IS NOT NULL GROUP BY 1),
c AS (SELECT c0.collection, c0.seq, kind, cents, 1 + k % 3 AS trim FROM c0 LEFT JOIN le USING (collection) WHERE le.seq IS NULL OR c0.seq < le.seq),
cl AS (SELECT collection, max(seq) FILTER (kind = 'clear') AS cut, FROM c GROUP BY 1), r AS (SELECT c.*, coalesce(cut, -1) AS cut FROM c JOIN cl USING (collection) WHERE cut IS NULL OR seq > cut),
a AS (SELECT collection, seq, i, v FROM (SELECT collection, seq, unnest(CASE WHEN kind = 'append' THEN [0] ELSE [0, 1] END) AS i, cents FROM r WHERE kind IN ('append', 'appendMany')) t, LATERAL (SELECT cents + i AS v)),
o AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY seq, i) AS pos FROM a), h AS (SELECT collection, coalesce(sum(trim) FILTER (kind = 'trimHead'), 0) AS head FROM r GROUP BY 1),
sn AS (SELECT collection, CAST(pos - head - 1 AS BIGINT) AS position, v AS value FROM o JOIN h USING (collection) WHERE pos > head)"""


def log_changes(spark, d):
    kind = F.when(F.expr(CLEARS), "clear").when((F.col("event_type") == "error") & (F.col("seq") > 30), "trimHead").when(F.col("event_type") == "view", "appendMany").otherwise("append")
    return changes(spark, d).select("collection", "seq", kind.alias("kind"), F.col("cents").alias("value"), F.array("cents", F.col("cents") + 1).alias("values"), (1 + F.col("k") % 3).alias("n"), F.when((kind == "clear") & (F.col("k") > 7), 5).alias("count"))


@job("c3_log_snapshot", f"{LOG} SELECT * FROM sn")
def c3(spark, d):
    return collections.log_snapshot(log_changes(spark, d))


@job("c3_log_errors", f"{LOG} SELECT * FROM le")
def c3_errors(spark, d):
    return collections.log_errors(log_changes(spark, d))


LIST = f"""WITH RECURSIVE {EVENTS_SQL}, {N}, m AS (SELECT *, CASE WHEN seq = 0 THEN 'append' WHEN event_type = 'error' AND k % 3 > 0 THEN 'pop' WHEN event_type = 'error' THEN 'trimHead' WHEN event_type = 'signup' THEN 'insert' ELSE 'append' END AS kind, k % 6 AS pl, CASE WHEN event_type = 'error' AND k = 50 THEN -1 END AS claim FROM n),
f AS (SELECT collection, seq, [cents] AS xs, CAST(NULL AS VARCHAR) AS error FROM n WHERE seq = 0 UNION ALL
 SELECT collection, seq, CASE WHEN error IS NOT NULL THEN xs WHEN kind = 'pop' THEN list_concat(list_slice(xs, 1, pl), list_slice(xs, pl + 2, len(xs))) WHEN kind = 'trimHead' THEN list_slice(xs, pl + 1, len(xs)) WHEN kind = 'insert' THEN list_concat(list_concat(list_slice(xs, 1, pl), [cents]), list_slice(xs, pl + 1, len(xs))) ELSE list_append(xs, cents) END, error
 FROM (SELECT m.*, f.xs, coalesce(f.error, CASE WHEN kind = 'insert' AND pl > len(f.xs) THEN 'insert out of bounds' WHEN kind = 'pop' AND pl >= len(f.xs) THEN 'pop out of bounds' WHEN kind = 'pop' AND claim <> f.xs[pl + 1] THEN 'wrong pop value' WHEN kind = 'trimHead' AND pl > len(f.xs) THEN 'trimHead exceeds length' END) AS error
  FROM f JOIN m ON m.collection = f.collection AND m.seq = f.seq + 1)),
l AS (SELECT collection, arg_max(xs, seq) AS xs FROM f GROUP BY 1)"""


def list_changes(spark, d):
    k, kind = F.col("k"), F.col("event_type")
    error = kind == "error"
    kind = F.when(F.col("seq") == 0, "append").when(error & (k % 3 > 0), "pop").when(error, "trimHead").when(kind == "signup", "insert").otherwise("append")
    value = F.when(kind != "pop", F.col("cents")).when(k == 50, -1)
    return changes(spark, d).select("collection", "seq", kind.alias("kind"), (k % 6).alias("index"), value.alias("value"), F.array("cents").alias("values"), (k % 6).alias("n"))


@job("c4_list_snapshot", f"{LIST} SELECT collection, CAST(i - 1 AS BIGINT) AS position, xs[i] AS value FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM l)")
def c4(spark, d):
    return collections.list_snapshot(list_changes(spark, d))


@job("c4_list_errors", f"{LIST} SELECT collection, min(seq) AS seq, min(error) AS error FROM f WHERE error IS NOT NULL GROUP BY 1")
def c4_errors(spark, d):
    return collections.list_errors(list_changes(spark, d))


def cursors_of(rows):
    return rows.select("collection").distinct().withColumn("cursor", F.when(F.col("collection") % 3 == 0, -1).otherwise(20))


def through_snapshot(rows, fold, restore):
    """State by way of a snapshot at the cursor and the changes after it."""
    cursors = cursors_of(rows)
    before = rows.join(cursors, "collection").where(F.col("seq") <= F.col("cursor")).drop("cursor")
    return restore(fold(before), rows, cursors)[0]


@job("c5_restored_log", f"{LOG} SELECT * FROM sn WHERE collection NOT IN (SELECT collection FROM le WHERE seq <= 20)")
def c5_log(spark, d):
    rows = log_changes(spark, d)
    early = collections.log_errors(rows.where("seq <= 20")).select("collection")  # no snapshot is made of a log at fault
    return through_snapshot(rows.join(early, "collection", "left_anti"), collections.log_snapshot, collections.restore_log)


@job("c5_restored_list", f"{LIST} SELECT collection, CAST(i - 1 AS BIGINT) AS position, xs[i] AS value FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM l WHERE collection NOT IN (SELECT collection FROM f WHERE error IS NOT NULL AND seq <= 20))")
def c5_list(spark, d):
    rows = list_changes(spark, d)
    early = collections.list_errors(rows.where("seq <= 20")).select("collection")  # no snapshot is made of a list at fault
    return through_snapshot(rows.join(early, "collection", "left_anti"), collections.list_snapshot, collections.restore_list)


@job("c5_restore", f"""{MAP}, cu AS (SELECT collection, CASE WHEN collection % 3 = 0 THEN -1 ELSE 20 END AS cursor FROM (SELECT DISTINCT collection FROM c)),
g AS (SELECT collection, count(*) AS applied, max(seq) AS high FROM c JOIN cu USING (collection) WHERE seq > cursor GROUP BY 1)
SELECT collection, coalesce(applied, 0) AS applied, coalesce(high, cursor) AS cursor, true AS contiguous, CASE WHEN cursor >= 0 AND applied > 0 THEN 'snapshot+changes' WHEN cursor >= 0 THEN 'snapshot' WHEN applied > 0 THEN 'changes' ELSE 'empty' END AS source FROM cu LEFT JOIN g USING (collection)""")
def c5(spark, d):
    rows = map_changes(spark, d)
    cursors = rows.select("collection").distinct().withColumn("cursor", F.when(F.col("collection") % 3 == 0, -1).otherwise(20))
    before = rows.join(cursors, "collection").where(F.col("seq") <= F.col("cursor")).drop("cursor")
    return collections.restore_map(collections.map_snapshot(before), rows, cursors)[1]


@job("c5_restored_state", f"""{MAP}, cl AS (SELECT collection, max(seq) FILTER (kind = 'clear') AS cut FROM c GROUP BY 1),
r AS (SELECT c.* FROM c JOIN cl USING (collection) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut))
SELECT collection, k, v FROM r QUALIFY row_number() OVER (PARTITION BY collection, k ORDER BY seq DESC) = 1 AND kind = 'set'""")
def c5_state(spark, d):
    rows = map_changes(spark, d)
    cursors = rows.select("collection").distinct().withColumn("cursor", F.when(F.col("collection") % 3 == 0, -1).otherwise(20))
    before = rows.join(cursors, "collection").where(F.col("seq") <= F.col("cursor")).drop("cursor")
    return collections.restore_map(collections.map_snapshot(before), rows, cursors)[0]


@job("c7_max_size", f"{E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) <= 10")
def c7(spark, d):
    return collections.keep_last(events(spark, d), 10, ORDER, KEY).select("user_id", "event_id")


@job("c8_reads", f"""{LOG}, m AS (SELECT *, max(position) OVER (PARTITION BY collection) + 1 AS n FROM sn)
SELECT 'at' AS read, collection, position, value FROM m WHERE position = n - 2 UNION ALL SELECT 'tail', collection, position, value FROM m WHERE position >= n - 3
UNION ALL SELECT 'slice', collection, position, value FROM m WHERE position >= 2 AND position < 5 UNION ALL SELECT 'page', collection, position, value FROM m WHERE position >= 10 AND position < 14""")
def c8(spark, d):
    s = collections.log_snapshot(log_changes(spark, d))
    named = lambda n, df: df.withColumn("read", F.lit(n))
    return named("at", collections.at(s, -2)).unionByName(named("tail", collections.tail(s, 3))).unionByName(named("slice", collections.slice_rows(s, 2, 5))).unionByName(named("page", collections.page(s, 10, 4)))


@job("c9_key_range", f"{MAP}, x AS (SELECT * FROM c WHERE kind <> 'clear') SELECT collection, k, arg_max(v, seq) AS v FROM x WHERE k >= 3 AND k < 6 GROUP BY 1, 2")
def c9(spark, d):
    rows = map_changes(spark, d).where("kind <> 'clear'")
    rows = rows.join(changes(spark, d).select("collection", "seq", "cents"), ["collection", "seq"])
    return collections.key_range(rows, "k", 3, 6).groupBy("collection", "k").agg(F.max_by("cents", "seq").alias("v"))


@job("c9_map_range", f"""{MAP}, cl AS (SELECT collection, max(seq) FILTER (kind = 'clear') AS cut FROM c GROUP BY 1), r AS (SELECT c.* FROM c JOIN cl USING (collection) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut)),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY collection, k ORDER BY seq DESC) = 1 AND kind = 'set') SELECT collection, k, v FROM s WHERE k >= 3 AND k < 6""")
def c9_map(spark, d):
    """The range of what each map holds at its end: clears and deletes count."""
    return collections.key_range(collections.map_snapshot(map_changes(spark, d)), "k", 3, 6)


@job("c10_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def c10(spark, d):
    keys = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return collections.lookup(read(spark, d, "orders"), keys, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@job("c11_deltas", f"""{E}, b AS (SELECT user_id, k % 10 AS k, arg_max(cents, (ms, event_id)) AS v FROM e WHERE event_type = 'click' GROUP BY 1, 2), a AS (SELECT user_id, k % 10 AS k, arg_max(cents, (ms, event_id)) AS v FROM e WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NULL THEN 'delete' ELSE 'set' END AS kind, a.v AS v, b.v AS previous FROM b FULL JOIN a USING (user_id, k) WHERE a.v IS DISTINCT FROM b.v""")
def c11(spark, d):
    e = events(spark, d).withColumn("k", F.col("k") % 10)
    state = lambda df: df.groupBy("user_id", "k").agg(F.max_by("cents", F.struct("ms", "event_id")).alias("v"))
    return collections.deltas(state(e.where("event_type = 'click'")), state(e.where("event_type in ('view', 'click')")), ["user_id", "k"], "v")


def calls(spark, d):
    """A user's events as calls on collections."""
    k = F.col("k")
    return events(spark, d).withColumns({"collection": F.col("user_id"), "ord": F.col("event_id"), "many": F.array((k % 10).cast("long"), ((k + 3) % 10).cast("long"), (k % 10).cast("long")), "short": (F.col("event_type") == "signup") & (k < 10)})


CALLS = f"""{E}, m AS (SELECT user_id AS collection, event_id AS ord, cents, k, event_type AS t, CASE WHEN {CLEARS} THEN 'clear' WHEN event_type = 'error' THEN CASE WHEN k % 2 = 1 THEN 'delete' ELSE 'delete_many' END WHEN event_type = 'purchase' THEN 'set_many' ELSE 'set' END AS op FROM e)"""
ITEMS = CALLS + """, x AS (SELECT *, unnest(CASE op WHEN 'set_many' THEN [0, 1] WHEN 'delete_many' THEN [0, 1, 2] ELSE [0] END) AS i FROM m WHERE op <> '{without}'),
y AS (SELECT *, CASE WHEN op = 'delete_many' AND i = 1 THEN (k + 3) % 10 WHEN op = 'set_many' THEN (k + i) % 10 WHEN op <> 'clear' THEN k % 10 END AS key, cents + i AS v, op LIKE 'set%' AS put, sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY collection ORDER BY ord, i) AS era FROM x),
z AS (SELECT *, coalesce(lag(put) OVER w, false) AS live, lag(v) OVER w AS was FROM y WHERE op <> 'clear' WINDOW w AS (PARTITION BY collection, era, key ORDER BY ord, i)),
c AS (SELECT y.*, n FROM y JOIN (SELECT collection, era + 1 AS era, CAST(sum(CASE WHEN put AND NOT live THEN 1 WHEN NOT put AND live THEN -1 ELSE 0 END) AS BIGINT) AS n FROM z GROUP BY 1, 2) USING (collection, era) WHERE op = 'clear' AND n > 0)"""


@job("c11_map_mutations", ITEMS.format(without="none") + """, d AS (SELECT collection, ord, i, CASE WHEN put THEN 'set' ELSE 'delete' END AS kind, key AS k, CASE WHEN put THEN v END AS v, CASE WHEN NOT put THEN was END AS previous, CAST(NULL AS BIGINT) AS count FROM z WHERE put OR live UNION ALL SELECT collection, ord, i, 'clear', NULL, NULL, NULL, n FROM c)
SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY ord, i) - 1 AS seq, ord, kind, k, v, previous, count FROM d""")
def c11_maps(spark, d):
    """Sets, deletes and clears, many at once or one by one: only what changes a map is a change."""
    k, t = F.col("k"), F.col("event_type")
    op = F.when(F.col("short"), "clear").when(t == "error", F.when(k % 2 == 1, "delete").otherwise("delete_many")).when(t == "purchase", "set_many").otherwise("set")
    entry = lambda i: F.struct(((k + i) % 10).cast("long").alias("k"), (F.col("cents") + i).alias("v"))
    rows = calls(spark, d).select("collection", "ord", op.alias("op"), (k % 10).cast("long").alias("k"), F.col("cents").alias("v"), F.array(entry(0), entry(1)).alias("entries"), F.col("many").alias("keys"))
    return mutations.map_changes(rows)


@job("c11_index_mutations", ITEMS.format(without="set_many") + """, d AS (SELECT collection, ord, 0 AS i, CASE WHEN put THEN 'upsert' ELSE 'delete' END AS kind, key AS "primary", CASE WHEN put THEN t END AS secondary, CASE WHEN put THEN cents END AS value, CAST(NULL AS BIGINT[]) AS primaries, CAST(NULL AS BIGINT) AS count FROM z WHERE (put OR live) AND op <> 'delete_many'
 UNION ALL SELECT collection, ord, 0, 'deleteMany', NULL, NULL, NULL, list(key ORDER BY i)::BIGINT[], NULL FROM z WHERE op = 'delete_many' AND live GROUP BY 1, 2 UNION ALL SELECT collection, ord, 0, 'clear', NULL, NULL, NULL, NULL, n FROM c)
SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY ord) - 1 AS seq, ord, kind, "primary", secondary, value, primaries, count FROM d""")
def c11_indexes(spark, d):
    k, t = F.col("k"), F.col("event_type")
    op = F.when(F.col("short"), "clear").when(t == "error", F.when(k % 2 == 1, "delete").otherwise("delete_many")).otherwise("upsert")
    rows = calls(spark, d).where("event_type <> 'purchase'").select("collection", "ord", op.alias("op"), (k % 10).cast("long").alias("primary"), t.alias("secondary"), F.col("cents").alias("value"), F.col("many").alias("keys"))
    return mutations.index_changes(rows)


@job("c11_log_mutations", f"""WITH RECURSIVE {EVENTS_SQL}, m AS (SELECT user_id AS collection, event_id AS ord, CASE WHEN event_type = 'error' THEN 'trim_head' WHEN {CLEARS} THEN 'clear' WHEN event_type IN ('view', 'purchase') THEN 'append_many' ELSE 'append' END AS op, cents AS value, CASE WHEN k % 5 = 0 THEN [] ELSE [cents, k] END AS vs, k % 6 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e),
f AS (SELECT DISTINCT collection, 0 AS rn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS value, CAST([] AS BIGINT[]) AS vs, 0::BIGINT AS took, 0::BIGINT AS cut, 0::BIGINT AS len FROM m
 UNION ALL SELECT collection, rn, ord, op, value, vs, took, greatest(0, grown - 12), least(12, grown) FROM (SELECT m.*, CASE m.op WHEN 'trim_head' THEN least(m.n, f.len) WHEN 'clear' THEN f.len ELSE 0 END AS took,
  CASE m.op WHEN 'append' THEN f.len + 1 WHEN 'append_many' THEN f.len + len(m.vs) WHEN 'clear' THEN 0 ELSE f.len - least(m.n, f.len) END AS grown FROM f JOIN m ON m.collection = f.collection AND m.rn = f.rn + 1)),
d AS (SELECT collection, ord, 0 AS i, CASE op WHEN 'append_many' THEN 'appendMany' WHEN 'trim_head' THEN 'trimHead' ELSE op END AS kind, CASE WHEN op = 'append' THEN value END AS value, CASE WHEN op = 'append_many' THEN vs END AS "values", CASE WHEN op = 'trim_head' THEN took END AS n, CASE WHEN op = 'clear' THEN took END AS count
  FROM f WHERE rn > 0 AND (op = 'append' OR (op = 'append_many' AND len(vs) > 0) OR took > 0) UNION ALL SELECT collection, ord, 1, 'trimHead', NULL, NULL, cut, NULL FROM f WHERE cut > 0)
SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY ord, i) - 1 AS seq, ord, kind, value, "values", n, count FROM d""")
def c11_logs(spark, d):
    """Logs of at most twelve values: trims by call and by capacity."""
    k, t = F.col("k"), F.col("event_type")
    op = F.when(t == "error", "trim_head").when(F.col("short"), "clear").when(t.isin("view", "purchase"), "append_many").otherwise("append")
    values = F.when(k % 5 != 0, F.array("cents", k.cast("long")))
    return mutations.log_changes(calls(spark, d).select("collection", "ord", op.alias("op"), F.col("cents").alias("value"), values.alias("values"), (k % 6).cast("long").alias("n")), 12)


@job("c11_list_mutations", f"""WITH RECURSIVE {EVENTS_SQL}, m AS (SELECT user_id AS collection, event_id AS ord, CASE WHEN event_type = 'error' THEN 'pop' WHEN {CLEARS} THEN 'clear' WHEN event_type = 'view' THEN 'insert' WHEN event_type = 'purchase' THEN 'insert_many' WHEN event_type = 'signup' THEN 'append_many' ELSE 'append' END AS op, cents AS value, [cents, k] AS vs,
 CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN -1 ELSE k % 7 - 3 END WHEN event_type = 'view' THEN k % 6 ELSE k % 4 END AS pos, event_type = 'error' AND k % 3 = 0 AS bare, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e),
f AS (SELECT DISTINCT collection, 0 AS rn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS value, CAST([] AS BIGINT[]) AS vs, 0::BIGINT AS held, 0::BIGINT AS cut, CAST([] AS BIGINT[]) AS xs FROM m
 UNION ALL SELECT collection, rn, ord, op, error, CASE WHEN error IS NOT NULL AND bare THEN NULL WHEN error IS NULL AND op = 'pop' THEN pl ELSE pos END, CASE WHEN error IS NULL AND op = 'pop' THEN xs[pl + 1] ELSE value END, vs, len(xs), greatest(0, len(grown) - 8), list_slice(grown, greatest(0, len(grown) - 8) + 1, len(grown)) FROM (
  SELECT *, CASE WHEN error IS NOT NULL THEN xs WHEN op = 'pop' THEN list_concat(list_slice(xs, 1, pl), list_slice(xs, pl + 2, len(xs))) WHEN op = 'clear' THEN [] WHEN op = 'insert' THEN list_concat(list_concat(list_slice(xs, 1, pos), [value]), list_slice(xs, pos + 1, len(xs)))
   WHEN op = 'insert_many' THEN list_concat(list_concat(list_slice(xs, 1, pos), vs), list_slice(xs, pos + 1, len(xs))) WHEN op = 'append_many' THEN list_concat(xs, vs) ELSE list_append(xs, value) END AS grown FROM (
   SELECT m.*, f.xs, CASE WHEN m.pos < 0 THEN m.pos + len(f.xs) ELSE m.pos END AS pl, CASE WHEN m.op LIKE 'insert%' AND m.pos > len(f.xs) THEN 'insert out of bounds' WHEN m.op = 'pop' AND (m.pos >= len(f.xs) OR m.pos < -len(f.xs)) THEN 'pop out of bounds' END AS error FROM f JOIN m ON m.collection = f.collection AND m.rn = f.rn + 1))),
d AS (SELECT collection, ord, 0 AS i, CASE WHEN error IS NOT NULL THEN 'error' WHEN op = 'append_many' THEN 'appendMany' WHEN op = 'insert_many' THEN 'insertMany' ELSE op END AS kind, CASE WHEN op LIKE 'insert%' OR op = 'pop' THEN pos END AS "index", CASE WHEN error IS NULL AND op IN ('append', 'insert', 'pop') THEN value END AS value,
  CASE WHEN error IS NULL AND op LIKE '%many' THEN vs END AS "values", CAST(NULL AS BIGINT) AS n, CASE WHEN op = 'clear' THEN held END AS count, error FROM f WHERE rn > 0 AND (op <> 'clear' OR held > 0) UNION ALL SELECT collection, ord, 1, 'trimHead', NULL, NULL, NULL, cut, NULL, NULL FROM f WHERE cut > 0)
SELECT collection, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY collection, error IS NULL ORDER BY ord, i) - 1 END AS seq, ord, kind, "index", value, "values", n, count, error FROM d""")
def c11_lists(spark, d):
    """Lists of at most eight values: positional calls, some out of bounds."""
    k, t = F.col("k"), F.col("event_type")
    op = F.when(t == "error", "pop").when(F.col("short"), "clear").when(t == "view", "insert").when(t == "purchase", "insert_many").when(t == "signup", "append_many").otherwise("append")
    at = F.when(t == "error", F.when(k % 3 != 0, k % 7 - 3)).when(t == "view", k % 6).otherwise(k % 4)
    return mutations.list_changes(calls(spark, d).select("collection", "ord", op.alias("op"), at.cast("long").alias("index"), F.col("cents").alias("value"), F.array("cents", k.cast("long")).alias("values")), 8)


@job("c12_wal_frames", f"""{E}, {N}, b AS (SELECT 'user/' || collection || '/' || lpad(CAST(seq AS VARCHAR), 20, '0') AS frame_key, '{{"cents":' || cents || ',"kind":"' || event_type || '"}}' AS change FROM n)
SELECT frame_key, sha256(change) AS checksum, true AS verified FROM b""")
def c12(spark, d):
    body = ids.canonical_json(kind=F.col("event_type"), cents=F.col("cents"))
    out = collections.frames(changes(spark, d), F.concat(F.lit("user/"), F.col("collection").cast("string")), F.col("seq"), body)
    return collections.verified(out).select("frame_key", "checksum", "verified")


@job("c13_content_store", f"""{E}, s AS (SELECT DISTINCT 'x:' || sha256('{{"k":' || k || ',"t":"' || event_type || '"}}') AS key FROM e WHERE event_type IN ('click', 'view'))
SELECT event_id, s.key IS NOT NULL AS hit, CASE WHEN s.key IS NULL THEN 'missing entry' END AS error FROM e LEFT JOIN s ON s.key = 'x:' || sha256('{{"k":' || e.k || ',"t":"' || e.event_type || '"}}')""")
def c13(spark, d):
    keyed = events(spark, d).withColumn("key", ids.content_key("x:", ids.canonical_json(t=F.col("event_type"), k=F.col("k"))))
    store = keyed.where("event_type in ('click', 'view')").select("key", F.col("event_type").alias("value"))
    return collections.content_lookup(keyed, store, mode="read-strict").select("event_id", "hit", "error")


@job("c13_store_after", f"""{E}, b AS (SELECT k AS key, min(cents) AS value FROM e WHERE event_type = 'click' GROUP BY 1), a AS (SELECT k AS key, event_id AS ord, CASE WHEN event_type = 'error' THEN 'forget' ELSE 'store' END AS kind, cents FROM e WHERE event_type <> 'click'),
m AS (SELECT unnest(['read', 'read-strict', 'write', 'read-write']) AS mode), l AS (SELECT mode, key, kind, cents FROM a, m WHERE (kind = 'store' AND mode <> 'read') OR (kind = 'forget' AND mode LIKE 'read-%') QUALIFY row_number() OVER (PARTITION BY mode, key ORDER BY ord DESC) = 1)
SELECT mode, key, coalesce(l.cents, x.value) AS value FROM (SELECT * FROM b, m) x FULL JOIN l USING (mode, key) WHERE coalesce(l.kind, 'store') = 'store'""")
def c13_after(spark, d):
    """What a store holds after stores and forgets, in each of its modes."""
    e = events(spark, d)
    store = e.where("event_type = 'click'").groupBy(F.col("k").alias("key")).agg(F.min("cents").alias("value"))
    asks = e.where("event_type <> 'click'").select(F.col("k").alias("key"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "forget").otherwise("store").alias("kind"), F.col("cents").alias("value"))
    kept = [collections.content_apply(store, asks, mode).select(F.lit(mode).alias("mode"), "key", "value") for mode in collections.MODES]
    return kept[0].union(kept[1]).union(kept[2]).union(kept[3])


TIERS = f"{E}, t0 AS (SELECT k AS key, min(cents) AS value FROM e WHERE event_type = 'error' AND k % 3 = 0 GROUP BY 1), t1 AS (SELECT k AS key, min(cents) AS value FROM e WHERE event_type = 'view' AND k % 2 = 0 GROUP BY 1), q AS (SELECT DISTINCT k AS key FROM e), f AS (SELECT key, coalesce(t0.value, t1.value) AS value, CASE WHEN t0.value IS NOT NULL THEN 0 WHEN t1.value IS NOT NULL THEN 1 ELSE -1 END AS tier FROM q LEFT JOIN t0 USING (key) LEFT JOIN t1 USING (key))"


def found(spark, d):
    e = events(spark, d)
    tier = lambda cond: e.where(cond).groupBy(F.col("k").alias("key")).agg(F.min("cents").alias("value"))
    return collections.tiered(e.select(F.col("k").alias("key")).distinct(), [tier("event_type = 'error' and k % 3 = 0"), tier("event_type = 'view' and k % 2 = 0")])


@job("c14_tiered_read", f"{TIERS} SELECT * FROM f")
def c14(spark, d):
    return found(spark, d)


@job("c14_lookup_facts", f"{TIERS} SELECT key, 0 AS asked, CASE WHEN tier = 0 THEN 'hit' ELSE 'miss' END AS result FROM f UNION ALL SELECT key, 1, CASE WHEN tier = 1 THEN 'hit' ELSE 'miss' END FROM f WHERE tier <> 0")
def c14_facts(spark, d):
    return collections.asked(found(spark, d), 2).select("key", "asked", "result")


@job("c14_promotions", f"{TIERS} SELECT key, value, 0 AS to_tier FROM f WHERE tier = 1")
def c14_promotions(spark, d):
    return collections.promotions(found(spark, d)).select("key", "value", "to_tier")


CACHE = f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT event_id AS ord, CASE WHEN event_type = 'purchase' THEN 'put' WHEN event_type = 'error' THEN CASE WHEN k % 2 = 1 THEN 'remove' ELSE 'invalidate' END WHEN event_type = 'signup' AND k > 30 THEN 'policy' ELSE 'request' END AS kind, 'u' || (user_id % 60) AS key, k % 3 AS tier, cents, CASE WHEN event_id % 7 > 0 THEN event_id END AS loaded, ['none', 'all', '0'][k % 3 + 1] AS policy FROM e),
p AS (SELECT ord, CASE WHEN kind = 'policy' THEN 'request' ELSE kind END AS kind, CASE WHEN kind = 'policy' THEN last_value(CASE WHEN kind IN ('request', 'invalidate') THEN key END IGNORE NULLS) OVER (ORDER BY ord) ELSE key END AS key, tier, cents, loaded, coalesce(last_value(CASE WHEN kind = 'policy' THEN policy END IGNORE NULLS) OVER (ORDER BY ord), 'none') AS policy FROM o),
m AS (SELECT *, kind IN ('request', 'invalidate') AS looks, row_number() OVER (PARTITION BY key ORDER BY ord) AS rn, CASE WHEN kind IN ('request', 'invalidate') THEN sum(CASE WHEN kind IN ('request', 'invalidate') THEN 1 ELSE 0 END) OVER (ORDER BY ord) END::BIGINT AS request_seq FROM p WHERE key IS NOT NULL),
f AS (SELECT DISTINCT key, 0 AS rn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS request_seq, false AS looks, 'none' AS policy, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS found, CAST(NULL AS BIGINT) AS v0, CAST(NULL AS BIGINT) AS v1, CAST(NULL AS BIGINT) AS v2 FROM m
 UNION ALL SELECT key, rn, ord, kind, request_seq, looks, policy, src, found, CASE WHEN kind = 'put' AND tier = 0 THEN cents WHEN kind = 'remove' AND tier = 0 THEN NULL WHEN looks AND found IS NOT NULL AND policy <> 'none' AND src > 0 THEN found ELSE v0 END,
  CASE WHEN kind = 'put' AND tier = 1 THEN cents WHEN kind = 'remove' AND tier = 1 THEN NULL WHEN looks AND found IS NOT NULL AND policy = 'all' AND src > 1 THEN found ELSE v1 END, CASE WHEN kind = 'put' AND tier = 2 THEN cents WHEN kind = 'remove' AND tier = 2 THEN NULL WHEN looks AND found IS NOT NULL AND policy = 'all' AND src > 2 THEN found ELSE v2 END
 FROM (SELECT m.*, f.v0, f.v1, f.v2, CASE WHEN f.v0 IS NOT NULL THEN 0 WHEN f.v1 IS NOT NULL THEN 1 WHEN f.v2 IS NOT NULL THEN 2 ELSE 3 END AS src, coalesce(f.v0, f.v1, f.v2, m.loaded) AS found FROM f JOIN m ON m.key = f.key AND m.rn = f.rn + 1)),
l AS (SELECT *, unnest(range(0, src + 1)) AS t FROM f WHERE looks), q AS (SELECT *, unnest(CASE policy WHEN 'all' THEN range(0, src) WHEN '0' THEN range(0, least(src, 1)) ELSE [] END) AS t FROM f WHERE looks AND found IS NOT NULL)
"""


def cache(spark, d):
    """Events as operations on a cache of three tiers over an origin; policies switch as it goes."""
    e, k, t, n = events(spark, d), F.col("k"), F.col("event_type"), F.col("event_id")
    kind = F.when(t == "purchase", "put").when(t == "error", F.when(k % 2 == 1, "remove").otherwise("invalidate")).when((t == "signup") & (k > 30), "policy").otherwise("request")
    policy = F.element_at(F.array(*map(F.lit, ["none", "all", "0"])), (k % 3 + 1).cast("int"))
    rows = e.select(n.alias("ord"), kind.alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("key"), (k % 3).alias("tier"), F.col("cents").alias("value"), F.when(n % 7 > 0, n).alias("loaded"), policy.alias("policy"))
    return caches.cache_events(rows, 3)


@job("c14_cache_events", CACHE + """SELECT ord, key, request_seq, kind AS event, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS tier, CAST(NULL AS BIGINT) AS value FROM f WHERE looks
UNION ALL SELECT ord, key, request_seq, 'lookup', CASE WHEN t = src AND found IS NOT NULL THEN 'hit' ELSE 'miss' END, CASE WHEN t = 3 THEN -1 ELSE t END, CASE WHEN t = src THEN found END FROM l
UNION ALL SELECT ord, key, request_seq, 'promotion', 'ok', t, found FROM q UNION ALL SELECT ord, key, request_seq, 'fill', CASE WHEN found IS NULL THEN 'miss' ELSE 'hit' END, CASE WHEN found IS NULL THEN NULL WHEN src = 3 THEN -1 ELSE src END, found FROM f WHERE looks""")
def c14_events(spark, d):
    return cache(spark, d).drop("n")


@job("c14_cache_status", CACHE + """SELECT key, request_seq, CASE WHEN found IS NULL THEN 'miss' ELSE 'hit' END AS outcome, CASE WHEN found IS NULL THEN NULL WHEN src = 3 THEN -1 ELSE src END AS tier, found AS value, src + 1 AS asked,
 CASE WHEN found IS NULL OR policy = 'none' THEN 0 WHEN policy = '0' THEN least(src, 1) ELSE src END AS promoted FROM f WHERE looks""")
def c14_status(spark, d):
    return caches.status(cache(spark, d))


@job("s6_append_log", f"""{E}, {N}, old AS (SELECT collection, max(seq) AS m FROM n WHERE event_type = 'click' GROUP BY 1)
SELECT n.event_id, CAST(coalesce(m, -1) + row_number() OVER (PARTITION BY n.collection ORDER BY n.seq) AS BIGINT) AS seq FROM n LEFT JOIN old USING (collection) WHERE event_type = 'view'""")
def s6(spark, d):
    rows = changes(spark, d)
    return collections.append(rows.where("event_type = 'click'"), rows.where("event_type = 'view'").drop("seq").join(rows.select("event_id", F.col("seq").alias("at")), "event_id"), ["at"]).select("event_id", "seq")


@job("s6_log_page", f"""{E}, {N}, p AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY seq) AS r, count(*) OVER (PARTITION BY collection) AS c, FROM n WHERE seq > 40)
SELECT collection, event_id, c <= 15 AS done, max(seq) OVER (PARTITION BY collection) AS next_after FROM p WHERE r <= 15""")
def s6_page(spark, d):
    return collections.log_page(changes(spark, d), 40, 15).select("collection", "event_id", "done", "next_after")


@job("s6_truncated_sizes", f"{E}, {N} SELECT collection, count(*) AS size FROM n WHERE seq <= 25 GROUP BY 1")
def s6_sizes(spark, d):
    return collections.log_sizes(collections.truncate_after(changes(spark, d), 25))


@job("s7_prefix", "SELECT o_orderpriority || '/' || o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderpriority || '/' || o_orderkey LIKE '1-URGENT/1%'")
def s7_prefix(spark, d):
    table = read(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"))
    return collections.with_prefix(table, "1-URGENT/1")


@job("s7_keyed_upsert", f"""{E}, w AS (SELECT k AS key, arg_max(CASE WHEN event_type = 'error' THEN -1 ELSE cents END, event_id) AS v FROM e WHERE event_type <> 'click' GROUP BY 1), b AS (SELECT k AS key, min(cents) AS value FROM e WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(w.key, b.key) AS key, coalesce(w.v, b.value) AS value FROM w FULL JOIN b USING (key) WHERE coalesce(w.v, 0) <> -1""")
def s7(spark, d):
    e = events(spark, d)
    table = e.where("event_type = 'click'").groupBy(F.col("k").alias("key")).agg(F.min("cents").alias("value"))
    writes = e.where("event_type <> 'click'").select(F.col("k").alias("key"), F.when(F.col("event_type") != "error", F.col("cents")).alias("value"), "event_id")
    return collections.upsert(table, writes, "key", "event_id")


def commands(spark, d):
    """Events as publishes: a command id is used three times, a key four times; topics open and close, the policy
    switches; every third event is a subscription command too. Commands of all kinds share ids, and one close is a duplicate."""
    e = events(spark, d)
    n, k = F.col("event_id"), F.col("k")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    none = F.lit(None).cast("string")
    publish = e.select((n * 8 + 7).alias("ord"), F.lit("publish").alias("kind"), F.when(n % 211 == 0, "").otherwise(F.col("event_type")).alias("topic"), text("c", F.when(n % 10 == 0, n - n % 30).otherwise(n)).alias("command_id"), F.when(n % 4 == 0, text("i", n % 3000)).alias("idempotency_key"), F.col("cents").alias("payload"), F.col("ms").alias("now_ms"))
    edges = stage(e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("topic")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.min("ms").alias("now_ms")), "edges")  # four kinds of commands read it
    edge = lambda kind, ord_, id_: edges.select(ord_.alias("ord"), F.lit(kind).alias("kind"), "topic", id_.alias("command_id"), none.alias("idempotency_key"), F.lit(None).cast("long").alias("payload"), "now_ms")
    ensure = edge("ensure_topic", F.col("lo") * 8, text("c", F.col("lo") + 1))
    early = edge("close_topic", F.col("lo") * 8 - 6, none).where("topic = 'view'")
    again = edge("close_topic", F.col("hi") * 8 - 1598, text("c", F.col("lo") + 1)).where("topic = 'purchase'")
    close = edge("close_topic", F.col("hi") * 8 - 1198, text("x", F.col("hi"))).where("topic = 'signup'")
    policy = e.where("event_id % 1000 = 500").select((n * 8 + 3).alias("ord"), F.lit("topic_policy").alias("kind"), F.when(n % 2000 == 500, "create").otherwise("strict").alias("policy"), F.when(n % 3 == 0, text("c", n - 1)).alias("command_id"))
    kind = F.when(k.isin(1, 5), "subscribe").when(k.isin(2, 34), "seek").when((k == 89) & (n % 2 == 0), "close_subscription").otherwise("ack")
    topic = F.element_at(F.array(*map(F.lit, SUBSCRIBED)), (F.col("user_id") % len(SUBSCRIBED) + 1).cast("int"))
    subscribed = e.where("event_id % 3 = 0").select(
        (n * 8 + 5).alias("ord"), kind.alias("kind"), topic.alias("topic"), F.when(kind.isin("ack", "seek") & (n % 9 == 0), text("c", n)).alias("command_id"), F.when((n % 97 == 0) & (kind != "subscribe"), "").otherwise(text("s", F.col("user_id") % 40)).alias("subscription_id"),
        F.greatest(F.lit(0), F.floor(n * 2 / 13) + k - 60).cast("long").alias("seq"), F.when(k == 1, F.when(F.col("user_id") % 2 == 0, "earliest").otherwise("latest")).alias("start"),
    )
    rows = publish.union(ensure).union(early).union(again).union(close)
    return rows.unionByName(policy, allowMissingColumns=True).unionByName(subscribed, allowMissingColumns=True)


#: The topics of subscriptions; one that never is.
SUBSCRIBED = ["click", "view", "purchase", "signup", "error", "nowhere"]
MOST, AGE = 300, 345_600_000

BUS = f"""{E}, pb AS (SELECT event_id * 8 + 7 AS ord, 'publish' AS kind, CASE WHEN event_id % 211 = 0 THEN '' ELSE event_type END AS topic, 'c' || (CASE WHEN event_id % 10 = 0 THEN event_id - event_id % 30 ELSE event_id END) AS command_id,
 CASE WHEN event_id % 4 = 0 THEN 'i' || (event_id % 3000) END AS ik, cents AS payload, ms AS now_ms, NULL::VARCHAR AS policy, NULL::VARCHAR AS sid, NULL::BIGINT AS sseq, NULL::VARCHAR AS start FROM e),
ed AS (SELECT event_type AS topic, min(event_id) AS lo, max(event_id) AS hi, min(ms) AS now_ms FROM e WHERE event_type <> 'error' GROUP BY 1),
sb AS (SELECT *, CASE WHEN k IN (1, 5) THEN 'subscribe' WHEN k IN (2, 34) THEN 'seek' WHEN k = 89 AND event_id % 2 = 0 THEN 'close_subscription' ELSE 'ack' END AS kind FROM e WHERE event_id % 3 = 0),
cm AS (SELECT * FROM pb UNION ALL SELECT lo * 8, 'ensure_topic', topic, 'c' || (lo + 1), NULL, NULL, now_ms, NULL, NULL, NULL, NULL FROM ed UNION ALL SELECT lo * 8 - 6, 'close_topic', topic, NULL, NULL, NULL, now_ms, NULL, NULL, NULL, NULL FROM ed WHERE topic = 'view'
 UNION ALL SELECT hi * 8 - 1598, 'close_topic', topic, 'c' || (lo + 1), NULL, NULL, now_ms, NULL, NULL, NULL, NULL FROM ed WHERE topic = 'purchase' UNION ALL SELECT hi * 8 - 1198, 'close_topic', topic, 'x' || hi, NULL, NULL, now_ms, NULL, NULL, NULL, NULL FROM ed WHERE topic = 'signup'
 UNION ALL SELECT event_id * 8 + 3, 'topic_policy', NULL, CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id - 1) END, NULL, NULL, NULL, CASE WHEN event_id % 2000 = 500 THEN 'create' ELSE 'strict' END, NULL, NULL, NULL FROM e WHERE event_id % 1000 = 500
 UNION ALL SELECT event_id * 8 + 5, kind, {SUBSCRIBED!r}[user_id % {len(SUBSCRIBED)} + 1], CASE WHEN kind IN ('ack', 'seek') AND event_id % 9 = 0 THEN 'c' || event_id END, NULL, NULL, NULL, NULL, CASE WHEN event_id % 97 = 0 AND kind <> 'subscribe' THEN '' ELSE 's' || (user_id % 40) END,
  greatest(0, event_id * 2 // 13 + k - 60), CASE WHEN k = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'earliest' ELSE 'latest' END END FROM sb),
md AS (SELECT *, coalesce(topic = '' OR sid = '', false) AS bad FROM cm),
fr AS (SELECT *, last_value(CASE WHEN kind = 'topic_policy' AND stop IS NULL THEN policy END IGNORE NULLS) OVER (ORDER BY ord) = 'create' AS creates
 FROM (SELECT *, CASE WHEN bad THEN 'malformed-command' WHEN command_id IS NOT NULL AND row_number() OVER (PARTITION BY command_id, bad ORDER BY ord) > 1 THEN 'duplicate-command' END AS stop FROM md)),
op AS (SELECT topic, min(ord) AS f FROM fr WHERE (kind = 'ensure_topic' OR (kind = 'publish' AND creates)) AND stop IS NULL GROUP BY 1), tp AS (SELECT topic, f, (SELECT min(ord) FROM fr c WHERE c.kind = 'close_topic' AND c.stop IS NULL AND c.topic = op.topic AND c.ord > f) AS t FROM op),
a AS (SELECT fr.*, CASE WHEN NOT coalesce(ord >= f, false) THEN 'unknown-topic' WHEN ord > t THEN 'closed-topic' END AS bad_topic FROM fr LEFT JOIN tp USING (topic) WHERE kind = 'publish'),
b AS (SELECT *, min(CASE WHEN stop IS NULL AND bad_topic IS NULL THEN ord END) OVER (PARTITION BY topic, ik) AS first FROM a),
s AS (SELECT *, CASE WHEN stop IS NOT NULL THEN stop WHEN ik IS NOT NULL AND first < ord THEN 'duplicate-command' WHEN bad_topic IS NOT NULL THEN bad_topic ELSE 'published' END AS status FROM b),
ms AS (SELECT topic, ord, payload, now_ms, row_number() OVER (PARTITION BY topic ORDER BY ord) AS seq FROM s WHERE status = 'published'),
kept AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq DESC) <= 500), hd AS (SELECT topic, min(seq) AS head_seq, max(seq) + 1 AS tail_seq FROM kept GROUP BY 1),
dl AS (SELECT ord, topic, status, row_number() OVER (ORDER BY ord) AS entry_seq FROM s WHERE status IN ('malformed-command', 'unknown-topic', 'closed-topic')),
ck AS (SELECT topic, ord, seq, max(now_ms) OVER (PARTITION BY topic ORDER BY ord) AS clock FROM ms),
hs AS (SELECT *, greatest(1, seq - {MOST - 1}, 1 + count(*) OVER (PARTITION BY topic ORDER BY clock RANGE BETWEEN UNBOUNDED PRECEDING AND {AGE + 1} PRECEDING)) AS head_seq FROM ck),
lg AS (SELECT *, head_seq - lag(head_seq, 1, 1) OVER (PARTITION BY topic ORDER BY seq) AS trimmed FROM hs)"""
#: Subscription commands against the topics of their time, one after another.
CURSORS = BUS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
sc AS (SELECT c.ord, c.topic, c.sid, c.kind, c.sseq, c.start, CASE WHEN f < c.ord THEN coalesce(lg.head_seq, 1) END AS head, CASE WHEN f < c.ord THEN coalesce(lg.seq + 1, 1) END AS tail, row_number() OVER (PARTITION BY c.topic, c.sid ORDER BY c.ord) AS rn,
 lead(c.ord) OVER (PARTITION BY c.topic, c.sid ORDER BY c.ord) AS upto FROM (SELECT * FROM fr WHERE stop IS NULL AND sid IS NOT NULL) c LEFT JOIN op ON op.topic = c.topic ASOF LEFT JOIN lg ON lg.topic = c.topic AND lg.ord < c.ord),
f AS (SELECT DISTINCT topic, sid, 0 AS rn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS upto, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS BIGINT) AS nx, false AS closed, false AS gap FROM sc
 UNION ALL SELECT topic, sid, rn, ord, upto, code, CASE WHEN code = 'subscribed' THEN want WHEN code = 'cursor-out-of-range' AND kind = 'subscribe' THEN head WHEN code = 'acked' THEN sseq + 1 WHEN code = 'sought' THEN sseq ELSE nx END,
  closed OR code = 'closed', gap AND code <> 'sought' FROM (SELECT *, CASE WHEN kind = 'subscribe' THEN CASE WHEN nx IS NOT NULL THEN 'kept' WHEN head IS NOT NULL AND (want < head OR want > tail) THEN 'cursor-out-of-range' ELSE 'subscribed' END
   WHEN head IS NULL THEN 'unknown-topic' WHEN nx IS NULL THEN 'unknown-subscription' WHEN kind = 'close_subscription' THEN 'closed' WHEN closed THEN 'subscription-closed'
   WHEN kind = 'ack' THEN CASE WHEN gap THEN 'retention-gap' WHEN sseq < nx THEN 'source-cursor-stale' WHEN sseq >= tail THEN 'cursor-out-of-range' ELSE 'acked' END
   WHEN sseq < head THEN 'retention-gap' WHEN sseq > tail THEN 'cursor-out-of-range' ELSE 'sought' END AS code
   FROM (SELECT sc.*, CASE start WHEN 'earliest' THEN coalesce(head, 1) WHEN 'latest' THEN coalesce(tail, 1) ELSE sseq END AS want, f.nx, f.closed, f.gap OR (NOT f.closed AND f.nx IS NOT NULL AND coalesce(greatest(f.nx, 1) < head, false)) AS gap
    FROM f JOIN sc ON sc.topic = f.topic AND sc.sid = f.sid AND sc.rn = f.rn + 1))),
gp AS (SELECT f.topic, sid, min(lg.ord) AS ord, nx, arg_min(head_seq, lg.ord) AS head FROM f JOIN lg ON lg.topic = f.topic AND lg.trimmed > 0 AND lg.ord > f.ord AND lg.ord < coalesce(upto, 1000000000000) AND lg.head_seq > greatest(nx, 1)
 WHERE nx IS NOT NULL AND NOT closed AND NOT gap AND f.rn > 0 GROUP BY f.topic, sid, f.rn, nx)
"""


def messages(spark, d):
    return bus.publish(commands(spark, d)).where("status = 'published'")


@job("m1_publish", f"{BUS} SELECT ord, status, CASE WHEN status = 'published' THEN row_number() OVER (PARTITION BY topic, status ORDER BY ord) END AS seq FROM s")
def m1(spark, d):
    return bus.publish(commands(spark, d)).select("ord", "status", "seq")


@job("m2_dead_letters", f"{BUS} SELECT ord, status, entry_seq FROM dl")
def m2(spark, d):
    return bus.dead_letters(bus.publish(commands(spark, d))).select("ord", "status", "entry_seq")


@job("m3_retention", f"{BUS}, w AS (SELECT *, arg_max(now_ms, seq) OVER (PARTITION BY topic) AS n0 FROM ms), ag AS (SELECT * FROM w WHERE now_ms >= n0 - 864000000) SELECT topic, seq FROM ag QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq DESC) <= 500")
def m3(spark, d):
    return bus.retained(messages(spark, d), 500, 864_000_000).select("topic", "seq")


@job("m3_heads", f"{BUS} SELECT * FROM hd")
def m3_heads(spark, d):
    m = messages(spark, d)
    return bus.heads(m, bus.retained(m, 500))


@job("m4_topic_page", f"{BUS}, p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) AS r, count(*) OVER (PARTITION BY topic) AS c FROM ms WHERE seq > 50) SELECT topic, seq, payload, c > 100 AS has_more, CASE WHEN c > 100 THEN max(seq) OVER (PARTITION BY topic) END AS next_after FROM p WHERE r <= 100")
def m4(spark, d):
    return bus.topic_page(messages(spark, d), 50).select("topic", "seq", "payload", "has_more", "next_after")


@job("m4_catalog_page", f"""{BUS}, ct AS (SELECT topic, t IS NOT NULL AS closed, coalesce(head_seq, 1) AS head_seq, coalesce(tail_seq, 1) AS next_seq, (SELECT count(*) FROM kept WHERE kept.topic = tp.topic) AS message_count FROM tp LEFT JOIN hd USING (topic))
SELECT *, (SELECT count(*) FROM ct) > 3 AS has_more FROM ct ORDER BY topic LIMIT 3""")
def m4_catalog(spark, d):
    c = commands(spark, d)
    m = bus.publish(c).where("status = 'published'")
    return bus.catalog_page(bus.catalog(c, m, bus.retained(m, 500)), limit=3, include_closed=True)


@job("m4_dead_letter_page", f"{BUS} SELECT ord, status, entry_seq, (SELECT count(*) FROM dl WHERE status = 'unknown-topic' AND entry_seq > 5) > 20 AS has_more FROM dl WHERE status = 'unknown-topic' AND entry_seq > 5 ORDER BY entry_seq LIMIT 20")
def m4_dead_letters(spark, d):
    letters = bus.dead_letters(bus.publish(commands(spark, d)))
    return bus.dead_letter_page(letters, 5, 20, code="unknown-topic").select("ord", "status", "entry_seq", "has_more")


def log_of(spark, d):
    return bus.timed(messages(spark, d), MOST, AGE)


@job("m3_trims", f"{BUS} SELECT topic, ord, seq, head_seq, trimmed AS trim_count FROM lg WHERE trimmed > 0")
def m3_trims(spark, d):
    """Trims by count and by age."""
    return bus.trims(log_of(spark, d))


AVAILABLE = f"""{BUS}, cu AS (SELECT event_type AS topic, 's' || user_id AS subscription_id, max(event_id) // 10 AS next_seq FROM e GROUP BY 1, 2)
SELECT subscription_id, topic, seq, payload FROM cu JOIN hd USING (topic) JOIN kept USING (topic) WHERE next_seq >= head_seq AND seq >= next_seq AND seq < next_seq + 5"""


@job("m6_available", AVAILABLE)
def m6(spark, d):
    """Subscriptions of all events."""
    m = messages(spark, d)
    kept = bus.retained(m, 500).select("topic", "seq", "payload")
    subscriptions = events(spark, d).groupBy(F.col("event_type").alias("topic"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("subscription_id"))
    return bus.available(subscriptions.agg((F.max("event_id") / 10).cast("long").alias("next_seq")), kept, bus.heads(m, kept), 5)


def subscribed(spark, d):
    """Facts and gaps of all subscriptions, on the topics that the same commands made."""
    c = commands(spark, d)
    known = bus.checked(c)
    log = stage(bus.timed(bus.publish(c, known=known).where("status = 'published'"), MOST, AGE), "topic-log")
    return bus.subscription_gaps(bus.as_of(c, log, known=known), log)


@job("m5_subscriptions", CURSORS + "SELECT ord, topic, sid AS subscription_id, code, nx AS next_seq, closed, gap AS retention_gap FROM f WHERE rn > 0")
def m5(spark, d):
    return subscribed(spark, d)[0]


@job("m5_cursors", CURSORS + "SELECT topic, sid AS subscription_id, nx AS next_seq, closed, gap AS retention_gap FROM f WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, sid ORDER BY rn DESC) = 1")
def m5_cursors(spark, d):
    return bus.cursors(subscribed(spark, d)[0])


@job("m5_retention_gaps", CURSORS + "SELECT topic, sid AS subscription_id, ord, nx AS next_seq, head AS head_seq FROM gp")
def m5_gaps(spark, d):
    return subscribed(spark, d)[1]


#: The same topics with room for all their messages.
KEPT = CURSORS.replace(f"seq - {MOST - 1}", "seq - 999999999").replace(f"{AGE + 1} PRECEDING", "900000000000000 PRECEDING")


@job("m6_available_to_all", KEPT + """, cu AS (SELECT topic, sid, nx FROM f WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic, sid ORDER BY rn DESC) = 1), ends AS (SELECT topic, max(head_seq) AS h FROM lg GROUP BY 1)
SELECT sid AS subscription_id, cu.topic, seq, payload FROM cu JOIN ends ON ends.topic = cu.topic JOIN ms ON ms.topic = cu.topic WHERE nx >= h AND seq >= nx AND seq < nx + 5""")
def m6_all(spark, d):
    """What each subscription finds at its cursor after all commands, in topics that keep their messages."""
    c = commands(spark, d)
    known = bus.checked(c)
    sent = stage(bus.publish(c, known=known).where("status = 'published'"), "published")
    log = stage(bus.timed(sent), "topic-log")
    ends = log.groupBy("topic").agg(F.max("head_seq").alias("head_seq"))
    left = sent.join(ends, "topic").where("seq >= head_seq").select("topic", "seq", "payload")
    return bus.available(bus.cursors(bus.subscription_gaps(bus.as_of(c, log, known=known), log)[0]).select("topic", "subscription_id", "next_seq"), left, ends, 5)


@job("m2_issues", CURSORS + """, al AS (SELECT ord, topic, NULL AS sid, status AS code FROM s UNION ALL SELECT ord, topic, NULL, stop FROM fr WHERE kind <> 'publish' AND stop IS NOT NULL
 UNION ALL SELECT ord, topic, NULL, 'unknown-topic' FROM fr LEFT JOIN op USING (topic) WHERE kind = 'close_topic' AND stop IS NULL AND coalesce(ord < f, true) UNION ALL SELECT ord, topic, sid, code FROM f WHERE rn > 0 UNION ALL SELECT ord, NULL, sid, 'retention-gap' FROM gp)
SELECT ord, topic, sid AS subscription_id, code, row_number() OVER (ORDER BY ord, sid NULLS FIRST) AS entry_seq FROM al WHERE code NOT IN ('published', 'duplicate-command', 'subscribed', 'kept', 'acked', 'sought', 'closed')""")
def m2_issues(spark, d):
    """Every dead letter, of publishes, topics and subscriptions, in one order."""
    c = commands(spark, d)
    known = bus.checked(c)
    published = stage(bus.publish(c, known=known), "published")
    log = stage(bus.timed(published.where("status = 'published'"), MOST, AGE), "topic-log")
    return bus.issues(c, published, *bus.subscription_gaps(bus.as_of(c, log, known=known), log), known=known)


@job("s8_to_topic", f"""{E}, c AS (SELECT event_id * 2 AS ord, CASE WHEN event_type = 'purchase' THEN 'sales' ELSE 'doubts' END AS topic, cents AS payload FROM e WHERE event_type IN ('purchase', 'error')), o AS (SELECT min(event_id) * 2 + 1 AS f FROM e)
SELECT ord, topic, payload, CASE WHEN topic = 'sales' AND ord > f THEN 'published' ELSE 'unknown-topic' END AS status, CASE WHEN topic = 'sales' AND ord > f THEN row_number() OVER (PARTITION BY topic, ord > f ORDER BY ord) END AS seq FROM c, o""")
def s8_to_topic(spark, d):
    """Two sources feed a topic each; one topic is there from the first event on, the other never."""
    e = events(spark, d).withColumn("ord", F.col("event_id") * 2)
    ensure = e.agg((F.min("ord") + 1).alias("ord")).select("ord", F.lit("ensure_topic").alias("kind"), F.lit("sales").alias("topic"))
    sales, doubts = (bus.to_topic(e.where(F.col("event_type") == kind), topic, "cents", "ord", "ms") for kind, topic in (("purchase", "sales"), ("error", "doubts")))
    return bus.publish(sales.union(doubts).unionByName(ensure, allowMissingColumns=True)).select("ord", "topic", "payload", "status", "seq")


@job("m7_event_message", f"""{E} SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 31 = 0 THEN NULL ELSE 'e' || event_id END AS id, CASE WHEN event_id % 29 <> 0 THEN event_type END AS type, '{{"cents":' || cents || '}}' AS payload,
 'u' || user_id AS subject_id, ms AS occurred_at_ms, CASE WHEN event_id % 29 = 0 THEN 'eventMessage.type must be non-empty' WHEN event_id % 13 = 0 OR event_id % 31 = 0 THEN 'eventMessage.id must be non-empty' END AS error FROM e""")
def m7(spark, d):
    """Every event as a message; those without a type or an id are error rows."""
    e, n = events(spark, d), F.col("event_id")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    id_ = F.when(n % 13 == 0, "").when(n % 31 != 0, text("e", "event_id"))
    return bus.event_message(e, id_, F.when(n % 29 != 0, F.col("event_type")), ids.canonical_json(cents=F.col("cents")), subject_id=text("u", "user_id"), occurred_at_ms=F.col("ms")).select("event_id", "id", "type", "payload", "subject_id", "occurred_at_ms", "error")


@job("m8_validate_payloads", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AS valid, CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) NOT IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) THEN '$.k' END AS path FROM events""")
def m8(spark, d):
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"$ref": "#/definitions/fib"}}, "definitions": {"fib": {"type": "integer", "enum": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]}}}
    return bus.validate_payloads(read(spark, d, "events").select("event_id", "props"), "props", schema).select("event_id", "valid", "path")


@job("c6_compacted_state", f"""{MAP}, p AS (SELECT collection, (max(seq) + 1) // 25 * 25 - 1 AS cursor FROM c GROUP BY 1), q AS (SELECT c.* FROM c JOIN p USING (collection) WHERE seq <= cursor),
cl AS (SELECT collection, max(seq) FILTER (kind = 'clear') AS cut FROM q GROUP BY 1), r AS (SELECT q.* FROM q JOIN cl USING (collection) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut))
SELECT collection, k, v FROM r QUALIFY row_number() OVER (PARTITION BY collection, k ORDER BY seq DESC) = 1 AND kind = 'set'""")
def c6(spark, d):
    return collections.compacted(map_changes(spark, d), 25)[0]


@job("c6_frames_after_snapshot", f"{MAP}, p AS (SELECT collection, (max(seq) + 1) // 25 * 25 - 1 AS cursor FROM c GROUP BY 1) SELECT collection, seq, kind FROM c JOIN p USING (collection) WHERE seq > cursor")
def c6_frames(spark, d):
    return collections.compacted(map_changes(spark, d), 25)[1].select("collection", "seq", "kind")


AT_POINTS = "p AS (SELECT collection, unnest(range(1, (max(seq) + 1) // 10 + 1)) * 10 - 1 AS cursor FROM {rows} GROUP BY 1)"


@job("c6_map_points", f"""{MAP}, {AT_POINTS.format(rows="c")}, q AS (SELECT c.*, cursor FROM c JOIN p USING (collection) WHERE seq <= cursor), t AS (SELECT collection, cursor, max(seq) FILTER (kind = 'clear') AS cut FROM q GROUP BY 1, 2)
SELECT collection, cursor, k, v FROM (SELECT q.* FROM q JOIN t USING (collection, cursor) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut)) QUALIFY row_number() OVER (PARTITION BY collection, cursor, k ORDER BY seq DESC) = 1 AND kind = 'set'""")
def c6_map_points(spark, d):
    """All maps after every ten changes."""
    return chains.map_chain(map_changes(spark, d), 10)


INDEX_ROWS = f"""{MAP}, ix AS (SELECT c.collection, c.seq, CASE WHEN c.kind = 'clear' THEN 'clear' WHEN c.kind = 'delete' AND n.cents % 2 = 0 THEN 'deleteMany' WHEN c.kind = 'delete' THEN 'delete' ELSE 'upsert' END AS kind, n.k % 20 AS p, n.event_type AS secondary, n.cents AS value FROM c JOIN n USING (collection, seq))"""


@job("c6_index_points", f"""{INDEX_ROWS}, {AT_POINTS.format(rows="ix")}, q AS (SELECT ix.collection, cursor, seq, kind, unnest(CASE WHEN kind = 'deleteMany' THEN [ix.p, (ix.p + 1) % 20] ELSE [ix.p] END) AS k, secondary, value FROM ix JOIN p USING (collection) WHERE seq <= cursor),
t AS (SELECT collection, cursor, max(seq) FILTER (kind = 'clear') AS cut FROM q GROUP BY 1, 2)
SELECT collection, cursor, k AS primary, secondary, value FROM (SELECT q.* FROM q JOIN t USING (collection, cursor) WHERE kind <> 'clear' AND (cut IS NULL OR seq > cut)) QUALIFY row_number() OVER (PARTITION BY collection, cursor, k ORDER BY seq DESC) = 1 AND kind = 'upsert'""")
def c6_index_points(spark, d):
    return chains.index_chain(index_changes(spark, d), 10)


@job("c6_log_points", LOG.replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT collection, 0::BIGINT AS done, CAST([] AS BIGINT[]) AS xs FROM c WHERE seq = 0 UNION ALL SELECT c.collection, c.seq + 1, CASE kind WHEN 'clear' THEN [] WHEN 'append' THEN list_append(xs, cents) WHEN 'appendMany' THEN list_concat(xs, [cents, cents + 1]) ELSE list_slice(xs, trim + 1, len(xs)) END FROM g JOIN c ON c.collection = g.collection AND c.seq = g.done)
SELECT collection, done - 1 AS cursor, CAST(i - 1 AS BIGINT) AS position, xs[i] AS value FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM g WHERE done > 0 AND done % 10 = 0)""")
def c6_log_points(spark, d):
    return chains.log_chain(log_changes(spark, d), 10)


@job("c6_list_points", f"{LIST} SELECT collection, seq AS cursor, CAST(i - 1 AS BIGINT) AS position, xs[i] AS value FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM f WHERE (seq + 1) % 10 = 0 AND error IS NULL)")
def c6_list_points(spark, d):
    return chains.list_chain(list_changes(spark, d), 10)


@job("s9_observe_log", f"""{E} SELECT event_id, 'app/' || event_type || '/' || user_id AS path, row_number() OVER (ORDER BY ms, event_id) AS seq FROM e WHERE event_type LIKE 's%'""")
def s9(spark, d):
    e = events(spark, d)
    path = F.concat(F.lit("app/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    return collections.observed(e, path, "app/s", ORDER, F.floor(F.col("ms") / 3_600_000)).select("event_id", "path", "seq")
