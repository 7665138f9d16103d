"""Jobs over the event stream: filters, limits, folds, joins and time operators, per user."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import stage
from ..operators import basic, joins, timeops
from ..sources import values
from ..sources.tables import EVENTS_SQL, HOUR, KEY, ORDER, events
from .registry import job

E = f"WITH {EVENTS_SQL}"
W = "(PARTITION BY user_id ORDER BY ms, event_id)"


def of(kind: str):
    return F.col("event_type") == kind


@job("p1_map", f"{E} SELECT event_id, cents * 2 + k AS score, upper(event_type) AS kind FROM e")
def p1(spark, d):
    return basic.map_rows(events(spark, d), score=F.col("cents") * 2 + F.col("k"), kind=F.upper("event_type")).select("event_id", "score", "kind")


@job("p2_filter", f"{E} SELECT event_id, cents FROM e WHERE event_type = 'click' AND cents > 5000")
def p2(spark, d):
    return basic.keep(events(spark, d), of("click") & (F.col("cents") > 5000)).select("event_id", "cents")


@job("p4_distinct_until_changed", f"""{E} SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER {W} AS p, row_number() OVER {W} AS rn FROM e)
WHERE rn = 1 OR p IS DISTINCT FROM event_type""")
def p4(spark, d):
    return basic.distinct_until_changed(events(spark, d), "event_type", ORDER, KEY).select("event_id", "event_type")


@job("p4_distinct_until_moved", f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER {W} AS rn FROM e),
f AS (SELECT user_id, event_id, rn, cents AS kept, true AS stay FROM n WHERE rn = 1 UNION ALL
 SELECT n.user_id, n.event_id, n.rn, CASE WHEN abs(n.cents - f.kept) <= 2000 THEN f.kept ELSE n.cents END, abs(n.cents - f.kept) > 2000
 FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, kept AS cents FROM f WHERE stay""")
def p4_moved(spark, d):
    return basic.distinct_until_moved(events(spark, d), "cents", 2000, ORDER, KEY).select("event_id", "cents")


@job("p5_stratify", f"""{E} SELECT event_id, 'large' AS branch FROM e WHERE cents > 8000 UNION ALL SELECT event_id, 'paid' FROM e WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'even' FROM e WHERE k % 2 = 0""")
def p5(spark, d):
    return basic.stratify(events(spark, d), {"large": F.col("cents") > 8000, "paid": of("purchase"), "even": F.col("k") % 2 == 0}).select("event_id", "branch")


@job("p6_pipe", f"""{E}, c AS (SELECT * FROM e WHERE event_type <> 'error'),
x AS (SELECT *, lag(event_type) OVER {W} AS p, row_number() OVER {W} AS rn FROM c)
SELECT user_id, event_id, CAST(sum(cents) OVER {W} AS BIGINT) AS running FROM x WHERE rn = 1 OR p IS DISTINCT FROM event_type""")
def p6(spark, d):
    return basic.pipe(
        events(spark, d),
        lambda df: basic.keep(df, ~of("error")),
        lambda df: basic.distinct_until_changed(df, "event_type", ORDER, KEY),
        lambda df: basic.scan(df, ORDER, KEY, running=F.sum("cents")),
    ).select("user_id", "event_id", "running")


@job("p7_valve", f"""{E}, u AS (SELECT user_id, ms, max(CASE WHEN event_type = 'click' THEN cents END) AS x,
 max(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 0 END) AS o FROM e GROUP BY ALL),
s AS (SELECT *, last_value(o IGNORE NULLS) OVER w AS st, last_value(x IGNORE NULLS) OVER w AS h FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ms))
SELECT user_id, ms, CASE WHEN st = 1 AND x IS NOT NULL THEN x WHEN o = 1 THEN h END AS cents FROM s
WHERE CASE WHEN st = 1 AND x IS NOT NULL THEN x WHEN o = 1 THEN h END IS NOT NULL""")
def p7(spark, d):
    e = events(spark, d)
    control = e.where(of("signup") | of("error")).withColumn("open", of("signup")).select("user_id", "ms", "open")
    return joins.valve(e.where(of("click")).select("user_id", "ms", "cents"), control, "cents", ["ms"], KEY)


@job("p8_rescue", f"""{E}, x AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER {W} AS n FROM e)
SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE cents END AS cents FROM x WHERE n = 0 OR (n = 1 AND event_type = 'error')""")
def p8(spark, d):
    e = events(spark, d).withColumn("error", F.when(of("error"), F.lit("failed")))
    return basic.rescue(e, "error", {"cents": F.lit(-1)}, ORDER, KEY).select("event_id", F.col("cents").cast("long").alias("cents"))


@job("l1_take", f"{E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER {W} <= 3")
def l1(spark, d):
    return basic.take(events(spark, d), 3, ORDER, KEY).select("user_id", "event_id")


@job("l1_take_all", f"{E} SELECT event_id FROM e ORDER BY ms, event_id LIMIT 25")
def l1_all(spark, d):
    return basic.take(events(spark, d), 25, ORDER).select("event_id")


@job("l2_skip", f"{E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER {W} > 5")
def l2(spark, d):
    return basic.skip(events(spark, d), 5, ORDER, KEY).select("user_id", "event_id")


@job("l2_skip_all", f"{E} SELECT event_id, row_number() OVER (ORDER BY ms, event_id) AS rn FROM e QUALIFY rn > 100")
def l2_all(spark, d):
    from ..functions.order import number

    return number(events(spark, d), ORDER, bucket=F.floor(F.col("ms") / HOUR)).where("rn > 100").select("event_id", "rn")


@job("l3_take_while", f"{E} SELECT user_id, event_id FROM e QUALIFY max(CASE WHEN cents < 15000 THEN 0 ELSE 1 END) OVER {W} = 0")
def l3(spark, d):
    return basic.take_while(events(spark, d), F.col("cents") < 15000, ORDER, KEY).select("user_id", "event_id")


@job("l3_take_while_all", f"""{E}, c AS (SELECT min((ms, event_id)) AS cut FROM e WHERE cents >= 25000)
SELECT event_id FROM e, c WHERE cut IS NULL OR (ms, event_id) < cut""")
def l3_all(spark, d):
    return basic.take_while(events(spark, d), F.col("cents") < 25000, ORDER).select("event_id")


@job("l4_first", f"{E} SELECT user_id, event_id, cents FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER {W} = 1")
def l4(spark, d):
    return basic.first(events(spark, d), ORDER, KEY, of("purchase")).select("user_id", "event_id", "cents")


@job("l5_last", f"{E} SELECT user_id, event_id, cents FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) = 1")
def l5(spark, d):
    return basic.last(events(spark, d), ORDER, KEY).select("user_id", "event_id", "cents")


@job("l6_element_at", f"{E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER {W} = 8")
def l6(spark, d):
    return basic.element_at(events(spark, d), 7, ORDER, KEY).select("user_id", "event_id")


@job("l7_single_value", f"{E} SELECT user_id, k, count(*) AS n, min(CASE WHEN event_type = 'signup' THEN cents END) AS first_value FROM e GROUP BY user_id, k HAVING count(*) FILTER (event_type = 'signup') = 1")
def l7(spark, d):
    e = events(spark, d)
    counted = e.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.count_if(of("signup")).alias("m"), F.min(F.when(of("signup"), F.col("cents"))).alias("first_value"))
    return counted.where("m = 1").drop("m")


@job("l8_settle", f"""{E}, x AS (SELECT *, row_number() OVER {W} AS rn, CASE WHEN row_number() OVER {W} = 1 OR lag(event_type) OVER {W} IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS ch FROM e),
y AS (SELECT *, sum(ch) OVER {W} AS isl FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ms, event_id) - 1 AS still FROM y),
c AS (SELECT user_id, min(rn) AS cut FROM z WHERE still >= 2 OR rn >= 20 GROUP BY 1)
SELECT user_id, event_id FROM z LEFT JOIN c USING (user_id) WHERE cut IS NULL OR rn <= cut""")
def l8(spark, d):
    return basic.settle(events(spark, d), "event_type", 2, 20, ORDER, KEY).select("user_id", "event_id")


@job("f1_scan", f"{E} SELECT event_id, CAST(sum(cents) OVER {W} + 100 AS BIGINT) AS total, max(cents) OVER {W} AS high, count(*) OVER {W} AS n FROM e")
def f1(spark, d):
    out = basic.scan(events(spark, d), ORDER, KEY, total=F.sum("cents"), high=F.max("cents"), n=F.count("*"))
    return out.select("event_id", (F.col("total") + 100).alias("total"), "high", "n")


@job("f1_scan_with", f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER {W} AS rn FROM e),
f AS (SELECT user_id, event_id, rn, CAST((7 * 31 + cents) % 1000003 AS BIGINT) AS acc FROM n WHERE rn = 1 UNION ALL
 SELECT n.user_id, n.event_id, n.rn, (f.acc * 31 + n.cents) % 1000003 FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)
SELECT event_id, acc FROM f""")
def f1_with(spark, d):
    return basic.scan_with(events(spark, d), lambda a, x: (a * 31 + x) % 1000003, 7, "cents", "acc", T.LongType(), ORDER, KEY).select("event_id", "acc")


@job("f2_reduce", f"{E} SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN cents END), 0) AS BIGINT) AS paid, max(k) AS top FROM e GROUP BY user_id")
def f2(spark, d):
    return basic.reduce(events(spark, d), KEY, paid=(F.sum(F.when(of("purchase"), F.col("cents"))), 0), top=(F.max("k"), -1))


@job("f2_reduce_in_order", f"""{E} SELECT user_id, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list(cents ORDER BY ms, event_id)), lambda a, x : (a * 31 + x) % 1000003) AS BIGINT) AS acc FROM e GROUP BY user_id""")
def f2_order(spark, d):
    return basic.reduce_in_order(events(spark, d), "cents", F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003, ORDER, KEY, "acc")


@job("f3_pairwise", f"{E} SELECT event_id, lag(cents) OVER {W} AS previous, cents AS current FROM e QUALIFY row_number() OVER {W} > 1")
def f3(spark, d):
    return basic.pairwise(events(spark, d), "cents", ORDER, KEY).select("event_id", "previous", "current")


@job("f4_buffer_count", f"""{E}, n AS (SELECT *, (row_number() OVER {W} - 1) // 4 AS chunk FROM e)
SELECT user_id, chunk, string_agg(event_id, ',' ORDER BY ms, event_id) AS items FROM n GROUP BY 1, 2""")
def f4(spark, d):
    return basic.buffer_count(events(spark, d), 4, "event_id", ORDER, KEY).withColumn("items", F.array_join("items", ","))


@job("f5_buffer", f"""{E}, u AS (SELECT user_id, ms, event_id, 0 AS side FROM e WHERE event_type <> 'purchase' UNION ALL SELECT user_id, ms, event_id, 1 FROM e WHERE event_type = 'purchase'),
x AS (SELECT *, coalesce(sum(side) OVER (PARTITION BY user_id ORDER BY ms, event_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS flush FROM u)
SELECT user_id, CAST(flush AS BIGINT) AS flush, coalesce(string_agg(CASE WHEN side = 0 THEN event_id END, ',' ORDER BY ms, event_id), '') AS items FROM x GROUP BY user_id, flush
HAVING max(side) = 1 OR count(*) FILTER (side = 0) > 0""")
def f5(spark, d):
    e = events(spark, d)
    src = e.where(~of("purchase")).select("user_id", "ms", "event_id", F.col("event_id").alias("x"))
    out = joins.buffer(src, e.where(of("purchase")), "x", ORDER, KEY)
    return out.select("user_id", F.col("flush").cast("long").alias("flush"), F.array_join("items", ",").alias("items"))


@job("f6_buffer_time", f"""{E}, s AS (SELECT user_id, min(ms) AS a, max(ms) AS b FROM e GROUP BY 1), g AS (SELECT user_id, a, unnest(range(0, (b - a) // {24 * HOUR} + 1)) AS slot FROM s),
f AS (SELECT e.user_id, (ms - a) // {24 * HOUR} AS slot, string_agg(event_id, ',' ORDER BY ms, event_id) AS items FROM e JOIN s USING (user_id) GROUP BY 1, 2)
SELECT g.user_id, CAST(g.slot AS BIGINT) AS slot, coalesce(items, '') AS items FROM g LEFT JOIN f USING (user_id, slot)""")
def f6(spark, d):
    return timeops.buffer_time(events(spark, d), "ms", 24 * HOUR, "event_id", ORDER, KEY).select("user_id", F.col("slot").cast("long").alias("slot"), F.array_join("items", ",").alias("items"))


@job("f7_sample", f"""{E} SELECT n.event_id, s.cents FROM (SELECT * FROM e WHERE event_type = 'view') n ASOF JOIN (SELECT * FROM e WHERE event_type = 'click') s
ON n.user_id = s.user_id AND n.ms >= s.ms""")
def f7(spark, d):
    e = events(spark, d)
    hits = e.where(of("view")).select("user_id", "ms", "event_id")
    return joins.sample(e.where(of("click")).select("user_id", "ms", "event_id", "cents"), hits, "cents", ORDER, KEY).select("event_id", "cents")


@job("f8_scan_log", f"""{E}, c AS (SELECT user_id, max((ms, event_id)) FILTER (event_type = 'error') AS cut FROM e GROUP BY 1),
r AS (SELECT e.* FROM e JOIN c USING (user_id) WHERE cut IS NULL OR (ms, event_id) > cut)
SELECT event_id, CAST(sum(cents) OVER {W} AS BIGINT) AS total FROM r""")
def f8(spark, d):
    kept = basic.retained(events(spark, d), "event_type", ["error"], ORDER, KEY)
    return basic.scan(kept, ORDER, KEY, total=F.sum("cents")).select("event_id", "total")


@job("j1_merge", f"{E} SELECT event_id, 0 AS source FROM e WHERE event_type = 'click' UNION ALL SELECT event_id, 1 FROM e WHERE event_type = 'view'")
def j1(spark, d):
    e = events(spark, d)
    return joins.merge(e.where(of("click")), e.where(of("view"))).select("event_id", "source")


@job("j2_concat", f"{E} SELECT event_id, 0 AS phase FROM e WHERE event_type = 'view' UNION ALL SELECT event_id, 1 FROM e WHERE event_type = 'click'")
def j2(spark, d):
    e = events(spark, d)
    return joins.concat(e.where(of("view")), e.where(of("click"))).select("event_id", "phase")


@job("j3_zip", f"""{E}, a AS (SELECT user_id, cents, row_number() OVER {W} AS rn FROM e WHERE event_type = 'click'), b AS (SELECT user_id, cents, row_number() OVER {W} AS rn FROM e WHERE event_type = 'view')
SELECT user_id, rn, a.cents AS left_cents, b.cents AS right_cents FROM a JOIN b USING (user_id, rn)""")
def j3(spark, d):
    e = events(spark, d)
    a = e.where(of("click")).withColumnRenamed("cents", "left_cents").drop("k")
    b = e.where(of("view")).select("user_id", F.col("ms").alias("ms2"), F.col("event_id").alias("id2"), F.col("cents").alias("right_cents"))
    return joins.zip_rows(a, b, (ORDER, ["ms2", "id2"]), KEY).select("user_id", F.col("rn").cast("long").alias("rn"), "left_cents", "right_cents")


@job("j3_zip_all", f"""{E}, a AS (SELECT event_id AS l, row_number() OVER (ORDER BY ms, event_id) AS rn FROM e WHERE event_type = 'click'), b AS (SELECT event_id AS r, row_number() OVER (ORDER BY ms, event_id) AS rn FROM e WHERE event_type = 'view')
SELECT rn, l, r FROM a JOIN b USING (rn)""")
def j3_all(spark, d):
    e = events(spark, d).select("ms", "event_id", "event_type")
    a, b = e.where(of("click")).select("ms", "event_id", F.col("event_id").alias("l")), e.where(of("view")).select(F.col("ms").alias("ms2"), F.col("event_id").alias("r"))
    hour = (F.floor(F.col("ms") / HOUR), F.floor(F.col("ms2") / HOUR))
    return joins.zip_rows(a, b, (ORDER, ["ms2", "r"]), [], hour).select("rn", "l", "r")


@job("j4_combine_latest", f"""{E}, u AS (SELECT user_id, ms, max(CASE WHEN event_type = 'click' THEN cents END) AS a, max(CASE WHEN event_type = 'view' THEN cents END) AS b FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
l AS (SELECT user_id, ms, last_value(a IGNORE NULLS) OVER w AS click, last_value(b IGNORE NULLS) OVER w AS view FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ms))
SELECT * FROM l WHERE click IS NOT NULL AND view IS NOT NULL""")
def j4(spark, d):
    e = events(spark, d).select("user_id", "ms", "cents", "event_type")
    return joins.combine_latest({k: e.where(of(k)) for k in ("click", "view")}, "cents", ["ms"], KEY)


@job("j5_with_latest_from", f"""{E}, p AS (SELECT * FROM e WHERE event_type = 'click'), s AS (SELECT * FROM e WHERE event_type = 'view'), f AS (SELECT user_id, arg_min(cents, (ms, event_id)) AS c0 FROM s GROUP BY 1)
SELECT p.event_id, p.cents, coalesce(s.cents, f.c0) AS other FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ms >= s.ms JOIN f ON p.user_id = f.user_id""")
def j5(spark, d):
    e = events(spark, d).select("user_id", "ms", "event_id", "cents", "event_type")
    return joins.with_latest_from(e.where(of("click")), e.where(of("view")), "cents", ["ms", "event_id"], KEY).select("event_id", "cents", "other")


@job("j6_race", f"""{E}, f AS (SELECT user_id, arg_min(event_type, (ms, event_id)) AS w FROM e WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1)
SELECT event_id, event_type FROM e JOIN f USING (user_id) WHERE event_type = w""")
def j6(spark, d):
    e = events(spark, d)
    return joins.race([e.where(of(k)) for k in ("click", "view", "signup")], ORDER, KEY).select("event_id", "event_type")


@job("j7_take_until", f"""{E}, c AS (SELECT user_id, min((ms, event_id)) AS cut FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id FROM e LEFT JOIN c USING (user_id) WHERE event_type <> 'purchase' AND (cut IS NULL OR (ms, event_id) < cut)""")
def j7(spark, d):
    e = events(spark, d)
    return joins.take_until(e.where(~of("purchase")), e.where(of("purchase")), ORDER, KEY).select("event_id")


@job("j8_switch_map", f"""{E} SELECT i.event_id, o.event_id AS outer_id FROM (SELECT * FROM e WHERE event_type = 'click') i ASOF JOIN (SELECT * FROM e WHERE event_type = 'signup') o ON i.user_id = o.user_id AND i.ms >= o.ms""")
def j8(spark, d):
    e = events(spark, d).select("user_id", "ms", "event_id", "event_type")
    return joins.switch_map(e.where(of("signup")), e.where(of("click")), "event_id", ["ms"], KEY).select("event_id", "outer_id")


@job("j9_merge_map", f"{E} SELECT event_id, CAST(i AS INTEGER) AS inner_pos, cents + i AS item FROM (SELECT *, unnest(range(0, k % 4)) AS i FROM e)")
def j9(spark, d):
    items = F.when(F.col("k") % 4 > 0, F.transform(F.sequence(F.lit(0), F.col("k") % 4 - 1), lambda i: F.col("cents") + i))
    return joins.merge_map(events(spark, d), items, concurrent=4).select("event_id", "inner_pos", "item")


@job("j10_concat_map", f"""{E}, o AS (SELECT *, row_number() OVER {W} AS orn FROM e WHERE event_type = 'signup')
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY orn, i) AS BIGINT) AS pos, cents * 10 + i AS item FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS i FROM o)""")
def j10(spark, d):
    from ..functions.order import number

    items = F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: F.col("cents") * 10 + i)
    out = joins.merge_map(events(spark, d).where(of("signup")), items)
    return number(out, [*ORDER, "inner_pos"], KEY, name="pos").select("user_id", F.col("pos").cast("long").alias("pos"), "item")


@job("j11_exhaust_map", f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT user_id, event_id, ms AS s, ms + cents * 2000 AS t, row_number() OVER {W} AS rn FROM e WHERE event_type = 'signup'),
f AS (SELECT user_id, event_id, rn, t AS free, true AS kept FROM o WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.s >= f.free THEN o.t ELSE f.free END, o.s >= f.free FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT event_id FROM f WHERE kept""")
def j11(spark, d):
    outer = events(spark, d).where(of("signup")).withColumn("until", F.col("ms") + F.col("cents") * 2000)
    return joins.exhaust_map(outer, "ms", "until", ORDER, KEY).select("event_id")


@job("j12_repeat", f"{E} SELECT event_id, CAST(round AS INTEGER) AS round FROM e, range(0, 3) r(round) WHERE event_type = 'purchase'")
def j12(spark, d):
    return joins.repeat(events(spark, d).where(of("purchase")), 3).select("event_id", "round")


@job("j13_merge_logs", f"{E} SELECT k % 3 AS source, event_id, cents FROM e")
def j13(spark, d):
    e = events(spark, d)
    return joins.merge(*[e.where(F.col("k") % 3 == i) for i in range(3)]).select("source", "event_id", "cents")


@job("t1_delay", f"{E} SELECT event_id, ms + 5000 AS ms FROM e")
def t1(spark, d):
    return timeops.delay(events(spark, d), "ms", 5000).select("event_id", "ms")


@job("t2_debounce", f"{E}, n AS (SELECT *, lead(ms) OVER {W} AS nx FROM e) SELECT event_id, ms + {6 * HOUR} AS emit_at FROM n WHERE nx IS NULL OR nx - ms >= {6 * HOUR}")
def t2(spark, d):
    return timeops.debounce(events(spark, d), "ms", 6 * HOUR, ORDER, KEY).select("event_id", "emit_at")


GREEDY = f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER {W} AS rn FROM e),
f AS (SELECT user_id, event_id, ms, rn, ms AS w FROM n WHERE rn = 1 UNION ALL
 SELECT n.user_id, n.event_id, n.ms, n.rn, CASE WHEN n.ms - f.w >= {12 * HOUR} THEN n.ms ELSE f.w END FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1)"""


@job("t3_throttle", f"{GREEDY} SELECT event_id FROM f WHERE w = ms")
def t3(spark, d):
    return timeops.throttle(events(spark, d), "ms", 12 * HOUR, ORDER, KEY).select("event_id")


@job("t4_audit", f"{GREEDY} SELECT arg_max(event_id, rn) AS event_id, w + {12 * HOUR} AS emit_at FROM f GROUP BY user_id, w")
def t4(spark, d):
    return timeops.audit(events(spark, d), "ms", 12 * HOUR, ORDER, KEY).select("event_id", "emit_at")


@job("t5_timeout", f"""{E}, x AS (SELECT *, lag(ms) OVER {W} AS b FROM e), y AS (SELECT *, sum(CASE WHEN ms - b >= {36 * HOUR} THEN 1 ELSE 0 END) OVER {W} AS n FROM x)
SELECT user_id, event_id, ms, NULL AS error FROM y WHERE n = 0 UNION ALL
SELECT user_id, NULL, b + {36 * HOUR}, 'timeout: no value within {36 * HOUR}ms' FROM y WHERE n = 1 AND ms - b >= {36 * HOUR}""")
def t5(spark, d):
    return timeops.timeout(events(spark, d).select("user_id", "event_id", "ms"), "ms", 36 * HOUR, ORDER, KEY).select("user_id", "event_id", "ms", "error")


@job("t6_rate_limit", f"""{GREEDY}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY rn) AS nth FROM f)
SELECT event_id, nth <= 2 AS allowed, greatest(0, 2 - nth) AS remaining, w + {12 * HOUR} AS reset_at,
 CAST(sum(CASE WHEN nth > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS BIGINT) AS dropped FROM g""")
def t6(spark, d):
    out = timeops.rate_limit(events(spark, d), "ms", 2, 12 * HOUR, ORDER, KEY)
    return out.select("event_id", "allowed", F.col("remaining").cast("long").alias("remaining"), "reset_at", "dropped")


@job("s3_interval", f"{E}, s AS (SELECT user_id, min(ms) AS a, max(ms) AS b FROM e GROUP BY 1) SELECT user_id, CAST(i AS INTEGER) AS tick, a + (i + 1) * {24 * HOUR} AS tick_at FROM (SELECT *, unnest(range(0, (b - a) // {24 * HOUR})) AS i FROM s)")
def s3(spark, d):
    spans = events(spark, d).groupBy("user_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    return timeops.interval(spans, "a", "b", 24 * HOUR).select("user_id", F.col("tick").alias("tick"), "tick_at")


@job("p3_tap", f"{E} SELECT event_id, cents FROM e")
def p3(spark, d):
    rows, _ = basic.tap(events(spark, d), "rows", F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"))
    rows, _ = basic.tap_first(rows, "first purchase", ORDER, of("purchase"))
    return rows.select("event_id", "cents")


@job("p3_tap_seen", f"{E} SELECT count(*) AS rows, CAST(sum(cents) AS BIGINT) AS cents, arg_min(event_id, (ms, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase FROM e")
def p3_seen(spark, d):
    """What the taps saw once the rows were written: metrics of all rows, and the first purchase."""
    rows, seen = basic.tap(events(spark, d), "all rows", F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"))
    rows, first = basic.tap_first(rows, "first of all", ORDER, of("purchase"))
    stage(rows, "tapped")
    found = first.get["first"]
    return spark.createDataFrame([(seen.get["rows"], seen.get["cents"], found and found["event_id"])], "rows long, cents long, first_purchase long")


@job("s1_values_then_events", f"{E} SELECT 0 AS phase, unnest([7, 3, 5]) AS value UNION ALL SELECT 2, event_id FROM e WHERE event_type = 'signup'")
def s1(spark, d):
    """Literal values first, an empty source that adds nothing, then the signups."""
    first = values.of(spark, [7, 3, 5], "long").select("value")
    return joins.concat(first, values.empty(spark, "value long"), events(spark, d).where(of("signup")).select(F.col("event_id").alias("value"))).select("phase", "value")


@job("s2_empty_and_events", f"{E} SELECT event_id, 1 AS source FROM e")
def s2(spark, d):
    e = events(spark, d).select("event_id")
    return joins.merge(values.empty(spark, "event_id long"), e).select("event_id", "source")
