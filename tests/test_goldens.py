"""Small sequences with known results."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone.functions import ids
from rillstone.functions.order import number
from rillstone.operators import basic, bus, collections, cron, graphs, joins, memory, queue, resilience, timeops
from rillstone.sources import values

K, O = ["key"], ["seq"]


@pytest.fixture
def seq(spark):
    def make(*xs, at=None):
        rows = [("a", i if at is None else at[i], x) for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, "key string, seq long, value long")

    return make


def vals(df, col="value", order="seq"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_folds(seq):
    assert basic.reduce(seq(1, 1, 2, 3), K, s=(F.sum("value"), 0)).first()["s"] == 7
    assert [(r.previous, r.current) for r in basic.pairwise(seq(1, 2, 3), "value", O, K).orderBy("seq").collect()] == [(1, 2), (2, 3)]
    assert [r["items"] for r in basic.buffer_count(seq(1, 2, 3), 2, "value", O, K).orderBy("chunk").collect()] == [[1, 2], [3]]
    with pytest.raises(ValueError):
        basic.buffer_count(seq(1), 0, "value", O, K)


def test_limits(seq):
    assert vals(basic.take_while(basic.skip(seq(1, 2, 3, 4, 5), 1, O, K), F.col("value") < 4, O, K)) == [2, 3]
    assert vals(basic.first(seq(9, 8, 7), O, K)) == [9]
    assert vals(basic.first(seq(1, 2, 3), O, K, F.col("value") == 2)) == [2]
    assert vals(basic.element_at(seq(4, 5, 6), 1, O, K)) == [5]
    assert vals(basic.last(seq(4, 5, 6), O, K)) == [6]
    assert vals(basic.distinct_until_changed(seq(1, 1, None, None, 2), "value", O, K)) == [1, None, 2]
    assert basic.first(seq(1), O, K, F.col("value") > 5).count() == 0
    assert basic.single(seq(5))["value"] == 5


def test_global_number(spark):
    rows = [(i * 37 % 1000, i) for i in range(1000)]
    df = number(spark.createDataFrame(rows, "t long, id long"), ["t", "id"], bucket=F.floor(F.col("t") / 10))
    got = [r.rn for r in df.orderBy("t", "id").collect()]
    assert got == list(range(1, 1001))


def test_two_inputs(seq):
    left, right = seq(1, 3, at=[0, 2]), seq(2, at=[1])
    assert [(r.l, r.r) for r in joins.combine_latest({"l": left, "r": right}, "value", O, K).orderBy("seq").collect()] == [(1, 2), (3, 2)]
    p, s = seq(1, 2, at=[0, 3]), seq(10, 20, at=[1, 2])
    assert [(r.value, r.other) for r in joins.with_latest_from(p, s, "value", O, K).orderBy("seq").collect()] == [(1, 10), (2, 20)]
    assert vals(joins.race([seq(1, at=[1]), seq(9, 10, at=[0, 2])], O, K)) == [9, 10]
    assert vals(joins.take_until(seq(7, 8, 9, at=[0, 1, 3]), seq(0, at=[2]), O, K)) == [7, 8]
    assert joins.take_until(seq(7, at=[0]), seq(0, at=[0]), O, K).count() == 0


def test_notifiers(seq):
    out = joins.buffer(seq(1, 2, 3, at=[0, 1, 3]), seq(0, at=[2]), "value", O, K).orderBy("flush").collect()
    assert [r["items"] for r in out] == [[1, 2], [3]]
    assert vals(joins.sample(seq(5, 6, at=[0, 2]), seq(0, 0, at=[1, 3]), "value", O, K)) == [5, 6]
    control = seq(1, 0, at=[1, 2]).withColumn("open", F.col("value") == 1).drop("value")
    assert vals(joins.valve(seq(10, 11, 12, at=[0, 1, 2]), control, "value", O, K)) == [11]


def test_time(seq):
    rows = seq(1, 2, at=[0, 5])
    assert vals(timeops.debounce(rows, "seq", 10, O, K)) == [2]
    assert vals(timeops.throttle(seq(1, 2, 3, at=[0, 5, 10]), "seq", 10, O, K)) == [1, 3]
    assert [(r.value, r.emit_at) for r in timeops.audit(rows, "seq", 10, O, K).collect()] == [(2, 10)]
    failed = timeops.timeout(seq(1, 2, at=[0, 10]), "seq", 10, O, K).orderBy("seq").collect()
    assert [(r.value, r.error) for r in failed] == [(1, None), (None, "timeout: no value within 10ms")]


def test_greedy_against_a_loop(spark):
    rng = random.Random(3)
    rows = sorted((k, rng.randrange(0, 400), i) for i, k in enumerate(rng.choices("abc", k=300)))
    df = spark.createDataFrame(rows, "key string, seq long, id long")
    want, opened = [], {}
    for k, t, i in rows:
        if k not in opened or t - opened[k] >= 20:
            opened[k] = t
            want.append(i)
    assert sorted(vals(timeops.throttle(df, "seq", 20, ["seq", "id"], K), "id", "id")) == sorted(want)


def test_cron():
    assert cron.parse("0,30 9-17/2 * 1-3 1-5")[:2] == [[0, 30], [9, 11, 13, 15, 17]]
    with pytest.raises(ValueError):
        cron.parse("61 * * * *")


def test_cron_days(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2026-07-01 09:00:00'), (TIMESTAMP_NTZ'2026-06-08 09:00:00'), (TIMESTAMP_NTZ'2026-06-02 09:00:00') t(at)")
    assert [r.m for r in df.select("at", cron.matches(F.col("at"), "0 9 1 * 1").alias("m")).collect()] == [True, True, False]
    assert cron.calendar(spark, "2026-06-01 00:00:00", "2026-06-01 23:59:00", "0 */6 * * *").count() == 4


def test_backoff(spark):
    one = lambda n, kind, **p: spark.range(1).select(resilience.backoff_ms(kind, F.lit(n), **p).alias("d")).first()["d"]
    assert one(4, "linear", initial=10, step=5, cap=18) == 18
    assert one(4, "exponential", initial=10, cap=50) == 50
    assert one(6, "fibonacci", initial=10) == 80
    assert one(1, "constant", initial=25) == 25
    assert one(3, "none") == 0


def test_ids_and_cosine(spark):
    row = spark.sql("SELECT 'policy' a, 'proposal' b").select(ids.prefixed_key("admission", "a", "b").alias("k")).first()
    assert row["k"] == 'admission:["policy","proposal"]'
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0], [1.0]), ([float("nan")], [1.0]), ([1.0], [1.0, 0.0])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<double>, b array<double>")
    assert [r.c for r in df.orderBy("i").select(memory.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_pack_context(spark):
    entries = spark.createDataFrame([(1, "near"), (2, "far")], "rank int, fragment_id string")
    texts = spark.createDataFrame([(0, "near", "near text"), (1, "far", "far text"), (2, "near", "later")], "idx long, fragment_id string, text string")
    out = memory.pack_context(entries, texts, 24, " | ", True).first()
    assert (out["text"], out["truncated"], out["missing"]) == ("[near] near text", True, 0)
    assert memory.pack_context(entries, texts, 5, " | ", True).first()["text"] == ""


COMMAND = "queue_id string, ord long, command_id string, kind string, work_id string, lease_id string, attempt long, worker_id string, `limit` long, not_before_ms long, retryable boolean, now_ms long"


def command(i, kind, work=None, lease=None, attempt=None, now=0):
    return ("q", i, f"c{i}", kind, work, lease, attempt, "w" if kind != "submit" else None, 1, None, None, now)


def test_queue_first_in_first_out(spark):
    rows = [command(0, "submit", "z-first"), command(1, "submit", "a-second"), command(2, "claim")]
    out = queue.fold(spark.createDataFrame(rows, COMMAND), 5, 2).where("kind = 'WorkClaimed'").collect()
    assert [r.work_id for r in out] == ["z-first"]


def test_queue_retry(spark):
    rows = [command(0, "submit", "x"), command(1, "claim"), command(2, "expire_leases", now=6), command(3, "claim", now=6), command(4, "fail", "x", queue.lease_id("x", 2), 2, 7), command(4, "fail", "x", queue.lease_id("x", 2), 2, 7)]
    out = queue.fold(spark.createDataFrame(rows, COMMAND), 5, 2).orderBy("record_seq").collect()
    kinds = [r.kind for r in out if r.kind != "Issue"]
    assert kinds == ["WorkAdmitted", "WorkClaimed", "LeaseExpired", "WorkClaimed", "AttemptFailed", "WorkDeadLettered"]
    assert [r.reason for r in out if r.kind == "Issue"] == ["duplicate-command"]


def test_lists(spark):
    rows = [("l", 0, "append", None, 1, None), ("l", 1, "appendMany", None, None, [2, 3]), ("l", 2, "insert", 0, 9, None), ("l", 3, "pop", -1, None, None)]
    df = spark.createDataFrame(rows, "collection string, seq long, kind string, index long, value long, values array<long>")
    assert vals(collections.list_snapshot(df), "value", "position") == [9, 1, 2]


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"enum": [1, "x"]}}}, "additionalProperties": False}
    check = lambda v: bus.schema_error(v, schema, schema)
    assert check({"a": 3.0}) is None
    assert check({"a": 1.5})[0] == "$.a"
    assert check({"a": True})[0] == "$.a"
    assert check({})[0] == "$.a"
    assert check({"a": 1, "b": [1, "y"]})[0] == "$.b[1]"
    assert check({"a": 1, "c": 1})[0] == "$.c"


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "y")], "source string, target string")
    out = {r.target: (r.path, r.reason) for r in graphs.shortest_paths(edges, pairs).collect()}
    assert out == {"d": (["a", "b", "d"], "ok"), "y": (None, "no path")}
    found = graphs.reachable(edges, spark.createDataFrame([("d",)], "node string"), "up")
    assert sorted((r.node, r.depth) for r in found.collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_sources(spark):
    assert vals(values.of(spark, [3, 1], "long")) == [3, 1]
    assert values.empty(spark, "a long").count() == 0
    assert [r.at_ms for r in values.timer(spark, 100, 10, 2).orderBy("tick").collect()] == [110, 120]
