"""Topics of a knowledge graph take one pass over the assertions; topics of a bus are no hot keys, their rows are shuffled once."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone.functions import order
from rillstone.functions.staging import stage
from rillstone.jobs import knowledge, logs
from rillstone.operators import bus


def test_topics_rank_assertions_once(spark):
    plan = knowledge.k8_topics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert len(ranks) == 1 and "WindowGroupLimit" in plan


def test_running_totals_shuffle_rows_once(spark):
    """Sums of earlier buckets come as a row ahead of each bucket: no join of all rows, which its size would turn into a second shuffle."""
    rows = stage(spark.range(5000).selectExpr("id", "id % 3 AS key", "IF(id % 7 = 0, NULL, id * 31 % 101) AS value", "array(id) AS more"), "rows")
    made = order.running_max(rows, {"most": F.col("value")}, ["id"], ["key"], F.floor(F.col("id") / 100), "_before")
    assert made.columns == [*rows.columns, "most", "most_before"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of buckets with spans
    best = {}
    for r in sorted(made.collect(), key=lambda r: r.id):
        before, best[r.key] = best.get(r.key), max((v for v in (best.get(r.key), r.value) if v is not None), default=None)
        assert (r.most_before, r.most, r.more) == (before, best[r.key], [r.id])


def messages(times):
    return [(topic, 10 * seq, seq, t) for topic, own in times.items() for seq, t in enumerate(own, 1)]


@pytest.mark.parametrize("most", [None, 5])
def test_heads_of_a_clock_that_stands_still(spark, monkeypatch, most):
    """A publish at a time that the topic has seen asks for nothing by itself, so no slot of time holds more than its milliseconds."""
    rng = random.Random(3)
    times = {"still": [None, None, 100, *[7_000] * 400, 8_000, 100, *[8_001] * 50], "mixed": [rng.choice([None, rng.randrange(20_000)]) for _ in range(300)]}
    slots = []
    monkeypatch.setattr(bus, "running_max", lambda df, *a, **k: (slots.append(df.where("topic = 'still'").count()) if "at" in df.columns else None) or order.running_max(df, *a, **k))
    got = bus.timed(spark.createDataFrame(messages(times), "topic string, ord long, seq long, now_ms long"), most, 1_000, per_bucket=16, slot=500).collect()
    assert slots == [8]  # four times of the clock, each asked and told once
    found = {(r.topic, r.seq): (r.ord, r.head_seq, r.trimmed) for r in got}
    assert len(found) == len(got) == sum(map(len, times.values()))
    for topic, own in times.items():
        clocks, last = [], 1
        for seq, t in enumerate(own, 1):
            clocks.append(max((x for x in (t, *clocks[-1:]) if x is not None), default=None))
            old = 0 if clocks[-1] is None else sum(c is None or c < clocks[-1] - 1_000 for c in clocks)
            head = max(1, old + 1, 1 if most is None else seq - most + 1)
            assert found[topic, seq] == (10 * seq, head, head - last)
            last = head


def test_commands_of_subscriptions_are_ordered_once(spark, monkeypatch):
    calls, fresh = [], bus.fresh
    monkeypatch.setattr(bus, "fresh", lambda c: calls.append(1) or fresh(c))
    logs.subscribed(spark, "/root/testdata/sf0.001")
    assert calls == [1]


def test_topics_are_no_key_to_deal_publishes_by(spark):
    rows = logs.commands(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark cannot tell that topics are few
    plans = []
    monkey = bus.stage
    bus.stage = lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or monkey(df, name)
    try:
        bus.publish(rows)
    finally:
        bus.stage = monkey
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in dict(plans)["publishes"]
