"""Calls on states are messages to the JVM: a key's rows cost few of them, however many they are."""

import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from rillstone.operators import cqrs
from rillstone.streaming import stateful

L, S = T.LongType(), T.StringType()


class Store(dict):
    """A state of any kind, and the handle that makes them; calls are counted."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("updateValue", "getValue", "removeKey", "containsKey", "keys", "exists", "get", "update", "clear", "registerTimer", "appendValue"):
            Store.calls += 1
        return super().__getattribute__(name)

    def getMapState(self, *_):  # noqa: N802
        return Store()

    getValueState = getListState = getMapState

    def registerTimer(self, at):  # noqa: N802
        self.timers = sorted({*getattr(self, "timers", []), at})

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def getValue(self, k):  # noqa: N802
        return dict.get(self, k)

    def removeKey(self, k):  # noqa: N802
        del self[k]

    def containsKey(self, k):  # noqa: N802
        return k in self

    def exists(self):
        return len(self) > 0

    def get(self):
        return dict.get(self, "value")

    def update(self, v):
        self["value"] = v


def run(fold, frames):
    """The fold over micro-batches of (rows, watermark)."""
    handle = Store()
    fold.init(handle)
    out = []
    for frame, now in frames:
        handle.now = now
        list(fold.handleInputRows((1,), iter([frame]), handle))
        due = [t for t in getattr(handle, "timers", []) if t <= now]
        for t in due:
            handle.timers.remove(t)
            for made in fold.handleExpiredTimer((1,), handle, None):
                out += list(made.itertuples(index=False, name=None))
    return out


def frames(rows, names, parts, late):
    arrival = sorted(rows, key=lambda r: r[-1] + random.Random(r[0]).randrange(late))
    each = -(-len(arrival) // parts)
    for i in range(parts):
        own = arrival[i * each : (i + 1) * each]
        yield pd.DataFrame(own, columns=names), max(r[-1] for r in own) - late
    yield pd.DataFrame([], columns=names), 10**9


@pytest.mark.parametrize("parts", [1, 7])
def test_publishes_cost_few_calls(parts):
    names = ["ord", "topic", "kind", "command_id", "idempotency_key", "at_ms"]
    rows = [(n, "a", "publish", f"c{n % 1500}", f"k{n % 1900}" if n % 2 else None, 10 * n) for n in range(3000)]
    schema = T.StructType([T.StructField(n, L if n in ("ord", "at_ms") else S) for n in names])
    Store.calls = 0
    out = run(stateful._Publish(False, schema, ["ord"], ["ord", "status", "seq"]), frames(rows, names, parts, 500))
    want, seen, keys, seq = [], set(), set(), 0
    for n, _, _, c, k, _ in rows:
        fine = c not in seen and k not in keys
        seen.add(c)
        if fine:
            seq += 1
            keys |= {k} - {None}
        want.append((n, "published" if fine else "duplicate-command", seq if fine else None))
    assert out == want and len(keys) > 512
    assert Store.calls < 300


def test_a_process_costs_few_calls_a_key(spark):
    names = ["process_id", "ord", "id", "command_type", "at_ms"]
    rows = [(1, n, f"c{n}", "add", 10 * n) for n in range(70)]
    schema = T.StructType([T.StructField(n, S if n in ("id", "command_type") else L) for n in names])
    out = cqrs.facts_type(L, "long")
    Store.calls = 0
    made = run(stateful._Process(lambda state, c: (state + 1, ["added"], []), 0, L, schema, ["ord"], out.names), frames(rows, names, 1, 500))
    assert [r[1] for r in made if r[2] == "accepted"] == list(range(70)) and len(made) == 140
    assert Store.calls < 30
