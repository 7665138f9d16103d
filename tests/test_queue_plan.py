"""A queue's commands are dealt out once, and columns become Python values as ``to_pylist`` has them."""

import pyarrow as pa

from rillstone.functions import folds
from rillstone.jobs import workflows
from rillstone.operators import queue


def test_commands_are_shuffled_once(spark):
    rows = workflows.queue_commands(spark, "/root/testdata/sf0.001")
    plan = queue.fold(rows, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_values_of_columns():
    for column in (
        pa.array([1, None, 2**62 + 1]), pa.array([1, 2**62 + 1]), pa.array([None, None], pa.int64()), pa.array([], pa.int32()), pa.array(["a", None, ""]),
        pa.array([True, None]), pa.array([["a", None], None]), pa.array([1.5, None]), pa.array([7, None, 9]).slice(1),
    ):
        got = folds.values_of(column)
        assert got == column.to_pylist() and [type(x) for x in got] == [type(x) for x in column.to_pylist()]
