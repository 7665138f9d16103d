"""Sequential folds per key that hold one row at a time: keys are dealt out once, their sorted rows pass as a stream of batches."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .order import Cols

#: Output rows that are handed on at once.
RUN = 10_000


def values_of(column: pa.Array) -> list:
    """The values of a column, as ``to_pylist`` gives them; plain kinds go by numpy, which is several times as fast."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind) or pa.types.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(kind):
        if not column.null_count:
            return column.to_numpy().tolist()
        there = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [v if t else None for v, t in zip(column.fill_null(0).to_numpy().tolist(), there, strict=True)]
    return column.to_pylist()


def keyed_fold(
    df: DataFrame, keys: Cols, order_by: Cols, step: Callable, initial: Callable[[], object], out: str | T.StructType, finish: Callable[[tuple, object], Iterable[tuple]] | None = None,
    dealt: bool = False,
) -> DataFrame:
    """``step(state, row)`` gives (new state, output tuples) for each row of a key, in order; ``finish(key, state)`` more at its end.

    ``initial()`` makes a key's first state. What is held is the state of one key and a batch of rows, so
    a key may have any number of rows; its rows are read by one task, as the fold is sequential by its meaning.
    ``dealt`` tells that ``df`` has each key's rows in one partition already.
    """
    kind = T.StructType.fromDDL(out) if isinstance(out, str) else out
    schema = to_arrow_schema(kind)
    names = df.columns
    places = [names.index(k) for k in keys]
    row_of = namedtuple("row_of", names, rename=True)

    def table(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, made = None, None, []
        for batch in batches:
            for values in zip(*map(values_of, batch.columns), strict=True):
                own = tuple(values[p] for p in places)
                if own != key:
                    if key is not None and finish:
                        made += finish(key, state)
                    key, state = own, initial()
                state, more = step(state, row_of(*values))
                made += more
                if len(made) >= RUN:
                    yield table(made)
                    made = []
        if key is not None and finish:
            made += finish(key, state)
        if made:
            yield table(made)

    return (df if dealt else df.repartition(*keys)).sortWithinPartitions(*keys, *order_by).mapInArrow(run, kind)
