"""A dictionary join at block level: values of many rows meet a global table, one row per block and part.

A block is a run of documents of about BLOCK bytes. Its distinct values (words, n-gram hashes) are
dealt into parts by hash, one packed cell per part. Cells of a part meet in one task, where each
distinct value is resolved once for the whole corpus; the answers travel back, again as one cell per
block and part, to the block's documents. So what is shuffled is the distinct values of each block
instead of every occurrence with its document and position, and no dictionary is ever broadcast.
Parts follow from the bytes of the texts, so that what meets in one task does not grow with them.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, release, stage

#: Bytes of text in a block, and for each part of the dictionary.
BLOCK, PER_PART = 8 << 20, 16 << 20

_CODEC = pa.Codec("zstd", 6)


def pack_arrays(*arrays: np.ndarray, planes: bool = True) -> bytes:
    """Integer arrays, compressed; by byte planes, which suits differences of sorted values, or as they are."""
    out = [np.uint32(len(arrays) << 1 | planes).tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if planes else a
        data = _CODEC.compress(raw.tobytes(), asbytes=True)
        out += [a.dtype.str.encode().ljust(4), np.array([len(a), len(data)], "<u8").tobytes(), data]
    return b"".join(out)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    head, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(head >> 1):
        kind = np.dtype(data[at : at + 4].decode().strip())
        size, packed = np.frombuffer(data, "<u8", 2, at + 4).tolist()
        raw = np.frombuffer(_CODEC.decompress(data[at + 20 : at + 20 + packed], size * kind.itemsize, asbytes=True), np.uint8)
        if head & 1:
            raw = np.ascontiguousarray(raw.reshape(kind.itemsize, size).T)
        out.append(raw.view(kind).reshape(size))
        at += 20 + packed
    return out


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows (doc_id, text) of a partition with about ``most`` bytes, and an id of each run.

    The id covers place and content, so that a block made again from other rows never meets the
    answers for this one.
    """
    held: list[pa.RecordBatch] = []
    size = made = 0
    part = TaskContext.get().partitionId()

    def close() -> tuple[int, pa.Table]:
        table = pa.Table.from_batches(held)
        seal = hashlib.blake2b(f"{part} {made}".encode(), digest_size=8)
        seal.update(repr((table.column(0).to_pylist(), size)).encode())
        return int.from_bytes(seal.digest(), "little", signed=True), table

    for batch in batches:
        start = 0
        for i, n in enumerate(byte_lengths(batch.column(1))):
            size += n
            if size >= most:
                held.append(batch.slice(start, i + 1 - start))
                yield close()
                held, size, start, made = [], 0, i + 1, made + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield close()


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def steady(docs: DataFrame) -> DataFrame:
    """``docs``, written first if its plan has a shuffle or a limit: blocks are made twice, also after the loss of
    an executor, and such rows may come in another order the second time."""
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        docs.explain()
    return stage(docs, "steady") if any(x in plan.getvalue() for x in ("Exchange", "Limit", "Sample")) else docs


def dictionary_parts(docs: DataFrame) -> tuple[int, int]:
    """Parts of the dictionary and blocks for ``docs`` (text): by their bytes, and no fewer parts than shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // PER_PART)), max(1, -(-size // BLOCK))


def _dealt_evenly(docs: DataFrame, parts: int) -> list[int]:
    """A key for each part, so that parts meet distinct shuffle partitions as far as there are that many."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.sparkSession.range(40 * n).select(F.col("id").cast("int").alias("key"))
    least = keys.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("at")).agg(F.min("key").alias("key")).collect()  # a row per partition
    first = sorted(r["key"] for r in least)
    return (first + list(range(40 * n, 40 * n + parts)))[:parts]


def through_dictionary(
    docs: DataFrame,
    parts: int,
    keep: Callable[[pa.Table], bytes],
    cells: Callable[[pa.Table], Iterable[tuple[int, bytes]]],
    resolve: Callable[[list[bytes]], list[bytes]],
    finish: Callable[[bytes, dict[int, bytes]], Iterable[pa.RecordBatch]],
    schema: str,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` (doc_id, text) in blocks through a dictionary of ``parts`` shared by the whole corpus.

    keep(block) gives what the block's rows are finished from, cells(block) the packed distinct values
    by part, resolve(cells of a part) the answers in the same order, finish(what was kept, answers by
    part) the rows of ``schema``; a block that asks nothing, as all its texts are empty, gets no answers.
    """
    docs = steady(docs.select("doc_id", "text"))
    key = _dealt_evenly(docs, parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_id, table in blocks(batches, block):
            rows = [(block_id, key[part], part, cell) for part, cell in cells(table)]
            release()
            yield _rows(rows, ["block", "key", "part", "payload"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_id, table in blocks(batches, block):
            kept = keep(table)
            release()
            yield _rows([(block_id, kept)], ["block", "payload"], [pa.int64(), pa.binary()])

    def answer(table: pa.Table) -> pa.Table:
        payload = resolve(table.column("payload").to_pylist())
        release()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "payload": pa.array(payload, pa.binary())})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("a block and its answers were made from different rows")
        answers = dict(zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True))
        out = pa.Table.from_batches(finish(left.column("payload")[0].as_py(), answers))
        release()
        return out

    asked = docs.mapInArrow(ask, "block long, key int, part int, payload binary")
    answered = asked.groupBy("key").applyInArrow(answer, "block long, part int, payload binary")
    held = docs.mapInArrow(hold, "block long, payload binary")
    return held.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(meet, schema)
