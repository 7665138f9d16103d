"""Packing whole documents into sequences without padding: shortest pack first over the length histogram.

Pieces of equal length are interchangeable, so packs are planned from the histogram of lengths: as
many packs as the tokens fill, all empty at first, lengths from the longest down, each to the shortest
pack. Equal packs are one pattern with a count, so a step moves as many pieces as the pattern has
packs. A length that the shortest pack cannot hold is cut there: its head fills the pack, its tail is a
shorter length of the histogram. What is left over in the end goes to sequences of powers of two, which
need no padding either. Documents meet the patterns through their ordinal within their length.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, slices, stage
from .packing import default_tokenizer, document_ids, histogram, with_ordinal

CAPACITY, END = 4096, 2
#: Short pieces go to a pack in steps of a SHARE-th of it, so that plans stay small.
SHARE = 64

TOKENS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Columns of a plan: pieces of ``length`` with ordinals from ``first`` on, ``count`` of them; of each the ``size`` tokens from
#: ``cut`` on go to sequences from ``sequence`` on, ``packs`` of them in turn, at ``offset``, and ``size`` further on each time round.
LEVEL, LENGTH, FIRST, COUNT, CUT, SIZE, SEQUENCE, PACKS, OFFSET = range(9)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where pieces go, from ``counts`` of each length: rows as above, by level, length and first ordinal.

    Rows of a level hold a piece once at most: level 0 its first tokens, level 1 those after its first cut, and so on.
    """
    total = sum(n * c for n, c in counts.items())
    whole = total // capacity
    rows: list[tuple[int, ...]] = []
    # Pieces by the length that is left of them: (level, own length, first ordinal, how many, tokens placed before).
    waiting: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for n, c in counts.items():
        if c:
            waiting[n].append((0, n, 0, c, 0))
    packs: dict[int, list[tuple[int, int]]] = {0: [(0, whole)]} if whole else {}  # by fill: (first sequence, how many)
    fills = [0] if whole else []
    over: list[tuple[int, int, int, int, int, int]] = []

    def put(fill: int, first: int, n: int) -> None:
        if fill < capacity:
            if fill not in packs:
                packs[fill] = []
                heapq.heappush(fills, fill)
            packs[fill].append((first, n))

    lengths = [-n for n in waiting]
    heapq.heapify(lengths)
    while lengths:
        n = -heapq.heappop(lengths)
        queue = waiting.pop(n)
        while queue:
            level, own, at, c, cut = queue.pop()
            if not fills:
                over.append((n, level, own, at, c, cut))
                continue
            fill = fills[0]
            gap = capacity - fill
            first, m = packs[fill].pop()
            if not packs[fill]:
                del packs[heapq.heappop(fills)]
            size = min(n, gap)
            rounds = 1
            if c > m and size == n:
                # Several rounds at once: until these packs are no longer the shortest, or a small share of a pack.
                alone = fill not in packs
                rounds = min(c // m, gap // n, max(1, capacity // SHARE // n, -(-((fills[0] if fills else capacity) - fill) // n) if alone else 1))
            k = min(c, m * rounds)
            used = min(k, m)
            rows.append((level, own, at, k, cut, size, first, used, fill))
            put(fill + size * rounds, first, used)
            if used < m:
                put(fill, first + used, m - used)
            if k < c:
                queue.append((level, own, at + k, c - k, cut))
            if size < n:
                if n - size not in waiting:
                    heapq.heappush(lengths, size - n)
                waiting[n - size].append((level + 1, own, at, k, cut + size))

    # Fewer tokens than a sequence holds are left: one sequence per binary digit of their number.
    rooms = [1 << b for b in range(max(1, capacity.bit_length())) if (total - whole * capacity) >> b & 1]
    sequence, offset = whole, 0
    for n, level, own, at, c, cut in over:
        for ordinal in range(at, at + c):
            deep, done = level, cut
            while done < cut + n:
                size = min(cut + n - done, rooms[-1] - offset)
                rows.append((deep, own, ordinal, 1, done, size, sequence, 1, offset))
                deep, done, offset = deep + 1, done + size, offset + size
                if offset == rooms[-1]:
                    rooms.pop()
                    sequence, offset = sequence + 1, 0
    return np.array(sorted(rows), np.int64).reshape(-1, 9)


def _tokens(path: str, capacity: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1, 2 << 20):
            out: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), document_ids(texts, path), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    row = (doc_id, at // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4, None if len(own) == 4 * capacity else own)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, [*[pa.int64()] * 5, pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return per_batch(run)


def tokens(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """A row per stretch of at most ``capacity`` tokens of each document and its end id, with the ids of those that are shorter."""
    return docs.select("doc_id", "text").mapInArrow(_tokens(path or default_tokenizer(), capacity, end_id), TOKENS)


def _placed(table: np.ndarray):
    """The plan's rows for each piece, level by level; ids are looked at where a piece is cut."""
    levels = [table[table[:, LEVEL] == k] for k in range(int(table[:, LEVEL].max(initial=-1)) + 1)]
    keys = [t[:, LENGTH] << 44 | t[:, FIRST] for t in levels]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.schema.names
        length, ordinal, start = (batch.column(names.index(c)).to_numpy() for c in ("length", "ordinal", "start"))
        crc = batch.column(names.index("ids_crc32")).to_numpy()
        ids = batch.column(names.index("ids"))
        for level, key in zip(levels, keys, strict=True):
            at = np.maximum(np.searchsorted(key, length << 44 | ordinal, side="right") - 1, 0)
            row = level[at]
            own = np.flatnonzero((row[:, LENGTH] == length) & (ordinal >= row[:, FIRST]) & (ordinal < row[:, FIRST] + row[:, COUNT]))
            row, nth = row[own], ordinal[own] - row[own, FIRST]
            sums = crc[own].copy()
            for i in np.flatnonzero(row[:, SIZE] != length[own]).tolist():
                cut, size = row[i, [CUT, SIZE]].tolist()
                sums[i] = zlib.crc32(ids[int(own[i])].as_py()[4 * cut : 4 * (cut + size)])
            turn, pack = np.divmod(nth, row[:, PACKS])
            made = [start[own] + row[:, CUT], row[:, SIZE], sums]
            places = [row[:, SEQUENCE] + pack, row[:, OFFSET] + turn * row[:, SIZE]]
            doc, tokens = (batch.column(names.index(c)).take(pa.array(own)) for c in ("doc_id", "doc_tokens"))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, made), tokens, *map(pa.array, places)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return per_batch(run)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece of each document.

    Every sequence holds ``capacity`` tokens (a power of two), but for at most one of each smaller power. Null texts count
    as empty: they hold the end id alone. Rows that repeat or have no doc_id are packed like any other,
    other columns are left out. An empty table gives no rows. Ids travel only with pieces of lengths that the plan cuts.
    """
    made = stage(tokens(docs, path, capacity, end_id), "tokens")
    counts = histogram(made)  # at most ``capacity`` lengths
    table = plan(counts, capacity)
    cut = sorted(set(table[table[:, SIZE] != table[:, LENGTH], LENGTH].tolist()))
    lean = made.withColumn("ids", F.when(F.col("length").isin(cut), F.col("ids")) if cut else F.lit(None).cast("binary"))
    return with_ordinal(lean, counts, ["doc_id", "start", "ids_crc32", "doc_tokens"]).mapInArrow(_placed(table), PLACES)
