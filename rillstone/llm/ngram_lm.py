"""Stupid-backoff scores of documents against n-gram count tables that are partitioned by hash.

A document's score is the sum over its words of relative counts, with a back-off to shorter n-grams.
``count_table`` and ``scores_by_table`` are the relational form: exploded n-grams are counted by hash,
joined to the table and summed per document, so any documents can be scored against any corpus.
``scores`` is that join where the corpus is the documents themselves, with the exploded n-grams of a
block of documents packed by hash range (see ``exchange``): the join then moves a fifth of the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import per_batch, release, slices, stage
from .exchange import blocks, dictionary_parts, pack_arrays, pack_table, steady, through_dictionary, unpack_arrays, unpack_table

#: N-grams are known by so many bits of their hash; two of 10^9 distinct ones collide with odds of 1 in 70 million each.
BITS = 56
ORDER, ALPHA = 3, 0.4
#: More cells than this, blocks times hash ranges, are not made: the relational form takes over, with the same rows.
CELLS = 100_000_000
_SCORES = "doc_id long, n_words long, log10_score double"


def _word_count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = sum(len(hashing.word_hashes(part.column(0))[0]) for part in slices(batch, 0, 8 << 20))
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def total_words(docs: DataFrame) -> int:
    counted = docs.select("text").mapInArrow(per_batch(_word_count), "n long")
    return counted.agg(F.sum("n").alias("n")).first()["n"] or 0


def _ngrams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of each order that end at a word of the same text, those words' positions,
    and the texts' offsets in words."""
    words, offsets = hashing.word_hashes(texts)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    hashes, ends = [], []
    for n in range(1, order + 1):
        end = np.flatnonzero(place >= n - 1)
        own = hashing.sequences(words, n)
        hashes.append(own[end - n + 1] >> np.uint64(64 - BITS) if len(end) else own[:0])
        ends.append(end)
    return hashes, ends, offsets


def _score(block: pa.Table, order: int, alpha: float, total: int, count: Callable[[int, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Scores of a block's rows; count(n, distinct hashes in order) gives the corpus counts of n-grams."""
    hashes, ends, offsets = _ngrams(block.column("text").combine_chunks(), order)
    words = int(offsets[-1])
    score = before = np.zeros(0)
    for n in range(order):
        distinct, inverse = np.unique(hashes[n], return_inverse=True)
        counts = np.zeros(words)
        counts[ends[n]] = count(n + 1, distinct)[inverse]
        if n == 0:
            score = np.log10(np.maximum(counts, 0.5) / max(total, 1))
        else:
            tried = np.zeros(words, bool)
            tried[ends[n]] = True
            context = np.concatenate([[1.0], before[:-1]])[:words]
            found = np.log10(np.maximum(counts, 1) / np.maximum(context, 1))
            score = np.where(counts > 0, found, np.where(tried, score + np.log10(alpha), score))
        before = counts
    sums = np.concatenate([[0.0], np.cumsum(score)])
    sums = sums[offsets[1:]] - sums[offsets[:-1]]
    return pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), pa.array(sums)], ["doc_id", "n_words", "log10_score"])


def _exploded(order: int, block: int | None = None):
    """The distinct n-grams of each block of documents with their counts, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_id, table in blocks(batches, *([block] if block else [])):
            for n, own in enumerate(_ngrams(table.column("text").combine_chunks(), order)[0], 1):
                value, count = np.unique(own, return_counts=True)
                for at in range(0, len(value), 1 << 16):
                    v, c = value[at : at + (1 << 16)], count[at : at + (1 << 16)]
                    arrays = [np.full(len(v), block_id), np.full(len(v), n, np.int32), v.view(np.int64), c]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["block", "n", "gram", "count"])
            release()

    return run


_EXPLODED = "block long, n int, gram long, count long"


def count_table(corpus: DataFrame, order: int = ORDER) -> DataFrame:
    """n, gram (its hash) and count of every n-gram of ``corpus`` (text, any others) up to ``order``, partitioned
    by hash. Words and n-grams as in ``scores``; null and blank texts hold none. Repeated rows count again."""
    exploded = corpus.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_exploded(order), _EXPLODED)
    return exploded.groupBy("n", "gram").agg(F.sum("count").alias("count"))


def scores_by_table(docs: DataFrame, table: DataFrame, order: int = ORDER, alpha: float = ALPHA, block: int | None = None) -> DataFrame:
    """As ``scores``, against the counts of ``table`` (n, gram, count), of whatever corpus.

    The distinct n-grams of a block of documents are joined to the table by hash and return to the block.
    """
    docs = steady(docs.select("doc_id", "text"))
    total = table.where("n = 1").agg(F.sum("count").alias("n")).first()["n"] or 0
    size = [block] if block else []

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_id, own in blocks(batches, *size):
            yield pa.RecordBatch.from_arrays([pa.array([block_id]), pa.array([pack_table(own)], pa.binary())], ["block", "payload"])

    def finish(held: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        n, gram, count = (counts.column(c).to_numpy() for c in ("n", "gram", "count"))
        sort = np.lexsort((gram, n))
        n, gram, count = n[sort], gram[sort], count[sort]

        def known(k: int, distinct: np.ndarray) -> np.ndarray:
            own = gram[n == k]
            at = np.minimum(np.searchsorted(own, distinct.view(np.int64)), max(len(own) - 1, 0))
            return np.where(own[at] == distinct.view(np.int64), count[n == k][at], 0) if len(own) else np.zeros(len(distinct), np.int64)

        for payload in held.column("payload").to_pylist():
            out.append(_score(unpack_table(payload), order, alpha, total, known))
        return pa.Table.from_batches(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log10_score": pa.array([], pa.float64())})

    asked = docs.mapInArrow(_exploded(order, block), _EXPLODED).select("block", "n", "gram")
    answers = asked.join(table, ["n", "gram"]).select("block", "n", "gram", "count")
    held = docs.mapInArrow(hold, "block long, payload binary")
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, _SCORES)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, most_cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, log10_score (sum over words) of each row of ``docs`` (doc_id, text, any others).

    A word's score is c(w1..wn) / c(w1..wn-1) for the longest n <= ``order`` with c(w1..wn) > 0, times
    ``alpha`` for each step that was tried before (at a text's start there are fewer to try); for n = 1 it
    is c(w) / N, and a word that the corpus lacks scores as half an occurrence. c counts the corpus, all
    rows of ``docs``, repeated ones included; N is its words. Words are runs of bytes without white space,
    A-Z as a-z. Texts that are null or hold no word have 0 words and score 0. Rows that repeat score
    alike; a null doc_id stays null; an empty table gives no rows.
    """
    parts, made = dictionary_parts(docs)
    if parts * made > most_cells:
        return scores_by_table(docs, stage(count_table(docs, order), "ngram-counts"), order, alpha)
    total = total_words(docs)
    bounds = np.array([(p << BITS) // parts for p in range(parts + 1)], np.uint64)  # first hash of each part: equal ranges

    def keep(block: pa.Table) -> bytes:
        return pack_table(block)

    def cells(block: pa.Table) -> Iterator[tuple[int, bytes]]:
        packed = [[] for _ in range(parts)]
        for own in _ngrams(block.column("text").combine_chunks(), order)[0]:
            value, count = np.unique(own, return_counts=True)
            cut = np.searchsorted(value, bounds)
            for p in range(parts):
                v = value[cut[p] : cut[p + 1]]
                packed[p] += [np.diff(v, prepend=bounds[p]), count[cut[p] : cut[p + 1]].astype(np.uint32)]
        yield from ((p, pack_arrays(*arrays)) for p, arrays in enumerate(packed) if any(map(len, arrays)))

    def resolve(payloads: list[bytes]) -> list[bytes]:
        asked = [unpack_arrays(data) for data in payloads]
        answers: list[list[np.ndarray]] = [[] for _ in asked]
        for n in range(order):
            # Differences start at the part's first hash, the same for all blocks, so it may be left out.
            values = [np.cumsum(a[2 * n], dtype=np.uint64) for a in asked]
            every = np.concatenate(values)
            sort = np.argsort(every, kind="stable")
            first = np.concatenate([[True], np.diff(every[sort]) > 0])[: len(sort)]
            group = np.cumsum(first) - 1
            sums = np.bincount(group, weights=np.concatenate([a[2 * n + 1] for a in asked])[sort])
            total_of = np.empty(len(every), np.uint64)
            total_of[sort] = sums[group].astype(np.uint64)
            at = 0
            for own, v in zip(answers, values, strict=True):
                own.append(total_of[at : at + len(v)])
                at += len(v)
        return [pack_arrays(*own) for own in answers]

    def finish(kept: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        got = [unpack_arrays(answers[p]) for p in sorted(answers)]

        def count(n: int, distinct: np.ndarray) -> np.ndarray:
            own = np.concatenate([np.zeros(0, np.uint64), *(g[n - 1] for g in got)])
            if len(own) != len(distinct):
                raise RuntimeError("a block and its answers were made from different rows")
            return own.astype(np.int64)

        yield _score(unpack_table(kept), order, alpha, total, count)

    return through_dictionary(docs, parts, keep, cells, resolve, finish, _SCORES)
