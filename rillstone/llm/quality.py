"""A quality classifier of supervised subword embeddings.

A document is the mean of the vectors of its words, word pairs and character n-grams, found by hash
in one table; a softmax over that mean gives its class. Vectors and output are trained by numpy
stochastic gradient descent on a bounded, documented sample of labelled rows. As the output is linear
in the mean, scoring needs one number per hash bucket, and a document costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import release, slices

#: At most so many labelled documents are learned from: those whose hashed ids are smallest.
SAMPLE = 2500
BUCKET_BITS, DIM, EPOCHS, RATE = 18, 8, 5, 0.8
CHARS = (3, 4, 5)
THRESHOLD = 0.3
#: The pair of a word with itself is one feature, whatever the word.
_REPEAT = np.uint32(0)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(key: np.ndarray, salt: int) -> np.ndarray:
    return ((key + np.uint64(salt)) * _ODD >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features of a string array: buckets of all texts one after another, and n + 1 offsets.

    Words end at ASCII white space and keep their case. Character n-grams are of bytes and may hold
    white space at their ends only, so they know where words begin and end.
    """
    raw, offsets = hashing._text_bytes(texts)
    n = len(raw)
    space = hashing._SPACE[raw]
    words, word_offsets = hashing.exact_word_hashes(texts)
    yield _bucket(words, 1), word_offsets
    pair = _bucket(words[:-1] * hashing._COEF[0] + words[1:], 2)
    pair[words[1:] == words[:-1]] = _REPEAT
    inside = np.ones(len(words), bool)
    starts = word_offsets[:-1][word_offsets[:-1] < word_offsets[1:]]
    inside[starts] = False
    kept = np.flatnonzero(inside)
    yield pair[kept - 1], np.searchsorted(kept, word_offsets)
    key = np.where(space, np.uint8(32), raw).astype(np.uint64)
    grams, wide = key.copy(), 1
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets[1:]] = True
    for size in CHARS:
        while wide < size:
            grams = grams[: n - wide] | key[wide:] << np.uint64(8 * wide)
            wide += 1
        if n < size:
            continue
        ok = np.ones(n - size + 1, bool)
        for k in range(1, size):
            ok &= ~doc_end[k : n - size + 1 + k]
            if k < size - 1:
                ok &= ~space[k : n - size + 1 + k]
        at = np.flatnonzero(ok)
        yield _bucket(grams[at], 2 + size), np.searchsorted(at, offsets)


def _doc_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text, and the share of its features in each."""
    every = np.concatenate([b for b, _ in features(pa.array([text], pa.string()))])
    ids, counts = np.unique(every, return_counts=True)
    return ids, (counts / max(len(every), 1)).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """The score of each bucket and the bias, learned from texts with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    docs = [_doc_features(t) for t in texts]
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids]
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * p
            # As every feature of a text gets the same gradient, its share scales the step; the
            # factor keeps steps of long texts, whose shares are small, of useful size.
            vectors[ids] -= (lr * np.sqrt(len(ids)) * share)[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _score(model: tuple[np.ndarray, float]) -> Callable[[Column | str], Column]:
    """The model's score of a column of texts. Only texts travel to Python and scores back."""
    value, bias = model

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = [np.zeros(0)]
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 1 << 20) if len(texts) else ():
                total, count = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for buckets, offsets in features(part.column(0)):
                    sums = np.concatenate([[0.0], np.cumsum(value[buckets], dtype=np.float64)])
                    total += sums[offsets[1:]] - sums[offsets[:-1]]
                    count += np.diff(offsets)
                scores.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias))))
            yield pa.array(np.concatenate(scores), pa.float64())
            del texts
            release()

    return F.arrow_udf(run, "double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample`` labelled rows that are not held out.

    Rows without an id, label or document are passed over; an id labelled twice counts with its
    smaller label. Without any usable label every document scores 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    table = rows.toArrow().sort_by("doc_id")
    model = train([t or "" for t in table.column("text").to_pylist()], table.column("quality").to_pylist())
    del table
    release()  # the driver lives on, and what features of the sample took would stay with it
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``; a null text counts as empty."""
    return docs.select("doc_id", _score(model)("text").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text, any others).

    Labels, language, source and id are no inputs of a score. A null doc_id is not held out. Rows
    that repeat get equal scores; an empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, whole, whose text is not rejected; null and empty texts are scored like any other."""
    return docs.where(_score(fit(docs, labels, sample))("text") >= threshold)
