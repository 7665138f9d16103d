"""Periodic runs of words: stretches that repeat themselves at least four times, found in any period.

Words of a run stand ``period`` words apart again and again, and no neighbouring word goes on with it.
Short periods are found by comparing a text with itself at each lag. For longer ones a text is looked
at in scales: at scale W, for periods from W to 2W - 1, grams of 2W words are hashed and the minima of
all windows of W grams kept. Inside a run of period q at least one minimum comes again q words on, and
as a gram is longer than q it does not come before that, so neighbours of equal gram tell q. Such pairs
are extended both ways, word by word. Nothing is lost: hashes only say where to look.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import per_batch, slices
from .hashing import mix

#: A run has at least so many periods, and so many words.
TIMES, WORDS = 4, 6
#: Periods below it are found by direct comparison; the first scale.
SCALE = 16
#: Bytes of text that are looked at together, and split into words at once.
TOGETHER, PIECE = 2 << 20, 1 << 20

_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of about PIECE bytes."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.end() if cut else len(text)
        yield text[at:end].split()
        at = end


def _lag(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of period ``q`` that are long enough."""
    same = np.flatnonzero(ids[q:] == ids[:-q])
    least = max(WORDS, TIMES * q) - q
    if len(same) < least:
        return same[:0], same[:0]
    breaks = np.flatnonzero(np.diff(same) != 1)
    first = np.concatenate([[0], breaks + 1])
    last = np.concatenate([breaks, [len(same) - 1]])
    long = last - first + 1 >= least
    return same[first[long]], same[last[long]] + 1 + q


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """The best of each ``width`` neighbouring values, from bests of blocks forwards and backwards."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, worst, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def _minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the least of some window of ``width`` that holds them; all that are equal."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    least = _sliding(grams, width, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == grams)


def _agree(ids: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many of up to ``most`` words agree from places a and b on, forwards (step 1) or backwards (-1)."""
    done, width = 0, 64
    while done < most:
        n = min(width, most - done)
        x, y = (ids[p + done : p + done + n] if step > 0 else ids[p - done - n + 1 : p - done + 1][::-1] for p in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, width = done + n, width * 2
    return done


def _scale(ids: np.ndarray, grams: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the stretches with periods from ``width`` to twice that that hold a seed."""
    at = _minima(grams, width)
    order = np.argsort(grams[at], kind="stable")
    at, value = at[order], grams[at[order]]
    gap = np.diff(at)
    seeds = np.flatnonzero((value[1:] == value[:-1]) & (gap >= width) & (gap < 2 * width))
    at, gap = at[seeds], gap[seeds]
    order = np.lexsort((at, gap))
    period = end = 0
    for m, q in zip(at[order].tolist(), gap[order].tolist(), strict=True):
        if q == period and m + q < end:
            continue  # within the stretch just found
        start = m - _agree(ids, m - 1, m + q - 1, m, -1)
        period, end = q, m + q + _agree(ids, m, m + q, len(ids) - m - q, 1)
        yield start, end, q


def find(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All runs in texts that lie one after another in ``ids``, as rows (start, end, period) by start and period.

    Equal words have equal numbers, and each text ends, at offsets[k + 1] - 1, with a number of its own.
    """
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(SCALE, len(ids))):
        start, end = _lag(ids, q)
        found.append(np.stack([start, end, np.full(len(start), q)], 1))
    width, size = SCALE, np.diff(offsets)
    place = np.arange(len(ids))  # of what is left at a scale
    grams, known = mix(ids.astype(np.uint64) * _ODD), 1
    while True:
        # Texts too short for four periods of this scale go; what is left moves together.
        stay = size > TIMES * width
        if not stay.any():
            break
        if not stay.all():
            own = np.repeat(stay, size)
            place, grams, ids, size = place[own], grams[own], ids[own], size[stay]
        while known < 2 * width:
            longer = np.arange(len(grams), dtype=np.uint64) * _ODD  # grams over the end are like no other
            longer[:-known] = grams[:-known] * _ODD + grams[known:]
            grams, known = mix(longer), 2 * known
        runs = [(s, e, q) for s, e, q in _scale(ids, grams, width) if e - s >= TIMES * q]
        if runs:
            runs = np.array(runs, np.int64)
            runs[:, 1] = place[runs[:, 1] - 1] + 1
            runs[:, 0] = place[runs[:, 0]]
            found.append(runs)
        width *= 2
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # The same stretch at a multiple of its period is no other run.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _looked_at(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text its number of words, its runs (start, length, period) and its words without repetitions."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    parts, sizes = [], []
    for k, text in enumerate(texts):
        own = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in words_of(text)]
        parts += [*own, np.array([-1 - k])]
        sizes.append(sum(map(len, own)) + 1)
    ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
    runs = find(ids, offsets)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    by_text = np.searchsorted(runs[:, 0], offsets)
    for k, text in enumerate(texts):
        own = runs[by_text[k] : by_text[k + 1]] - [offsets[k], offsets[k], 0]
        own[:, 1] -= own[:, 0]
        left, at = [], offsets[k]
        for words in words_of(text):
            left.append(b" ".join(itertools.compress(words, kept[at : at + len(words)].tolist()) if len(own) else words))
            at += len(words)
        yield sizes[k] - 1, own, b" ".join(filter(None, left))


def _through(docs: DataFrame, made: Callable[[pa.RecordBatch, list[tuple[int, np.ndarray, bytes]]], list[pa.Array]], schema: T.StructType) -> DataFrame:
    place, names = docs.columns.index("text"), [f.name for f in schema]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, place, TOGETHER):
            texts = [(t or "").encode() for t in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(made(part, list(_looked_at(texts))), names)

    return docs.mapInArrow(per_batch(run), schema)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, by start, then period) and collapsed for each row.

    Words are stretches without white space (U+0020, U+0009 to U+000D) and numbered from 0; case counts.
    ``collapsed`` holds the words that no run repeats, joined by one space: of each run its first period
    is left. Null and empty texts have no words, no runs and an empty string. Rows that repeat or have no
    doc_id each give their row; other columns are left out; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("collapsed", T.StringType()), T.StructField("runs", T.ArrayType(RUN))])
    kind = to_arrow_schema(schema).field("runs").type

    def made(part: pa.RecordBatch, rows: list) -> list[pa.Array]:
        ends = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in rows])]).astype(np.int32)
        every = np.concatenate([r for _, r, _ in rows])
        items = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=list(kind.value_type))
        lists = pa.ListArray.from_arrays(pa.array(ends), items).cast(kind)
        return [part.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([t.decode() for *_, t in rows], pa.string()), lists]

    return _through(docs.select("doc_id", "text"), made, schema)


def collapse(docs: DataFrame) -> DataFrame:
    """All rows and columns; texts with a run are replaced by their words without its repetitions, others stay as they are."""

    def made(part: pa.RecordBatch, rows: list) -> list[pa.Array]:
        at = part.schema.get_field_index("text")
        texts = [t.decode() if len(r) else old for (_, r, t), old in zip(rows, part.column(at).to_pylist(), strict=True)]
        return [pa.array(texts, c.type) if i == at else c for i, c in enumerate(part.columns)]

    return _through(docs, made, docs.schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the periodic tail that the query's contract asks for.

    With h = crc32(doc_id), g = h div 10 and n words: if h mod 10 is 0, each word i from a = g mod n on
    becomes word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumns({"g": F.expr("h div 10"), "ws": F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))})
    rows = rows.withColumn("n", F.size("ws")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "slice(flatten(array_repeat(slice(ws, int(a) + 1, int(p)), int((n - a) div p + 1))), 1, int(n - a))"
    text = F.when(F.col("n") > 0, F.expr(f"array_join(concat(slice(ws, 1, int(a)), {tail}), ' ')")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """The longest run of each row, their number, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = runs(docs).withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
