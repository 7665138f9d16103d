"""Codes of vectors by part: codebooks fitted in whole numbers over blocks of neighbouring points.

Vectors are cut into parts. In chunks of rows, as Spark reads them, the points of each part are sorted
along a Hilbert curve and cut into flat blocks, each with the least and greatest coordinate on every axis (its
box), the sum and the number of its points. A round sends the codebooks to the chunks. The distances
between box and entries leave few entries that can be nearest to any of the block's points: mostly one, which
then takes the block's sum unseen. For the others a small kernel of 64-bit integers finds the nearest of the
few. Only sums per entry leave a chunk; rows keep their place, so nothing is shuffled but those sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_rows, release, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a chunk, points of a block, chunks that a Python worker gets at once.
CHUNK, BLOCK, AT_ONCE = 8192, 64, 16
#: A label of more than this share of all rows is joined by broadcast: there are fewer than so many of them.
HEAVY = 1000

Chunk = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (rows) of whole coordinates below 2 ** ``bits``."""
    x, width = x.T.copy(), x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(width):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, width):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(width):
            place = place << 1 | (x[i] >> b & 1)
    return place


def blocks_of(points: np.ndarray) -> tuple[np.ndarray, ...]:
    """order, points in that order, low, high and sums of blocks, each by part, of ``points`` (parts, rows, axes)."""
    parts, n, width = points.shape
    least, most = points.min(1, keepdims=True), points.max(1, keepdims=True)
    axes = min(width, 60)
    bits = max(1, min(4, 60 // max(axes, 1)))
    cells = ((points - least)[:, :, :axes] << bits) // (most - least + 1)[:, :, :axes]
    place = hilbert(cells.reshape(parts * n, axes), bits).reshape(parts, n) if axes else np.zeros((parts, n), np.int64)
    order = np.argsort(place, axis=1, kind="stable")
    points = np.take_along_axis(points, order[:, :, None], 1)
    starts = np.arange(0, n, BLOCK)
    low, high, sums = (f.reduceat(points, starts, axis=1) for f in (np.minimum, np.maximum, np.add))
    return order, points, low, high, sums


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each part, block and entry whether the entry may be nearest to some point of the block's box.

    An entry goes if its least distance to the box is above another's greatest, or if the entry of
    least greatest distance is nearer at every point: the difference of two distances is linear, so
    corners of the box decide.
    """
    e = entries[:, None]
    lo, hi = low[:, :, None], high[:, :, None]
    least = ((e - np.clip(e, lo, hi)) ** 2).sum(-1)
    most = np.maximum((e - lo) ** 2, (hi - e) ** 2).sum(-1)
    best = most.argmin(-1)
    own = np.take_along_axis(entries, best[:, :, None], 1)[:, :, None]
    slope = -2 * (own - e)
    margin = (own**2 - e**2 + np.maximum(slope * lo, slope * hi)).sum(-1)
    return (least <= most.min(-1, keepdims=True)) & (margin >= 0)


def assign(chunk: Chunk, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(part, block, entries of its points, whether one entry takes it whole) for groups of blocks with equally long shortlists.

    Entries are one per block where it is taken whole, else one per point. Of equally near ones the first.
    """
    n, points, low, high, _ = chunk
    keep = shortlists(low, high, entries)
    sizes = keep.sum(-1)
    part, block = np.nonzero(sizes == 1)
    yield part, block, keep[part, block].argmax(-1), True
    padded = np.zeros((points.shape[0], low.shape[1] * BLOCK, points.shape[2]), np.int64)
    padded[:, :n] = points
    padded = padded.reshape(points.shape[0], low.shape[1], BLOCK, points.shape[2])
    for size in np.unique(sizes[sizes > 1]).tolist():
        part, block = np.nonzero(sizes == size)
        short = np.nonzero(keep[part, block])[1].reshape(len(part), size)
        few = entries[part[:, None], short]
        score = (few**2).sum(-1)[:, None] - 2 * (padded[part, block] @ few.transpose(0, 2, 1))
        yield part, block, np.take_along_axis(short, score.argmin(-1), 1), False


def _sums(chunk: Chunk, entries: np.ndarray) -> np.ndarray:
    """For each part and entry the sums of its points by axis, then their number."""
    n, points, low, _, sums = chunk
    parts, count, width = entries.shape
    out = np.zeros((parts * count, width + 1), np.int64)
    sizes = np.minimum(n - np.arange(low.shape[1]) * BLOCK, BLOCK)
    for part, block, entry, whole in assign(chunk, entries):
        if whole:
            np.add.at(out, part * count + entry, np.concatenate([sums[part, block], sizes[block, None]], 1))
            continue
        row = block[:, None] * BLOCK + np.arange(BLOCK)
        real = row < n
        to = (part[:, None] * count + entry)[real]
        own = points[np.broadcast_to(part[:, None], row.shape)[real], row[real]]
        order = np.argsort(to, kind="stable")
        to, own = to[order], own[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        if len(to):
            out[to[first], :width] += np.add.reduceat(own.astype(np.int64), first, axis=0)
            out[to[first], width] += np.diff(np.append(first, len(to)))
    return out.reshape(parts, count, width + 1)


def _codes(chunk: Chunk, order: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by row and part, and errors by row."""
    n, points, low, *_ = chunk
    code = np.zeros((len(points), low.shape[1] * BLOCK), np.int64)
    for part, block, entry, whole in assign(chunk, entries):
        code.reshape(len(points), -1, BLOCK)[part, block] = entry[:, None] if whole else entry
    code = code[:, :n]
    error = ((points - np.take_along_axis(entries, code[:, :, None], 1)) ** 2).sum(-1)
    codes, errors = np.zeros((n, len(points)), np.uint8), np.zeros(n, np.int64)
    for part, own in enumerate(order):
        codes[own, part] = code[part]
        errors[own] += error[part]
    return codes, errors


def whole_numbers(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of each component, rows of ``dims``; shorter vectors end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), np.int64)
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(x) and 4.0 * dims * np.abs(x).max() ** 2 >= 2.0**62:
        raise ArithmeticError("components are too large for distances in 64-bit integers")
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(vectors)), sizes), at] = x.astype(np.int64)
    return out


def _chunks(dims: int, schema: pa.Schema):
    """Chunks of the rows (vec_id, label, embedding) of a partition."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        vectors = rows.column(2).combine_chunks()
        points = whole_numbers(vectors, dims).reshape(len(rows), PARTS, dims // PARTS).transpose(1, 0, 2)
        order, points, low, high, sums = blocks_of(points)
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= points.min(initial=0) and points.max(initial=0) <= np.iinfo(k).max)
        data = [order.astype(np.uint16), points.astype(kind), low.astype(kind), high.astype(kind), sums]
        lists = [pa.ListArray.from_arrays([0, len(rows)], rows.column(i).combine_chunks()) for i in range(2)]
        columns = [*lists, pa.array([len(rows)], pa.int32()), pa.array([np.dtype(kind).str]), *[pa.array([a.tobytes()], pa.binary()) for a in data]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                own = batch.slice(at, CHUNK - n)
                held.append(own)
                at, n = at + own.num_rows, n + own.num_rows
                if n == CHUNK:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
            release()
        if n:
            yield made(pa.Table.from_batches(held))

    return run


def _read(batch: pa.RecordBatch, i: int, dims: int) -> Chunk:
    n, kind = batch.column("n")[i].as_py(), batch.column("kind")[i].as_py()
    arrays = [np.frombuffer(batch.column(c)[i].as_py(), k).reshape(PARTS, -1, dims // PARTS).astype(np.int64) for c, k in (("points", kind), ("low", kind), ("high", kind), ("sums", "<i8"))]
    return n, *arrays


def _round(entries: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for i in range(batch.num_rows):
                total = total + _sums(_read(batch, i, dims), entries)
            del batch
            release()
        if not isinstance(total, int):
            at = np.indices(total.shape).reshape(3, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(total.ravel())], ["part", "entry", "axis", "total"])

    return run


def _final(entries: np.ndarray, dims: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _read(batch, i, dims)
                order = np.frombuffer(batch.column("order")[i].as_py(), np.uint16).reshape(PARTS, -1)
                codes, errors = _codes(chunk, order, entries)
                digits = codes.tobytes().hex()
                text = [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)]
                lists = [batch.column(c)[i].values for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(text, pa.string()), pa.array(errors)], schema=schema)
            del batch
            release()

    return run


def _with_label_error(rows: DataFrame) -> DataFrame:
    """Errors summed over equal labels, nulls together. Labels of very many rows meet theirs by broadcast, the others by shuffle."""
    totals = stage(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    many = (totals.agg(F.sum("_n")).first()[0] or 0) / HEAVY
    same = rows["label"].eqNullSafe(totals["_label"])
    heavy, light = F.broadcast(totals.where(F.col("_n") > many)), totals.where(F.col("_n") <= many)
    out = rows.join(heavy, same).unionByName(rows.join(heavy, same, "left_anti").join(light.hint("shuffle_hash"), same))
    return out.drop("_label", "_n")


def fit(chunks: DataFrame, entries: np.ndarray, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, axes) after ``rounds`` rounds; an entry without points stays as it is."""
    for _ in range(rounds):
        seen = chunks.select("n", "kind", "points", "low", "high", "sums").mapInArrow(_round(entries, dims), "part int, entry int, axis int, total long")
        sums = seen.groupBy("part", "entry", "axis").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()  # a row per number of the codebooks
        total = np.zeros((PARTS, entries.shape[1], dims // PARTS + 1), object)
        for r in sums:
            total[r["part"], r["entry"], r["axis"]] = int(r["total"])
        used = total[:, :, -1] > 0
        entries = entries.copy()
        entries[used] = (total[used][:, :-1] // total[used][:, -1:]).astype(np.int64)
    return entries


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each vector of finite components.

    Rows whose vector is null or holds a null or non-finite component go. Components become floor(4096 x),
    vectors eight parts; shorter vectors than the longest, and lengths that eight does not divide, are as if
    they ended in zeros. Codebooks begin as the parts of the 16 rows of smallest id (rows without an id come
    last, equal ids by their vectors; fewer rows give fewer entries). Repeated rows each count. An empty
    table gives no rows. Components too large for distances in 64 bits (beyond some 10^8 at width 8) are an error.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = vectors.where(F.col(vector).isNotNull() & fine).select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = PARTS * max(1, -(-longest // PARTS))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow().column(0).combine_chunks()
    first = whole_numbers(first.cast(pa.list_(first.type.value_type)), dims)
    entries = first.reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    id_type, label_type = rows.schema["vec_id"].dataType, rows.schema["label"].dataType
    fields = {"vec_id": T.ArrayType(id_type), "label": T.ArrayType(label_type), "n": T.IntegerType(), "kind": T.StringType()} | {c: T.BinaryType() for c in ("order", "points", "low", "high", "sums")}
    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    chunks = stage(rows.mapInArrow(_chunks(dims, to_arrow_schema(schema)), schema), "chunks")
    out = T.StructType([T.StructField("vec_id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    with arrow_rows(vectors.sparkSession, AT_ONCE):
        entries = fit(chunks, entries, dims)
        coded = stage(chunks.mapInArrow(_final(entries, dims, to_arrow_schema(out)), out), "codes")
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest))
