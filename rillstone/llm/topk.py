"""Exact top-k inner products by a KD-tree per shard.

Vectors are dealt into shards by hash. A KD-tree is built once per shard by median splits and kept as
the shard's rows in tree order, as the number of rows gives the splits; tight bounding boxes follow from the rows.
A query goes through a tree best first, from the root by the largest inner product a box could hold, and
stops when no box can beat its kth score. That kth score is propagated: queries visit one shard, then
seven more, then 56 and so on, and enter each round with the kth score of all rounds before. Queries are
streamed past one tree at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, release, stage

#: Rows of a shard and of a leaf; shards of a round for each shard of the rounds before; queries that meet a tree at once.
SHARD, LEAF, WIDER, RUN = 16384, 128, 8, 512
_RESULT = "query_id long, vec_id long, score long"
_MOST = 2**63 - 1


def _quantised(scale: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = v.values
            if i is None or values is None or values.null_count:
                continue
            with np.errstate(over="ignore"):
                x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                ids.append(i)
                out.append(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return per_batch(run)


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector (floor(scale * x) as float64 bytes) of the usable rows of ``vectors`` (vec_id, embedding)."""
    return vectors.select("vec_id", "embedding").mapInArrow(_quantised(scale), "vec_id long, vector binary")


def _matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    width = max([width, *map(len, rows)])
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), "<f8").reshape(len(rows), width // 8)


def layout(n: int, leaf: int = LEAF) -> np.ndarray:
    """The nodes of a tree of ``n`` rows, parents first: first row, end, left and right node (0 for a leaf)."""
    nodes = [[0, n, 0, 0]]
    for node in nodes:
        lo, hi = node[:2]
        if hi - lo > leaf:
            mid = lo + (hi - lo) // 2
            node[2:] = len(nodes), len(nodes) + 1
            nodes += [[lo, mid, 0, 0], [mid, hi, 0, 0]]
    return np.array(nodes, np.int64)


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in tree order: each node is split at the median of its widest axis."""
    order = np.arange(len(points))
    for lo, hi, left, _ in layout(len(points), leaf).tolist():
        if left:
            own = points[order[lo:hi]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], (hi - lo) // 2, kind="introselect")]
    return order


class Tree:
    """A KD-tree over rows in tree order, with the tight box of each node."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids, self.nodes = points, ids, layout(len(points), leaf)
        self.low, self.high = (np.zeros((len(self.nodes), points.shape[1])) for _ in range(2))
        for i in range(len(self.nodes) - 1, -1, -1):
            lo, hi, left, right = self.nodes[i]
            if left:
                self.low[i], self.high[i] = np.minimum(self.low[left], self.low[right]), np.maximum(self.high[left], self.high[right])
            else:
                self.low[i], self.high[i] = points[lo:hi].min(axis=0), points[lo:hi].max(axis=0)
        self.most = float(np.maximum(-self.low[0], self.high[0]).max(initial=0.0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query the largest inner product each node's box could hold, rounded up where floats are not exact."""
        out = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        return out if self.exact(queries) else out + np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).T * 2.0**-40

    def exact(self, queries: np.ndarray) -> bool:
        """Whether all products and their sums are exact in float64."""
        return self.most * float(np.abs(queries).max(initial=0)) * max(queries.shape[1], 1) < 2.0**53

    def products(self, lo: int, hi: int, query: np.ndarray, exact: bool) -> np.ndarray:
        """Exact inner products of rows, as int64; those beyond its range count as its ends."""
        if exact:
            return (self.points[lo:hi] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([max(-_MOST, min(_MOST, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in self.points[lo:hi].tolist()], np.int64)


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its best rows here that can be among its k best anywhere.

    Rows below ``kth`` are out; equal scores stay, since a smaller id wins a tie.
    """
    nodes, exact = tree.nodes.tolist(), tree.exact(queries)
    for query, own, limit, bounds in zip(queries, query_ids.tolist(), kth.tolist(), tree.bounds(queries).tolist(), strict=True):
        got, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        todo = [(-bounds[0], 0)]
        while todo and -todo[0][0] >= limit:
            lo, hi, left, right = nodes[heapq.heappop(todo)[1]]
            if left:
                for child in (left, right):
                    if bounds[child] >= limit:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            product = tree.products(lo, hi, query, exact)
            good = np.flatnonzero((product >= limit) & (tree.ids[lo:hi] != own))
            if len(good):
                got, scores = np.concatenate([got, tree.ids[lo:hi][good]]), np.concatenate([scores, product[good]])
                if len(got) > k:
                    best = np.lexsort((got, -scores))[:k]
                    got, scores = got[best], scores[best]
                if len(got) == k:
                    limit = max(limit, int(scores.min()))
        yield own, got, scores


_TREE = "shard int, kind int, at int, id long, vector binary, kth long"


def _plant(rows: pa.Table) -> pa.Table:
    """A shard's rows in tree order."""
    order = pa.array(tree_order(_matrix(rows.column("vector").to_pylist())))
    own = rows.take(order)
    n = own.num_rows
    out = [own.column("shard"), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), own.column("vec_id"), own.column("vector"), pa.nulls(n, pa.int64())]
    release()
    return pa.table(out, ["shard", "kind", "at", "id", "vector", "kth"])


def _ask(k: int):
    """Rows come by shard, first its tree's in order, then queries."""

    def found(tree: Tree, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, queries.num_rows, RUN):
            part = queries.slice(at, RUN)
            width = tree.points.shape[1]
            rows = [v[: 8 * width] for v in part.column("vector").to_pylist()]  # what is longer than all points meets zeros
            kth = part.column("kth").fill_null(-_MOST).to_numpy()
            out = [(np.full(len(got), own), got, scores) for own, got, scores in search(tree, _matrix(rows, 8 * width), part.column("id").to_numpy(), kth, k)]
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]), pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                if hi == lo:
                    continue
                if keys[lo] // 2 != shard:
                    shard, held, tree = keys[lo] // 2, [], None
                if keys[lo] % 2 == 0:
                    held.append(part)
                    continue
                if tree is None and held:
                    rows = pa.concat_tables(held)
                    tree, held = Tree(_matrix(rows.column("vector").to_pylist()), rows.column("id").to_numpy()), []
                if tree is not None:
                    yield from found(tree, part)
            release()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = SHARD, wider: int = WIDER) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query, all if fewer.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all other rows. Ties go to the
    smaller vec_id. Vectors that are null or hold a null or non-finite component (before or after scaling)
    take no part, nor do rows without an id; vectors of other lengths count as filled up with zeros. Of
    rows that repeat a vec_id all are candidates, and each as a query gives the same answer, once. Scores
    are exact; one beyond 64 bits counts as the end of that range. An empty table gives no rows.
    """
    points = stage(quantise(vectors, scale), "quantised")
    shards = max(1, -(-points.count() // shard))
    deal = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(shards)).cast("int")
    # Rows that are equal would share a hash of content; the hash of the id deals them out.
    trees = stage(points.withColumn("shard", deal("vec_id", 0)).groupBy("shard").applyInArrow(_plant, _TREE), "trees")
    queries = points.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("id")).agg(F.min("vector").alias("vector"))
    queries = stage(queries.withColumn("first", deal("id", 1)), "queries")
    best, seen = None, 0
    while seen < shards:
        upto = min(shards, max(1, seen * wider))
        asked = queries.withColumn("kth", F.lit(None).cast("long"))
        if best is not None:  # the kth best score so far; a query with fewer has no bound yet
            kth = best.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("low"), F.count("*").alias("n"))
            asked = queries.join(kth.select("id", F.when(F.col("n") >= k, F.col("low")).alias("kth")), "id", "left")
        to = F.explode(F.sequence(F.lit(seen), F.lit(upto - 1))).alias("step")
        asked = asked.select(to, "first", "id", "vector", "kth").select(
            ((F.col("first") + F.col("step")) % shards).cast("int").alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("at"), "id", "vector", "kth"
        )
        rows = trees.union(asked).repartition("shard").sortWithinPartitions("shard", "kind", "at")
        found = rows.mapInArrow(_ask(k), _RESULT)
        found = found if best is None else best.union(found)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = stage(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "best")
        seen = upto
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")
