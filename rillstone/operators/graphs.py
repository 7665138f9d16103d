"""Queries on node and edge tables: reachability, shortest paths, islands, diffs, summaries.

Loops run one join per hop on a frontier; each round is a written table in the shared folder, so the
plan does not grow and lost executors cost one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage


def written(df: DataFrame) -> DataFrame:
    return stage(df, "round")


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    down = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    up = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"down": down, "up": up, "both": down.union(up)}[direction].where("a <> b").distinct()


def reachable(edges: DataFrame, sources: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """source, node, depth of all nodes reachable from each source (column ``node``), sources excluded.

    All sources go at once. The loop ends with an empty frontier.
    """
    steps = written(_directed(edges, direction))
    seen = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        following = frontier.join(steps, frontier["node"] == steps["a"]).select("source", F.col("b").alias("node")).distinct()
        new = written(following.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, frontier = written(seen.union(new)), new
    return seen.where("depth > 0")


def cut_short(edges: DataFrame, sources: DataFrame, direction: str = "down", max_depth: int = 20) -> DataFrame:
    """Sources (``source``) for which ``reachable`` with ``max_depth`` leaves nodes out: one step more finds new ones."""
    more = reachable(edges, sources, direction, max_depth + 1)
    return more.where(F.col("depth") > max_depth).select("source").distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, direction: str = "down", max_depth: int = 20, nodes: DataFrame | None = None) -> DataFrame:
    """source, target, path and reason of each pair: the shortest path, of equal ones the smallest by node ids.

    Reasons, pair by pair: ok; no such source or no such target, if ``nodes`` (id) are given and lack it; no
    path (the source's frontier ran out) or depth exceeded (it had not yet).
    """
    steps = written(_directed(edges, direction))
    open_pairs = pairs.select("source", "target").distinct()
    best = written(open_pairs.select("source", F.col("source").alias("node"), F.array("source").alias("path")).distinct())
    frontier = best
    for _ in range(max_depth + 1):
        following = frontier.join(steps, frontier["node"] == steps["a"]).select("source", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        new = following.groupBy("source", "node").agg(F.min("path").alias("path")).join(best.select("source", "node"), ["source", "node"], "left_anti")
        frontier = written(new.select("source", "node", "path"))
        if frontier.isEmpty():
            break
        best = written(best.union(frontier))
    # The step beyond max_depth tells which sources had more to see; its paths do not count.
    within = best.where(F.size("path") <= max_depth + 1)
    going = best.where(F.size("path") > max_depth + 1).select("source").distinct().withColumn("_going", F.lit(True))
    found = open_pairs.join(within.withColumnRenamed("node", "target"), ["source", "target"], "left").join(going, "source", "left")
    reason = F.when(F.col("path").isNotNull(), "ok")
    if nodes is not None:
        ids = nodes.select("id").distinct()
        found = found.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
        reason = F.when(F.col("_s").isNull(), "no such source").when(F.col("_t").isNull(), "no such target").when(F.col("path").isNotNull(), "ok")
    return found.select("source", "target", "path", reason.when(F.col("_going"), "depth exceeded").otherwise("no path").alias("reason"))


def cycles(edges: DataFrame, sources: DataFrame, max_depth: int = 20) -> DataFrame:
    """source and path of the shortest way from each source (column ``node``) along edges back to itself, where there is one."""
    steps = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    loops = steps.where("a = b").join(sources.select(F.col("node").alias("a")).distinct(), "a").select(F.col("a").alias("source"), F.array("a", "b").alias("path"))
    ends = sources.select(F.col("node").alias("source")).distinct().join(steps, F.col("source") == F.col("b")).where("a <> b").select("source", F.col("a").alias("target"))
    there = shortest_paths(edges, ends, "down", max_depth - 1).where("reason = 'ok'").select("source", F.concat("path", F.array("source")).alias("path"))
    best = there.union(loops).groupBy("source").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p"))
    return best.select("source", "p.path")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node and component, the smallest node reachable, of every end of an edge (a, b), whatever its direction.

    Each round hangs larger neighbours of a node on its smallest one, then smaller ones, until nothing changes: ways
    get half as long each time, so rounds follow the logarithm of a component's width. A round is a written table.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = written(small.where("u <> v").distinct())
        # A star's centre never is an end that hangs on another: then every node is one step from its component.
        done = new.join(new.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        if done and new.select("u").distinct().count() == new.count():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        links = new
    raise RuntimeError("components did not settle")


def islands(nodes: DataFrame, edges: DataFrame, internal: str = "__internal__/") -> DataFrame:
    """Nodes (id) with no edge in or out, internal ones excluded."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.where(~F.col("id").startswith(internal)).join(ends, "id", "left_anti")


def diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """change, a, b: nodes (id, meta) added, removed or changed, edges (src, dst) added or removed."""
    n0, n1 = (n.select("id", F.col("meta").cast("string").alias("meta"), F.lit(True).alias("here")) for n in (before[0], after[0]))
    n = n0.alias("x").join(n1.alias("y"), "id", "full")
    node = F.when(F.col("x.here").isNull(), "node added").when(F.col("y.here").isNull(), "node removed").when(~F.col("x.meta").eqNullSafe(F.col("y.meta")), "meta changed")
    out = n.select(node.alias("change"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    e0, e1 = (e.select("src", "dst", F.lit(True).alias("here")).distinct() for e in (before[1], after[1]))
    e = e0.alias("x").join(e1.alias("y"), ["src", "dst"], "full")
    edge = F.when(F.col("x.here").isNull(), "edge added").when(F.col("y.here").isNull(), "edge removed")
    return out.union(e.select(edge.alias("change"), F.col("src").alias("a"), F.col("dst").alias("b"))).where("change is not null")


def subgraph_paths(subgraphs: DataFrame, nodes: DataFrame, rounds: int = 64) -> DataFrame:
    """subgraph and path of each subgraph (subgraph, parent, idx, name) of a snapshot that hangs on its root (parent null).

    Its path is what stands before the last ``::`` in the id of its first node (subgraph, n, id) that has one, else its
    name, else its place ``idx`` among its siblings behind its parent's path. A round per level of nesting, each a written table.
    """
    before = F.expr("left(id, length(id) - 2 - length(substring_index(id, '::', -1)))")
    prefix = nodes.where("subgraph IS NOT NULL AND instr(id, '::') > 0").groupBy("subgraph").agg(F.min_by(before, "n").alias("_prefix"))
    rows = written(subgraphs.join(prefix, "subgraph", "left").select("subgraph", "parent", F.col("idx").cast("string").alias("idx"), F.coalesce("_prefix", "name").alias("own")))
    level = written(rows.where("parent IS NULL").select("subgraph", F.coalesce("own", "idx").alias("path")))
    found = [level]
    for _ in range(rounds):
        up = level.select(F.col("subgraph").alias("parent"), "path")
        level = written(rows.join(up, "parent").select("subgraph", F.coalesce("own", F.concat("path", F.lit("/"), "idx")).alias("path")))
        if level.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(level)
    raise ValueError("subgraphs are nested too deep, or in a circle")


def flattened(nodes: DataFrame, edges: DataFrame, subgraphs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, meta), edges (src, dst) and subgraph paths of a nested snapshot, whatever the depth they stand at.

    Rows have ``subgraph``, null at the root; those of a subgraph that hangs on no root are left out. Ids are of the whole
    snapshot; an id that comes again counts once, with its greatest meta.
    """
    paths = stage(subgraph_paths(subgraphs, nodes), "subgraph-paths")
    there = lambda rows: rows.where("subgraph IS NULL").unionByName(rows.join(paths.select("subgraph"), "subgraph", "left_semi"))
    flat = there(nodes).groupBy("id").agg(F.max(F.col("meta").cast("string")).alias("meta"))
    return flat, there(edges).select("src", "dst").distinct(), paths.select("path")


def nested_diff(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The rows of ``diff`` over nested snapshots (nodes, edges, subgraphs), see ``flattened``, and subgraphs mounted and unmounted by path."""
    (n0, e0, p0), (n1, e1, p1) = (flattened(*x) for x in (before, after))
    moved = lambda a, b, change: a.distinct().join(b, "path", "left_anti").select(F.lit(change).alias("change"), F.col("path").alias("a"), F.lit(None).cast("string").alias("b"))
    return diff((n0, e0), (n1, e1)).union(moved(p1, p0, "subgraph mounted")).union(moved(p0, p1, "subgraph unmounted"))


def profile(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Counts of nodes (path, status, invokes) by status, and the hot ones: most invokes first, then path."""
    counts = nodes.groupBy("status").agg(F.count("*").alias("n"))
    return counts, nodes.orderBy(F.desc("invokes"), "path").limit(limit)
