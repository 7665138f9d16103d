"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find grouping.

Plan of ``near_duplicates``:

1. one narrow pass over the texts makes a row per document: size and digest of its set of word
   shingles, its SuperMinHash signature and band keys;
2. documents with equal sets collapse to one representative text, whose digest is the set's node
   (partial aggregation, no pairs): links join sets, so ids may repeat or be missing;
3. in each band bucket all members are linked to the bucket's smallest node, and these star pairs
   are verified on full sets; components of the verified links are found;
4. buckets that still hold several components compare members of *different* components, block by
   block: pairs that their signatures do not rule out are verified on full sets in place, and a link
   joins its components for the rest of the block. So every pair that shares a bucket is either in one
   component already or compared, no bucket is capped, and a block gives fewer links than it has members.

Nothing but a change counter reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import arrow_rows, per_batch, sized, slices, stage

#: Signature slots; the first BANDS * ROWS are dealt into bands. At a similarity of 0.85 a pair shares
#: no bucket with odds of (1 - 0.85 ** 5) ** 20 = 8e-6.
PERMS, BANDS, ROWS = 400, 20, 5
#: The most that these odds may be at any threshold.
MISSED = 9e-6
BLOCK = 512
#: Labels of at most so many nodes (some 100 bytes each in memory) are broadcast; above it their joins shuffle.
ROUND_ROWS = 100_000
#: Elements of a set whose permutations are held at once.
WALK = 8192
#: Bytes of text that are hashed at once.
PART = 2 << 20
_PAIR = "a binary, b binary"
_GOLD = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def bands_for(percent: int, perms: int = PERMS, rows: int = ROWS) -> int:
    """At least BANDS, and so many that a pair at the threshold shares no bucket with odds of MISSED at most."""
    p = (percent / 100) ** rows
    bands = BANDS if p >= 1 else max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-p)))
    if bands * rows > perms:
        raise ValueError(f"{percent} % needs {bands} bands of {rows}, more than {perms} slots")
    return bands


def slack(percent: int, perms: int = PERMS) -> float:
    """Pairs whose signatures agree less than the threshold by this much are not verified: five standard
    deviations of the estimate from ``perms`` slots at the threshold, in whole hundredths."""
    p = percent / 100
    return math.ceil(round(500 * math.sqrt(p * (1 - p) / perms), 6)) / 100


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of a set of distinct 64-bit hashes: m values ``rank << 32 | fraction``.

    Each element walks its own random permutation of the slots; at step j it offers j plus a
    fraction to the slot of that step. All elements take step j together. Step j can never improve
    a slot filled in an earlier step, so the walk stops when all slots are filled. Large sets are
    walked in parts of WALK elements, as the signature of a union is the minimum of signatures.
    """
    if len(elements) > WALK:
        return np.minimum.reduce([superminhash(elements[i : i + WALK], m) for i in range(0, len(elements), WALK)])
    out = np.full(m, _M64, np.uint64)
    perm = None
    for j in range(m):
        x = hashing.mix(elements + np.uint64(_GOLD * (j + 1) & _M64))
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                rows = np.arange(len(elements))
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(out, slot, (x >> np.uint64(32)) | np.uint64(j << 32))
        if int(out.max()) >> 32 <= j:
            break
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` signature values."""
    parts = hashing.mix(signature).reshape(-1, rows)
    keys = np.zeros(len(parts), np.uint64)
    for r in range(rows):
        keys = hashing.mix(keys + parts[:, r] * hashing._COEF[r])
    return hashing.mix(keys + np.arange(len(parts), dtype=np.uint64) * np.uint64(_GOLD))


def _signatures(shingle: int, perms: int, bands: int, rows: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1, PART):
            texts, sizes, digests, sigs, keys = [], [], [], [], []
            for text, s in zip(part.column(1), hashing.shingle_sets(part.column(1), shingle), strict=True):
                known = len(s) > 0
                sig = superminhash(s, perms) if known else None
                texts.append(hashlib.md5(text.as_buffer(), usedforsecurity=False).digest() if known else None)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s, digest_size=16).digest() if known else None)
                sigs.append(hashing.mix(sig).astype(np.uint8).tobytes() if known else None)
                keys.append(band_keys(sig[: bands * rows], rows).view(np.int64) if known else None)
            arrays = [pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "text_key", "n_shingles", "set_key", "sig", "bands"])

    return per_batch(run)


def text_key(text: str = "text") -> Column:
    """The digest that names a text."""
    return F.unhex(F.md5(text))


def signatures(docs: DataFrame, shingle: int = 5, perms: int = PERMS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, sig (a byte per slot) and bands of each row of ``docs``.

    All but doc_id and n_shingles (0) are null for a text that is null or holds no word.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _signatures(shingle, perms, bands, rows), "doc_id long, text_key binary, n_shingles long, set_key binary, sig binary, bands array<long>"
    )


def _sets(shingle: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1, PART):
            data = [s.tobytes() for s in hashing.shingle_sets(part.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["set_id", "elements"])

    return per_batch(run)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted hashes) are alike enough."""
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    """Rows a, b, x, y (their sets): those with 100 * |x & y| >= percent * |x | y|."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, last, x = [], None, None
        for a, xs, ys in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, x = a, np.frombuffer(xs.as_buffer(), np.uint64)
            keep.append(_linked(x, np.frombuffer(ys.as_buffer(), np.uint64), percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return per_batch(run)


def _alike(least: float):
    """Rows a, b, s, t (their signatures): those that agree in ``least`` of their slots, which does not rule out the link."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array((s == t).mean(axis=1) >= least))

    return per_batch(run)


def _size_ok(x: str, y: str, percent: int):
    """A link needs 100 * smaller >= percent * larger, as the intersection is at most the smaller set."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int = 5) -> DataFrame:
    """set_id, elements: the shingle sets of the texts whose keys are in ``ids`` (set_id)."""
    texts = docs.where(F.col("text").isNotNull()).select(text_key().alias("set_id"), "text").join(sized(ids), "set_id", "left_semi")
    return stage(texts.dropDuplicates(["set_id"]).mapInArrow(_sets(shingle), "set_id binary, elements binary"), "sets")


def verified_links(docs: DataFrame, pairs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """Of ``pairs`` (a, b: keys of texts) those whose full shingle sets are alike enough. Sets are made for paired texts only."""
    sets = sets_of(docs, stage(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct(), "pair-texts"), shingle)
    left = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("y"))
    joined = pairs.hint("merge").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(_verify(percent), _PAIR)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a partition: links become one star of the smallest node per component, batch by batch."""
    for batch in batches:
        parent: dict[bytes, bytes] = {}

        def root(v: bytes, parent: dict[bytes, bytes] = parent) -> bytes:
            while (p := parent.setdefault(v, v)) != v:
                parent[v] = v = parent[p]
            return v

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows = [(v, r) for v in parent if (r := root(v)) != v]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b); label is the smallest node reachable.

    Union-find contracts each partition's links first. Then labels fall to the smallest label of
    neighbours, with a pointer jump per round; rounds are written tables and stop when no label
    changed, so their number grows with the logarithm of a component's width. Few labels are broadcast,
    so that a round shuffles once: the driver keeps books on every task.
    """
    forest = stage(links.mapInArrow(_forest, _PAIR).distinct(), "forest")
    edges = forest.select("a", "b").union(forest.select("b", "a"))
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    few = _few(labels)
    while True:
        # Sides that are broadcast are alike but for their names, so that one exchange serves all three joins.
        at, own, far = (F.broadcast(t) if few else t for t in (labels.alias("at"), labels.alias("own"), labels.alias("far")))
        near = edges.join(at, F.col("b") == F.col("at.node")).groupBy("a").agg(F.min("at.label").alias("near"))
        step = near.join(own, F.col("a") == F.col("own.node")).select("a", F.col("own.label").alias("before"), F.least("own.label", "near").alias("low"))
        jumped = step.join(far, F.col("low") == F.col("far.node"), "left")
        new = stage(jumped.select(F.col("a").alias("node"), F.least("low", "far.label").alias("next"), F.col("before").alias("label")), "round")
        changed = not new.where(F.col("next") != F.col("label")).isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _few(labels: DataFrame) -> bool:
    """Whether staged labels are few enough to be broadcast in each round."""
    return labels.limit(ROUND_ROWS + 1).count() <= ROUND_ROWS


def _cross(percent: int, least: float, verify: bool):
    """Compare members of different components, block pair by block pair; rows come sorted by block pair.

    Columns: key, band, x, y (block pair), side (0, 1 or 2 = both), doc, label, n, sig, bands. A pair is
    compared in the first band that it shares. What comes out are the members (key, x, y, doc) of pairs
    that signatures do not rule out, or with ``verify`` and the members' elements the links that join components.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch:
        doc, label = (np.unique(np.array(rows.column(c).to_pylist(), "S16"), return_inverse=True)[1] for c in ("doc", "label"))
        n = rows.column("n").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(doc), -1)
        side = rows.column("side").to_numpy()
        keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
        earlier = keys[:, : rows.column("band")[0].as_py()]
        names, sets = rows.column("doc").combine_chunks(), rows.column("elements").combine_chunks() if verify else None
        elements = lambda i: np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        met = np.zeros(len(doc), bool)
        a, b = [], []
        for i in left:
            j = right[(label[right] != label[i]) & ((side[right] != 2) | (side[i] != 2) | (doc[right] > doc[i]))]
            j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent]
            j = j[~(earlier[j] == earlier[i]).any(axis=1)]
            if not len(j):
                continue
            alike = (sig[j] == sig[i]).mean(axis=1)
            if not verify:
                met[j[alike >= least]] = True
                met[i] |= bool((alike >= least).any())
                continue
            own = elements(i)
            for k in j[np.argsort(-alike, kind="stable")][: int((alike >= least).sum())]:
                if label[k] != label[i] and _linked(own, elements(k), percent):
                    pair = sorted((names[int(i)].as_py(), names[int(k)].as_py()))
                    a.append(pair[0])
                    b.append(pair[1])
                    label[label == label[k]] = label[i]
        if not verify:
            own = rows.select(["key", "x", "y", "doc"]).filter(pa.array(met)).combine_chunks()
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in own.columns], own.schema.names)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = [held.column(c).to_numpy() for c in ("key", "x", "y")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            start = 0
            for cut in cuts:
                yield compare(held.slice(start, cut - start))
                start = cut
            held = held.slice(start)
        if held is not None and held.num_rows:
            yield compare(held)

    return run


def classes(docs: DataFrame, percent: int = 85, shingle: int = 5, perms: int = PERMS, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, group and component_id for each row of ``docs`` (doc_id, text, any others).

    ``group`` names the component of the row's set (null if that is empty), component_id is the smallest
    doc_id of its rows, null if none has one. See ``near_duplicates``.
    """
    bands = bands_for(percent, perms, rows) if bands is None else bands
    least = percent / 100 - slack(percent, perms)
    base = stage(signatures(docs, shingle, perms, bands, rows), "signatures")
    best = F.min_by(F.struct("n_shingles", "sig", "bands"), "text_key")
    reps = base.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("text_key").alias("doc"), F.min("doc_id").alias("low"), F.count("*").alias("rows"), best.alias("s"))
    reps = stage(reps.select("doc", "set_key", "low", "rows", F.col("s.n_shingles").alias("n"), F.col("s.sig").alias("sig"), F.col("s.bands").alias("bands")), "representatives")

    buckets = reps.select(F.posexplode("bands").alias("band", "key"), "doc", "n")
    shared = stage(buckets.groupBy("key").agg(F.count("*").alias("members"), F.min("doc").alias("pivot")).where("members > 1"), "buckets")
    members = stage(buckets.join(sized(shared), "key"), "members")
    sig = reps.select(F.col("doc").alias("id"), "sig", "n", "bands")
    star = members.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    star = stage(star, "star")
    near = (
        star.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("t"), F.col("n").alias("m")), "b")
        .join(sig.select(F.col("id").alias("a"), F.col("sig").alias("s"), "n"), "a")
        .where(_size_ok("n", "m", percent))
        .select("a", "b", "s", "t")
        .mapInArrow(_alike(least), _PAIR)
    )
    links = stage(verified_links(docs, stage(near, "near"), percent, shingle), "links")
    labels = components(links)

    more = _open_links(docs, members, sig, labels, percent, least, shingle)
    if not more.isEmpty():
        labels = components(stage(links.union(more), "all-links"))

    # A set of one row without a link is a group of its own; rows of the others meet their group.
    named = reps.select("doc", "set_key", "low", "rows").join(sized(labels, ROUND_ROWS), F.col("doc") == F.col("node"), "left").where("label IS NOT NULL OR rows > 1")
    named = stage(named.select("set_key", F.coalesce("label", "doc").alias("group"), "low"), "linked-sets")
    lowest = stage(named.groupBy("group").agg(F.min("low").alias("lowest")), "groups")
    named = stage(named.join(sized(lowest), "group").select("set_key", "group", "lowest"), "named-sets")
    out = base.join(sized(named), "set_key", "left")
    alone = F.col("group").isNull()
    return out.select(
        "doc_id", "text_key", "n_shingles", F.coalesce("group", "text_key").alias("group"), F.when(alone, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, perms: int = PERMS, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text, any others).

    Rows are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``shingle``-word
    shingles; component_id is the smallest doc_id reachable, kept marks rows that have it. Texts that
    are null or hold no word have an empty set and are linked with nothing. Rows that repeat a doc_id
    are told apart by their texts, each in the group of its own text. Rows without a doc_id link like
    any other and get their group's smallest doc_id; where no row of a group has one, component_id is
    null and all are kept. An empty table gives no rows. Unless given, bands follow from percent.
    """
    found = classes(docs, percent, shingle, perms, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Of each group of near duplicates one row of ``docs`` (doc_id, text, any others): of those with the
    smallest doc_id that with the smallest digest of its text; if that row repeats, one of its copies.
    Rows whose text is null or holds no word are in no group and all stay.
    """
    found = classes(docs, percent, shingle).where(F.col("group").isNotNull())
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    groups = found.groupBy("group").agg(best.alias("best"), F.count("*").alias("rows")).where("rows > 1")
    groups = stage(groups.select("group", F.col("best.doc_id").alias("kept_id"), F.col("best.text_key").alias("kept_key"), "rows"), "kept-rows")
    met = found.join(sized(groups), "group")
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    met = stage(met.groupBy("doc_id", "text_key").agg(F.first(stays).alias("stays"), F.count("*").alias("n")), "met-rows")
    # Rows travel as one struct, so that no name of theirs can clash.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_key().alias("key"))
    named = lambda t: sized(stage(t.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text")), "rows-by-key"))
    on = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_text"))
    kept = own.join(named(met.where(~F.col("stays"))), on, "left_anti")
    again = met.where(F.col("stays") & (F.col("n") > 1))
    if again.isEmpty():
        return kept.select("row.*")
    again = named(again)
    once = kept.join(again, on, "left_semi").dropDuplicates(["id", "key"])
    return kept.join(again, on, "left_anti").union(once).select("row.*")


def _open_links(docs: DataFrame, members: DataFrame, sig: DataFrame, labels: DataFrame, percent: int, least: float, shingle: int) -> DataFrame:
    """Links that join different components whose members share a bucket.

    The most frequent component of a bucket is its main one; its members are never compared with
    each other. Blocks of at most about BLOCK members are compared, so no task holds a bucket.
    """
    big = members.where("members > 2")
    tagged = big.join(sized(labels, ROUND_ROWS), big["doc"] == labels["node"], "left").select("key", "band", "doc", F.coalesce("label", "doc").alias("label"))
    tagged = stage(tagged, "tagged")
    counts = tagged.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n_all"))
    main = stage(main.where("n_all > n_main"), "open-buckets")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    rows = tagged.join(sized(main), "key").select(
        "key", "band", "doc", "label", (F.col("label") == F.col("main")).alias("is_main"),
        blocks(F.col("n_main")).alias("bm"), blocks(F.col("n_all") - F.col("n_main")).alias("bo"),
    )
    # Blocks of the main component are numbered after the others: bo + i.
    mine = F.pmod(F.xxhash64("doc"), F.when(F.col("is_main"), F.col("bm")).otherwise(F.col("bo"))).cast("int")
    rows = rows.withColumn("mine", mine)
    block = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    mine, bo = F.col("mine"), F.col("bo")
    with_others = F.transform(
        F.sequence(F.lit(0), bo - 1),
        lambda o: block(F.least(o, mine), F.greatest(o, mine), F.when(o == mine, 2).when(o < mine, 1).otherwise(0)),
    )
    with_main = F.transform(F.sequence(F.lit(0), F.col("bm") - 1), lambda i: block(mine, bo + i, F.lit(0)))
    main_side = F.transform(F.sequence(F.lit(0), bo - 1), lambda o: block(o, bo + mine, F.lit(1)))
    rows = rows.withColumn("to", F.explode(F.when(F.col("is_main"), main_side).otherwise(F.concat(with_others, with_main))))
    rows = rows.select("key", "band", F.col("to.x").alias("x"), F.col("to.y").alias("y"), F.col("to.side").cast("int").alias("side"), "doc", "label")
    columns = ["key", "band", "x", "y", "side", "doc", "label", "n", "sig", "bands"]
    rows = stage(rows.join(sig, rows["doc"] == sig["id"]).select(*columns), "block-rows")
    dealt = lambda r: r.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    # Sets are sent to blocks for members of pairs that signatures do not rule out only.
    met = dealt(rows).mapInArrow(_cross(percent, least, False), "key long, x int, y int, doc binary")
    met = stage(met.distinct(), "candidates")
    sets = sets_of(docs, stage(met.select(F.col("doc").alias("set_id")).distinct(), "open-texts"), shingle)
    open_rows = rows.join(sized(met), ["key", "x", "y", "doc"], "left_semi").select(*columns)
    open_rows = open_rows.join(sets, open_rows["doc"] == sets["set_id"]).select(*columns, "elements")
    with arrow_rows(docs.sparkSession, BLOCK):  # rows hold whole sets
        return stage(dealt(open_rows).mapInArrow(_cross(percent, least, True), _PAIR), "more-links")
