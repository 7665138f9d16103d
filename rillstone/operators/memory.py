"""Semantic memory: fragment checks and queries, cosine retrieval, knowledge graphs, retention, consolidation, packing.

First-wins rules follow input order (``idx``). Duplicates are judged among valid rows unless a rule
says otherwise, and filters never run before it, since they would change who wins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import over, running_sum
from ..functions.staging import stage

#: Entries of a context that are summed up in one task.
PER_BUCKET = 1000


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; the shorter is filled with zeros. A zero norm or a value that is not finite gives 0."""
    value = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    norms = _dot(a, a) * _dot(b, b)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | F.isnan(norms) | (norms == float("inf"))
    return F.when((norms > 0) & ~bad, value).otherwise(F.lit(0.0))


def valid_at(as_of: int | None, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Without ``as_of`` only rows without bounds are valid, else those whose half-open span holds it."""
    if as_of is None:
        return F.col(start).isNull() & F.col(end).isNull()
    return (F.col(start).isNull() | (F.col(start) <= as_of)) & (F.col(end).isNull() | (F.col(end) > as_of))


def matches(as_of: int | None = None, least: float | None = None, tags: list[str] | None = None) -> Column:
    out = valid_at(as_of)
    if least is not None:
        out &= F.col("confidence") >= least
    if tags:
        out &= F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return out


def filter_fragments(df: DataFrame, limit: int | None = None, **query) -> DataFrame:
    """Matching fragments, highest confidence first, then latest, then input order."""
    found = df.where(matches(**query)).orderBy(F.desc("confidence"), F.desc("t_ns"), "idx")
    return found if limit is None else found.limit(limit)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def errors(df: DataFrame) -> DataFrame:
    """Fragments with ``errors``: what is wrong with each, empty if nothing."""
    wrong = {
        "id is empty": F.coalesce(F.trim("id") == "", F.lit(True)),
        "confidence is not in [0, 1]": ~F.coalesce(finite(F.col("confidence")) & F.col("confidence").between(0, 1), F.lit(False)),
        "validity is empty": F.coalesce(F.col("valid_from") >= F.col("valid_to"), F.lit(False)),
        "embedding is not finite": F.coalesce(F.exists("embedding", lambda x: ~finite(x)), F.lit(False)),
    }
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(w, F.lit(m)) for m, w in wrong.items()])))


def admitted(scores: dict[str, Column], thresholds: dict[str, float]) -> Column:
    """Every named score is there, finite and at its threshold or above."""
    out = F.lit(True)
    for name, least in thresholds.items():
        score = scores.get(name, F.lit(None).cast("double"))
        out &= F.coalesce(finite(score) & (score >= least), F.lit(False))
    return out


def admitted_3d(persistence: Column, personal: Column, structure: Column, least: float = 0.5, least_personal: float = 0.1, need_structure: bool = True) -> Column:
    out = admitted({"p": persistence, "v": personal}, {"p": least, "v": least_personal})
    return out & F.coalesce(finite(structure) & (structure > 0), F.lit(False)) if need_structure else out


def tenant_shard(tenant: Column, tenants: list[str] | None = None, count: int = 4) -> Column:
    """Listed tenants have their own shard each, others share the next one; without a list the tenant is the key."""
    if not tenants:
        return tenant
    listed = list(dict.fromkeys(tenants))
    own = F.create_map(*[x for i, t in enumerate(listed) for x in (F.lit(t), F.lit(str(i)))])
    return F.coalesce(own[tenant], F.lit(str(len(listed))))


def first_valid(df: DataFrame, key: str = "id", order: str = "idx") -> DataFrame:
    """Fragments with ``errors`` and ``state``: kept, duplicate (a valid row of that id came before) or invalid."""
    rows = df if "errors" in df.columns else errors(df)
    valid = F.size("errors") == 0
    rank = F.row_number().over(over([key, "_valid"], [order]))
    rows = rows.withColumn("_valid", valid).withColumn("_rank", rank)
    return rows.withColumn("state", F.when(~F.col("_valid"), "invalid").when(F.col("_rank") > 1, "duplicate").otherwise("kept")).drop("_valid", "_rank")


def retrieve(df: DataFrame, vector: list[float] | None, limit: int, **query) -> DataFrame:
    """The best fragments for one query vector: validate, first per id, filter, rank by cosine, confidence, time."""
    kept = first_valid(df).where("state = 'kept'").where(matches(**query))
    score = F.lit(0.0) if vector is None else F.when(F.col("embedding").isNull(), 0.0).otherwise(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector)))))
    return kept.withColumn("score", score).orderBy(F.desc("score"), F.desc("confidence"), F.desc("t_ns"), "idx").limit(limit)


def retrieve_all(df: DataFrame, queries: DataFrame, limit: int, shard_rows: int = 16_384, block_rows: int = 2_048) -> DataFrame:
    """The best fragments of each row of ``queries`` (query_id, vector): shards of fragments meet blocks of
    queries as matrices, keep their local best, and those are merged per query. No row pairs are made.

    Shards and blocks have about so many rows, so what meets in one task does not grow with the tables.
    """
    shards, blocks = max(1, -(-df.count() // shard_rows)), max(1, -(-queries.count() // block_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = df.where("embedding is not null").select(deal("idx", shards).alias("shard"), every(blocks).alias("block"), "id", "idx", "confidence", "t_ns", "embedding")
    right = queries.select(every(shards).alias("shard"), deal("query_id", blocks).alias("block"), "query_id", "vector")

    def rank(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": [], "id": [], "idx": [], "confidence": [], "t_ns": [], "score": []})]
        if len(own) and len(asked):
            a, b = (np.stack(x.to_numpy()).astype(float) for x in (own["embedding"], asked["vector"]))
            norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
            scores = np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm > 0)
            for j, q in enumerate(asked["query_id"]):
                some = np.arange(len(own))
                if len(own) > limit:  # all that are no worse than the limit-th score
                    some = np.flatnonzero(scores[:, j] >= -np.partition(-scores[:, j], limit - 1)[limit - 1])
                near = own.iloc[some]
                best = some[np.lexsort((near["idx"], -near["t_ns"], -near["confidence"], -scores[some, j]))[:limit]]
                parts.append(own.iloc[best][["id", "idx", "confidence", "t_ns"]].assign(query_id=q, score=scores[best, j]))
        return pd.concat(parts)[["query_id", "id", "idx", "confidence", "t_ns", "score"]]

    local = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(rank, "query_id long, id string, idx long, confidence double, t_ns long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("confidence"), F.desc("t_ns"), "idx")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def knowledge_graph(assertions: DataFrame, predicates: list[str]) -> dict[str, DataFrame]:
    """Tables of the first valid assertion per id: rejected, entities, relations, topics.

    Columns of ``assertions``: idx, id, subject_id, predicate, object_entity_id, object_literal.
    Lists are built last, from distinct rows, so a hub meets partial aggregation first.
    """
    policy = F.col("predicate").isin(predicates)
    shaped = (F.col("id") != "") & (F.col("subject_id") != "") & (F.col("object_entity_id").isNull() != F.col("object_literal").isNull())
    rows = assertions.withColumn("_valid", F.coalesce(policy & shaped, F.lit(False)))
    rank = F.row_number().over(over(["id", "_valid"], ["idx"]))
    kept = rows.where("_valid").withColumn("_r", rank).where("_r = 1").drop("_valid", "_r")  # rows beyond the first go before the shuffle
    rows = rows.withColumn("reason", F.when(~F.col("_valid"), F.when(~policy, "predicate").otherwise("malformed")).when(rank > 1, "duplicate")).drop("_valid")
    roles = kept.select("id", F.explode(F.array_compact(F.array(
        F.struct(F.lit("subject").alias("role"), F.col("subject_id").alias("entity")),
        F.when(F.col("object_entity_id").isNotNull(), F.struct(F.lit("object").alias("role"), F.col("object_entity_id").alias("entity"))),
    ))).alias("r")).select("id", "r.role", "r.entity")
    own = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("id"))))
    entities = roles.groupBy("entity").agg(own("subject").alias("as_subject"), own("object").alias("as_object"))
    relations = kept.where("object_entity_id is not null").select("id", "subject_id", "predicate", "object_entity_id")
    named = kept.select("predicate", F.posexplode(F.array_compact(F.array("subject_id", "object_entity_id"))).alias("place", "entity"))  # the subject is at 0
    named = named.groupBy("predicate", "entity").agg(F.count_if(F.col("place") == 0).alias("n"))
    topics = named.groupBy("predicate").agg(F.sum("n").alias("assertions"), F.count("*").alias("entities"))
    return {"rejected": rows.where("reason is not null"), "entities": entities, "relations": relations, "topics": topics}


def first_records(records: DataFrame) -> DataFrame:
    """Valid records (errors empty): the first per record id, then of those the first per fragment id.

    A row that loses on its fragment still holds its record id.
    """
    valid = records.where(F.size("errors") == 0)
    by_record = valid.withColumn("_r", F.row_number().over(over(["record_id"], ["idx"]))).where("_r = 1")
    return by_record.withColumn("_r", F.row_number().over(over(["fragment_id"], ["idx"]))).where("_r = 1").drop("_r")


def kg_projection(records: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts (idx, id, record_id, fragment_id) whose record and fragment, where named, exist and belong
    together; the first valid one per id. Invalid drafts do not block a later valid id."""
    by_record = records.select("record_id", F.col("fragment_id").alias("_own"))
    by_fragment = records.select(F.col("fragment_id"), F.col("record_id").alias("_holder"))
    rows = drafts.join(by_record, "record_id", "left").join(by_fragment, "fragment_id", "left")
    record_ok = F.col("record_id").isNull() | F.col("_own").isNotNull()
    fragment_ok = F.col("fragment_id").isNull() | F.col("_holder").isNotNull()
    together = F.col("record_id").isNull() | F.col("fragment_id").isNull() | (F.col("_own") == F.col("fragment_id"))
    named = F.col("record_id").isNotNull() | F.col("fragment_id").isNotNull()
    valid = rows.where(named & record_ok & fragment_ok & together).select(*drafts.columns)
    return valid.withColumn("_r", F.row_number().over(over(["id"], ["idx"]))).where("_r = 1").drop("_r")


def retention(records: DataFrame, commands: DataFrame) -> DataFrame:
    """Records with ``state`` after their last archive or restore, and whether consolidation was asked for.

    The first command of an id on a known record counts; later ones repeat it and are ignored.
    """
    known = commands.join(records.select("record_id"), "record_id", "left_semi")
    once = known.groupBy("id").agg(F.min_by(F.struct("idx", "record_id", "kind"), "idx").alias("c")).select("c.*")
    last = once.groupBy("record_id").agg(
        F.max_by("kind", F.when(F.col("kind").isin("archive", "restore"), F.col("idx"))).alias("last"),
        F.max((F.col("kind") == "request_consolidation").cast("int")).alias("asked"),
    )
    state = F.when(F.col("last") == "archive", "archived").otherwise("active")
    return records.join(last, "record_id", "left").withColumn("state", state).withColumn("consolidate", F.coalesce(F.col("asked") == 1, F.lit(False))).drop("last", "asked")


def consolidation(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """First occurrence of each outcome id, valid or not, matched to the last request of its request id.

    status: proposed, failed, or unknown-request.
    """
    once = outcomes.groupBy("id").agg(F.min_by(F.struct(*outcomes.columns), "idx").alias("o")).select("o.*")
    last = requests.groupBy("request_id").agg(F.max_by("record_id", "idx").alias("record_id"), F.lit(True).alias("_known"))
    out = once.join(last, "request_id", "left")
    return out.withColumn("status", F.when(F.col("_known").isNull(), "unknown-request").otherwise(F.col("state"))).drop("_known")


def pack_context(entries: DataFrame, texts: DataFrame, most: int | None, separator: str = "\n\n", with_ids: bool = False, keys: list[str] | None = None) -> DataFrame:
    """One text per context (``keys``) of its ranked entries (rank, fragment_id), up to ``most`` code points.

    Packing stops at the first part that does not fit. The first text per fragment counts. missing
    counts entries without a text that come before the stop; truncated tells that parts were left out.
    """
    if not keys:
        return pack_context(entries.withColumn("_all", F.lit(0)), texts, most, separator, with_ids, ["_all"]).drop("_all")
    first = texts.groupBy("fragment_id").agg(F.min_by(F.struct(F.col("idx").alias("_idx"), F.length("text").alias("_size")), "idx").alias("_t"))
    rows = entries.join(first, "fragment_id", "left").select(*keys, "rank", "fragment_id", "_t._idx", "_t._size")
    # Lengths alone tell where each context stops; only texts before that are looked up.
    whole = F.col("_size") + len(separator) + (F.length("fragment_id") + 3 if with_ids else F.lit(0))
    rows = stage(running_sum(stage(rows, "entries"), F.coalesce(whole, F.lit(0)), ["rank"], keys, F.floor(F.col("rank") / PER_BUCKET), "_total"), "entry-sizes")
    past = F.lit(False) if most is None else F.coalesce(F.col("_total") - len(separator) > most, F.lit(False))
    stops = rows.groupBy(*keys).agg(F.min(F.when(past, F.col("rank"))).alias("_stop"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    within = rows.join(stops, same(rows, stops)).select(rows["*"], "_stop").where("_stop IS NULL OR rank < _stop")
    counts = within.groupBy(*keys).agg(F.count(F.when(F.col("_size").isNull(), 1)).alias("missing"))
    chosen = stage(within.where("_size IS NOT NULL").select(*keys, "rank", "fragment_id", "_idx"), "chosen-entries")
    found = chosen.join(texts.select("fragment_id", F.col("idx").alias("_idx"), "text"), ["fragment_id", "_idx"]).dropDuplicates([*keys, "rank"])
    part = F.concat(F.lit("["), "fragment_id", F.lit("] "), "text") if with_ids else F.col("text")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda s: s["part"])
    texts_of = found.groupBy(*keys).agg(F.array_join(lists, separator).alias("text"))
    out = stops.join(texts_of, same(stops, texts_of), "left").select(stops["*"], "text")
    out = out.join(counts, same(out, counts), "left").select(out["*"], "missing")
    return out.select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("missing", F.lit(0)).alias("missing"), F.col("_stop").isNotNull().alias("truncated"))


def record_frames(records: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """A replaceAll frame per key: its records, in input order, as one JSON array under the frame's seq."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "record_id", "fragment_id"))), lambda r: r))
    return records.groupBy(*keys, seq.alias("seq")).agg(body.alias("records"))


def load_records(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The records of each key's last frame."""
    last = frames.groupBy(*keys).agg(F.max_by("records", "seq").alias("records"), F.max("seq").alias("cursor"))
    rows = F.from_json("records", "array<struct<idx: bigint, record_id: string, fragment_id: string>>")
    return last.select(*keys, "cursor", F.explode(rows).alias("r")).select(*keys, "cursor", "r.*")
