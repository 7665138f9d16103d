"""A cache of several tiers over time: lookups see the writes, removals and promotions before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import keyed_fold
from ..functions.order import number, running_max
from ..functions.staging import stage

#: Operations whose order is settled in one task.
PER_BUCKET = 1000
#: The tier of a value that the origin gave.
ORIGIN = -1


def targets(policy: str, source: int) -> list[int]:
    """Tiers that a value found at ``source`` is copied to: all earlier ones, none, or those of a list of numbers that are earlier."""
    if policy == "all":
        return list(range(source))
    return [] if policy in ("none", "") else sorted({int(t) for t in policy.split(",") if 0 <= int(t) < source})


def _ordered(ops: DataFrame, promote: str, per_bucket: int) -> DataFrame:
    """Operations with the policy of their time; a policy itself looks up the key that was looked up last, if there was one.
    Lookups are numbered from 1 in ``request_seq``."""
    bucket = F.floor(F.col("ord") / per_bucket)
    looks = F.col("kind").isin("request", "invalidate")
    asof = {"_set": F.when(F.col("kind") == "policy", F.struct("ord", "policy")), "_key": F.when(looks, F.struct("ord", "key"))}
    rows = running_max(stage(ops, "cache-operations"), asof, ["ord"], bucket=bucket)
    rows = rows.withColumns({
        "policy": F.coalesce("_set.policy", F.lit(promote)), "key": F.when(F.col("kind") == "policy", F.col("_key.key")).otherwise(F.col("key")),
        "kind": F.when(F.col("kind") == "policy", "request").otherwise(F.col("kind")),
    }).where("key IS NOT NULL").drop("_set", "_key")
    rows = stage(rows, "cache-rows")
    lookups = number(rows.where(looks).select("ord"), ["ord"], bucket=bucket, name="request_seq")
    return rows.join(lookups.withColumn("request_seq", F.col("request_seq").cast("long")), "ord", "left")


def cache_events(ops: DataFrame, tiers: int, promote: str = "none", per_bucket: int = PER_BUCKET) -> DataFrame:
    """What a cache of ``tiers`` tiers says, in one order of ``ord``: rows of ord, n, key, request_seq, event, outcome, tier and value.

    ``ops`` have ord, kind, key, tier, value, loaded and policy: request and invalidate look a key up (``loaded`` is what the
    origin would give, null if nothing), put and remove write one tier from outside, policy sets where found values are
    copied to (none, all, or tiers as ``0,2``) and looks the last key up again. A lookup asks tier after tier up
    to the first that has the key, then the origin (tier -1). Its events, numbered by n: request or
    invalidate, a lookup per tier asked (hit or miss), a promotion per copy, and fill (hit or miss). Keys are
    independent but for policies and numbers, so each is one stream of operations with a value per tier as its state.
    """
    value = ops.schema["value"].dataType.simpleString()

    def step(held, r):
        if r.kind in ("put", "remove"):
            if r.tier is not None and 0 <= r.tier < tiers:
                held[r.tier] = r.value if r.kind == "put" else None
            return held, []
        made = [(r.kind, None, None, None)]
        tier = next((t for t, v in enumerate(held) if v is not None), None)
        made += [("lookup", "miss", t, None) for t in range(tiers if tier is None else tier)]
        found = r.loaded if tier is None else held[tier]
        tier = ORIGIN if tier is None else tier
        made.append(("lookup", "miss" if found is None else "hit", tier, found))
        if found is not None:
            for t in targets(r.policy, tiers if tier == ORIGIN else tier):
                held[t] = found
                made.append(("promotion", "ok", t, found))
        made.append(("fill", "miss" if found is None else "hit", None if found is None else tier, found))
        return held, [(r.ord, n, r.key, r.request_seq, *m) for n, m in enumerate(made)]

    rows = _ordered(ops, promote, per_bucket)
    kinds = f"ord long, n long, key {ops.schema['key'].dataType.simpleString()}, request_seq long, event string, outcome string, tier long, value {value}"
    return keyed_fold(rows, ["key"], ["ord"], step, lambda: [None] * tiers, kinds)


def status(events: DataFrame) -> DataFrame:
    """Per lookup one row: its outcome, the tier that answered and the number of tiers that were asked and copied to."""
    count = lambda kind: F.count(F.when(F.col("event") == kind, 1))
    fill = F.max(F.when(F.col("event") == "fill", F.struct("outcome", "tier", "value"))).alias("_f")
    rows = events.groupBy("key", "request_seq").agg(fill, count("lookup").alias("asked"), count("promotion").alias("promoted"))
    return rows.select("key", "request_seq", "_f.outcome", "_f.tier", "_f.value", "asked", "promoted")
