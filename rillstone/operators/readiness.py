"""Scheduled readiness: which schedules are pending, ready or overdue, by the clock rows that made them so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import number, over, running_max, running_sum
from ..functions.staging import stage


def first_schedules(schedules: DataFrame) -> DataFrame:
    """Schedules (ord, schedule_id, ready_at_ms, deadline_ms, any others) with ``state``: kept, replay of an
    identical row, conflict with a different one before, or malformed."""
    blank = F.coalesce(F.trim("schedule_id") == "", F.lit(True)) | F.col("ready_at_ms").isNull() | F.coalesce(F.col("deadline_ms") < F.col("ready_at_ms"), F.lit(False))
    rows = schedules.withColumn("_bad", blank)
    body = F.to_json(F.struct(*[F.col(c) for c in schedules.columns if c != "ord"]), {"ignoreNullFields": "false"})
    w = over(["schedule_id", "_bad"], ["ord"])
    rows = rows.withColumn("_body", body).withColumn("_rank", F.row_number().over(w)).withColumn("_first", F.first("_body").over(w))
    state = F.when(F.col("_bad"), "malformed").when(F.col("_rank") == 1, "kept").when(F.col("_body") == F.col("_first"), "replay").otherwise("conflict")
    return rows.withColumn("state", state).drop("_bad", "_body", "_rank", "_first")


#: Rows, by ord, and milliseconds of the clock that are looked through in one task; copies of a tick that schedules meet.
PER_BUCKET, SLOT, SALTS = 1000, 3_600_000, 16


def clock_states(clocks: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Clock rows (ord, now_ms) with rollback: the clock was later before. Such rows are ignored."""
    rows = running_max(clocks, {"_latest": F.col("now_ms")}, ["ord"], bucket=F.floor(F.col("ord") / per_bucket))
    return rows.withColumn("rollback", F.col("now_ms") < F.col("_latest")).drop("_latest")


def project(schedules: DataFrame, clocks: DataFrame, per_bucket: int = PER_BUCKET, slot: int = SLOT) -> DataFrame:
    """schedule_id, fact and now_ms: pending once if a schedule was ever seen before its time, ready and
    overdue at the first clock row, after the schedule came, at or past its time and past its deadline.

    Accepted ticks grow in ord and in time alike, so with numbers from 1 the first fitting one is the later of
    two: the first after the schedule and the first at its threshold. Both come from counts of ticks before, by ord
    and by time, which are running counts over ticks and schedules in buckets; the tick is then joined by number.
    """
    by_ord = F.floor(F.col("ord") / per_bucket)
    kept = stage(first_schedules(schedules).where("state = 'kept'").select("schedule_id", "ord", "ready_at_ms", "deadline_ms"), "schedules")
    ticks = stage(clock_states(stage(clocks, "clocks"), per_bucket).where("not rollback"), "accepted-ticks")
    ticks = stage(number(ticks, ["ord"], bucket=by_ord, name="tick").select("ord", "now_ms", F.col("tick").cast("long").alias("tick")), "ticks")
    both = stage(kept.unionByName(ticks, allowMissingColumns=True), "ticks-and-schedules")
    seen = running_max(both, {"_last": F.struct("tick", "now_ms")}, ["ord", "tick"], bucket=by_ord).where("schedule_id IS NOT NULL")
    latest = F.when(F.col("_last.tick").isNotNull(), F.col("_last.now_ms"))
    together = ticks.groupBy("ord").agg(F.count("*").alias("_same"))  # ticks that come with a schedule are neither before nor after it
    passed = F.coalesce("_last.tick", F.lit(0)) + F.coalesce("_same", F.lit(0))
    seen = stage(seen.join(together, "ord", "left").select("schedule_id", "ready_at_ms", "deadline_ms", latest.alias("latest"), passed.alias("passed")), "schedules-as-of")
    wants = F.array(
        F.struct(F.lit("ready").alias("fact"), F.col("ready_at_ms").alias("at")),
        F.when(F.col("deadline_ms").isNotNull(), F.struct(F.lit("overdue").alias("fact"), (F.greatest("ready_at_ms", "deadline_ms") + 1).alias("at"))),
    )
    asks = seen.select("schedule_id", "latest", "passed", F.explode(F.array_compact(wants)).alias("w")).select("schedule_id", "latest", "passed", "w.fact", "w.at", F.lit(0).alias("n"))
    both = stage(asks.unionByName(ticks.select(F.col("now_ms").alias("at"), F.lit(1).alias("n")), allowMissingColumns=True), "ticks-and-thresholds")
    counted = running_sum(both, F.col("n"), ["at", "n"], bucket=F.floor(F.col("at") / slot), name="before").where("n = 0")
    salt = F.pmod(F.xxhash64("schedule_id"), F.lit(SALTS))  # any number of schedules may wait for one tick
    counted = counted.withColumns({"tick": F.greatest("before", "passed") + 1, "salt": salt})
    spread = ticks.select("tick", F.col("now_ms").alias("then"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = counted.join(spread, ["tick", "salt"], "left").select("schedule_id", "fact", F.when(F.col("latest") >= F.col("at"), F.col("latest")).otherwise(F.col("then")).alias("now_ms"))
    pending = seen.where(F.coalesce(F.col("latest") < F.col("ready_at_ms"), F.lit(True))).select("schedule_id", F.lit("pending").alias("fact"), F.col("latest").alias("now_ms"))
    return pending.union(found.where("now_ms IS NOT NULL"))


def parse_requests(df: DataFrame, column: str, old_names: tuple[str, ...] = ("readyAt", "deadline", "id")) -> DataFrame:
    """JSON requests as schedule columns and ``issue``: malformed JSON, old field names, missing or wrong fields."""
    parsed = F.from_json(column, "scheduleId string, readyAtMs long, deadlineMs long, reason string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = df.withColumn("_r", parsed)
    names: Column = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    issue = (
        F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "malformed")
        .when(F.arrays_overlap(names, F.array(*map(F.lit, old_names))), "old-alias")
        .when(F.coalesce(F.trim("_r.scheduleId") == "", F.lit(True)), "missing scheduleId")
        .when(F.col("_r.readyAtMs").isNull(), "missing readyAtMs")
    )
    return rows.select(*df.columns, F.col("_r.scheduleId").alias("schedule_id"), F.col("_r.readyAtMs").alias("ready_at_ms"), F.col("_r.deadlineMs").alias("deadline_ms"), issue.alias("issue"))
