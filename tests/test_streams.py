"""Keyed folds over many micro-batches: rows out of order, late rows, timers, expiry and effects."""

import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rillstone.operators import basic, bus, cqrs, queue, timeops
from rillstone.streaming import operators as streaming
from rillstone.streaming import stateful

S = 1000


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events of three keys in six files: out of order within ten seconds, and two rows far too late."""
    rng = random.Random(3)
    rows = [(rng.randrange(3), t * S + rng.randrange(S), n) for n, t in enumerate(sorted(rng.randrange(0, 600) for _ in range(240)))]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 9 * S))
    late = [(0, 5 * S, 900), (1, 7 * S, 901)]
    end = [(9, 700 * S, 999)]  # moves the watermark past all rows
    folder = tmp_path_factory.mktemp("events")
    parts = [arrival[i * 40 : (i + 1) * 40] for i in range(6)]
    parts[4] = parts[4] + late
    for i, part in enumerate([*parts, end]):
        path = folder / f"part-{i}.parquet"
        df = pd.DataFrame(part, columns=["key", "ms", "id"])
        df["ts"] = pd.to_datetime(df["ms"], unit="ms")
        df.to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    batch = spark.createDataFrame(rows, "key long, ms long, id long")
    return streaming.read_stream(spark, str(folder)), batch


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect() if r["key"] != 9) if "key" in df.columns else sorted(tuple(r[c] for c in columns) for r in df.collect() if r["id"] != 999)


def test_folds_equal_their_batch_forms(shuffled):
    stream, batch = shuffled
    order, key = ["ms", "id"], ["key"]
    run = streaming.run_to_table
    got = rows_of(run(streaming.throttle(stream, "key", "ts", "id", 20 * S, "10 seconds"), "t"), "id")
    assert got == rows_of(timeops.throttle(batch, "ms", 20 * S, order, key), "id") and got
    got = rows_of(run(streaming.debounce(stream, "key", "ts", "id", 6 * S, "10 seconds"), "d"), "key", "at_ms", "id")
    assert got == rows_of(timeops.debounce(batch, "ms", 6 * S, order, key), "key", "ms", "id") and got
    got = rows_of(run(streaming.audit(stream, "key", "ts", "id", 15 * S, "10 seconds"), "a"), "key", "emit_at", "id")
    assert got == rows_of(timeops.audit(batch, "ms", 15 * S, order, key), "key", "emit_at", "id") and got
    got = rows_of(run(streaming.pairwise(stream, "key", "ts", "id", "10 seconds"), "p"), "key", "previous", "current")
    assert got == rows_of(basic.pairwise(batch, "id", order, key), "key", "previous", "current") and got
    got = {(r.key, r.at_ms, r.id, r.error) for r in run(streaming.timeout(stream, "key", "ts", "id", 12 * S, "10 seconds"), "o").collect() if r.key != 9}
    assert got == {(r.key, r.ms, r.id, r.error) for r in timeops.timeout(batch, "ms", 12 * S, order, key).collect()}


def test_late_rows_are_dropped_and_others_wait_for_their_turn(shuffled):
    stream, batch = shuffled

    def step(state, row):
        return row.at_ms, [(row.id, state <= row.at_ms)]

    out = streaming.run_to_table(streaming.fold(stream, "key", "ts", "10 seconds", ["ms", "id"], step, 0, "id long, ordered boolean"), "ordered").collect()
    assert all(r.ordered for r in out)
    assert sorted(r.id for r in out) == sorted(r.id for r in batch.collect())  # neither the late rows nor the one after the watermark


def test_forgotten_keys_begin_anew(spark, tmp_path):
    for i, ms in enumerate((10 * S, 15 * S, 510 * S, 910 * S, 2010 * S)):
        path = tmp_path / f"part-{i}.parquet"
        pd.DataFrame({"key": [1], "id": [i], "ts": pd.to_datetime([ms], unit="ms")}).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    count = lambda n, row: (n + 1, [(row.id, n + 1)])
    stream = streaming.read_stream(spark, str(tmp_path))
    seen = lambda forget: sorted(tuple(r) for r in streaming.run_to_table(streaming.fold(stream, "key", "ts", "1 second", ["ts"], count, 0, "id long, n long", forget_ms=forget), "f").collect())
    assert seen(None) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert seen(100 * S)[:2] == [(0, 1), (1, 2)] and dict(seen(100 * S))[3] == 1


def test_effects_run_once_per_micro_batch(shuffled):
    stream, batch = shuffled
    seen = []
    streaming.once_per_key(stream.where("key <> 9 and id < 900"), "effect", lambda df, n: seen.append((n, df.count())))
    assert sum(n for _, n in seen) == batch.count() and len({i for i, _ in seen}) == len(seen) >= 6


def in_files(folder, rows, columns, parts=6):
    """A stream of commands (ms first) in several files, out of order within nine seconds, and a last row that moves the watermark on."""
    rng = random.Random(5)
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 9 * S))
    each = -(-len(arrival) // parts)
    last = (max(r[0] for r in rows) + 100 * S, *(-1 if isinstance(v, int) else None for v in rows[0][1:]))
    for i, part in enumerate([*(arrival[k : k + each] for k in range(0, len(arrival), each)), [last]]):
        df = pd.DataFrame(part, columns=["ms", *columns]).astype(object)
        df["ts"] = pd.to_datetime(df["ms"].astype("int64"), unit="ms")
        write_part(folder, i, df.drop(columns="ms"), columns, rows[0][1:])
    return folder


def write_part(folder, i, df, columns, like):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = [pa.int64() if isinstance(v, int) else pa.string() for v in like]
    arrays = [pa.array([None if v is None or v != v else v for v in df[c]], k) for c, k in zip(columns, kinds, strict=True)]
    path = folder / f"part-{i}.parquet"
    pq.write_table(pa.table([*arrays, pa.array(df["ts"]).cast(pa.timestamp("us"))], names=[*columns, "ts"]), path)
    os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def batch_of(spark, rows, columns, like):
    return spark.createDataFrame([r[1:] for r in rows], ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in zip(columns, like, strict=True)))


def times(n, seed=1):
    rng = random.Random(seed)
    return sorted(rng.randrange(600 * S) for _ in range(n))


def test_buffers_of_a_stream_are_lists_of_its_key(spark, tmp_path):
    columns, rng = ["key", "ord", "v"], random.Random(2)
    rows = [(ms, rng.randrange(3), n, rng.randrange(99)) for n, ms in enumerate(times(100))]
    in_files(tmp_path, rows, columns)
    stream = stateful.buffer_count(streaming.read_stream(spark, str(tmp_path)), "key", "ts", ["ord"], "v", 7, "10 seconds")
    want = Counter()
    for key in range(3):
        own = [v for _, k, _, v in rows if k == key]
        want.update((key, tuple(own[i : i + 7])) for i in range(0, len(own) - 6, 7))
    assert Counter((r.key, tuple(r["values"])) for r in streaming.run_to_table(stream, "b").collect()) == want and len(want) > 8
    idle = stateful.buffer_count(streaming.read_stream(spark, str(tmp_path)), "key", "ts", ["ord"], "v", 7, "10 seconds", idle_ms=1)
    assert len(streaming.run_to_table(idle, "b").collect()) < 3  # a key is forgotten between almost any two rows


def test_publishes_of_a_stream_equal_the_batch(spark, tmp_path):
    columns, rng = ["ord", "kind", "topic", "command_id", "idempotency_key", "payload"], random.Random(3)
    rows = []
    for n, ms in enumerate(times(220)):
        topic = rng.choice(["a", "b", ""])
        kind = "ensure_topic" if n in (6, 20) or n == 1 else "close_topic" if n > 180 and rng.random() < 0.1 else "publish"
        rows.append((ms, n, kind, topic, f"{topic}{rng.randrange(150)}" if rng.random() < 0.6 else None, f"k{rng.randrange(60)}" if rng.random() < 0.4 else None, n))
    rows[6], rows[20] = ((*r[:3], t, None, None, r[6]) for r, t in ((rows[6], "a"), (rows[20], "b")))
    in_files(tmp_path, rows, columns)
    batch = bus.publish(batch_of(spark, rows, columns, (0, "", "", "", "", 0)).withColumn("now_ms", F.lit(0)))
    want = Counter((r.ord, r.status, r.seq) for r in batch.collect())
    got = Counter(tuple(r) for r in streaming.run_to_table(stateful.publish(streaming.read_stream(spark, str(tmp_path)), "ts", "10 seconds"), "p").collect())
    assert got == want and len({s for _, s, _ in want}) >= 4


def test_commands_and_processes_of_a_stream_equal_the_batch(spark, tmp_path):
    columns, rng = ["process_id", "ord", "id", "command_type", "v"], random.Random(4)
    rows = [(ms, rng.randrange(3), n, rng.choice(["", *[f"c{rng.randrange(150)}" for _ in range(9)]]), rng.choice(["add", "add", "twice", "bad", "odd", ""]), rng.randrange(9)) for n, ms in enumerate(times(200))]
    rows = [(ms, p, n, i and f"{p}{i}", t, v) for ms, p, n, i, t, v in rows]
    in_files(tmp_path, rows, columns)
    batch = batch_of(spark, rows, columns, (0, 0, "", "", 0))

    def reduce(state, c):
        if c.command_type == "bad":
            raise ValueError
        made = [("added", c.v, f"e{c.v}" if c.v < 2 else None)] + (["again"] if c.command_type == "twice" else [])
        return state + c.v, made, [("" if c.v == 7 else "ask", c.v, "")] if c.v > 5 else []

    want = Counter(tuple(r) for r in cqrs.process(batch, reduce, 0, "long").collect())
    got = Counter(tuple(r) for r in streaming.run_to_table(stateful.process(streaming.read_stream(spark, str(tmp_path)), "ts", "10 seconds", reduce, 0, "long"), "s").collect() if r.process_id >= 0)
    assert got == want and {r[7] for r in want} == {None, "malformed-command", "reducer-threw", "malformed-event", "malformed-effect"}

    def bad(row):
        raise ValueError

    handlers = {"add": lambda r: [("added", r.v)], "twice": lambda r: [("added", r.v), ("added", -r.v)], "bad": bad}
    draft = lambda v: F.struct(F.lit("added").alias("type"), v.alias("payload"))
    handled = cqrs.handle(batch, {"add": F.array(draft(F.col("v"))), "twice": F.array(draft(F.col("v")), draft(-F.col("v"))), "bad": F.lit(None).cast("array<struct<type:string,payload:bigint>>")}, F.col("ord"))
    out = streaming.run_to_table(stateful.handle(streaming.read_stream(spark, str(tmp_path)), "process_id", "ts", "10 seconds", handlers), "h").where("ord >= 0").collect()
    assert Counter((r.ord, r.status) for r in out if r.status != "event") == Counter((r.ord, r.status) for r in handled.collect())
    made = cqrs.events(handled.withColumn("aggregate_id", F.col("process_id"))).collect()
    assert Counter((r.ord, r.id, r.type, r.payload) for r in out if r.status == "event") == Counter((r.ord, r.id, r.type, r.payload) for r in made) and made


def test_a_queue_of_a_stream_equals_the_batch(spark, tmp_path):
    columns = ["queue_id", "ord", "command_id", "kind", "work_id", "lease_id", "attempt", "worker_id", "limit", "not_before_ms", "retryable", "now_ms", "idempotency_key"]
    rng, rows = random.Random(6), []
    for n, ms in enumerate(times(260)):
        kind = rng.choice(["submit", "submit", "submit", "claim", "claim", "renew_lease", "complete", "fail", "release", "cancel", "schedule", "expire_leases"])
        work = f"w{rng.randrange(25)}" if kind not in ("claim", "expire_leases") or rng.random() < 0.3 else None
        rows.append((ms, rng.choice(["q1", "q2"]), n, f"c{n}" if rng.random() < 0.95 else "c1", kind, work, None, None, "me" if kind == "claim" else None, rng.choice([1, 2, 3]), ms + rng.randrange(0, 90 * S) if rng.random() < 0.4 else None, None, ms, f"k{rng.randrange(40)}" if rng.random() < 0.2 else None))
    like = ("", 0, "", "", "", "", 0, "", 0, 0, "", 0, "")
    for r, v in zip(rows[0][1:], like, strict=True):
        assert r is None or type(r) is type(v)
    arrival = [(r[0], *r[1:]) for r in rows]
    rng2 = random.Random(7)
    arrival.sort(key=lambda r: r[0] + rng2.randrange(0, 9 * S))
    parts = [arrival[k : k + 50] for k in range(0, len(arrival), 50)] + [[(rows[-1][0] + 200 * S, "end", -1, *[None] * 11)]]
    for i, part in enumerate(parts):
        df = pd.DataFrame(part, columns=["ms", *columns]).astype(object)
        df["ts"] = pd.to_datetime(df["ms"].astype("int64"), unit="ms")
        write_part(tmp_path, i, df, columns, like)
    several = F.when((F.col("kind") == "claim") & (F.col("ord") % 3 == 0), F.array(*map(F.lit, ["w3", "w8", "w1", "none"])))
    batch = batch_of(spark, rows, columns, like).withColumn("retryable", F.col("retryable").cast("boolean")).withColumn("work_ids", several)
    want = Counter(tuple(r) for r in queue.fold(batch, 60 * S, 2, 20 * S).collect())
    stream = streaming.read_stream(spark, str(tmp_path)).withColumn("retryable", F.col("retryable").cast("boolean")).withColumn("work_ids", several)
    got = Counter(tuple(r) for r in streaming.run_to_table(stateful.work_queue(stream, "ts", "10 seconds", 60 * S, 2, 20 * S), "q").collect() if r.queue_id != "end")
    assert got == want and len({r[2] for r in want}) >= 8 and {"duplicate-command", "unknown-work"} <= {r[9] for r in want}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """Two runs of one name, with files that came between them: state, offsets and table are those of one run."""
    columns = ["key", "ord", "v"]
    rows = [(ms, n % 2, n, n) for n, ms in enumerate(times(60))]
    whole, aside = tmp_path / "in", tmp_path / "aside"
    whole.mkdir()
    aside.mkdir()
    in_files(whole, rows, columns)
    later = [f"part-{i}.parquet" for i in (3, 4, 5, 6)]
    for part in later:
        (whole / part).rename(aside / part)
    name = f"resumed-{tmp_path.name}"
    step = lambda n, row: (n + 1, [(row.key, row.ord, n + 1)])
    old = lambda: streaming.fold(streaming.read_stream(spark, str(whole)), "key", "ts", "10 seconds", ["ord"], step, 0, "key long, ord long, n long")
    new = lambda: stateful.buffer_count(streaming.read_stream(spark, str(whole)), "key", "ts", ["ord"], "v", 5, "10 seconds")
    first = streaming.run_to_table(old(), name, resume=True).count(), streaming.run_to_table(new(), f"{name}-b", resume=True).count()
    for part in later:
        (aside / part).rename(whole / part)
    counted = streaming.run_to_table(old(), name, resume=True)
    assert 0 < first[0] < counted.count() == len(rows)
    assert sorted(tuple(r) for r in counted.collect()) == sorted((k, o, 1 + sum(x[1] == k for x in rows[:n])) for n, (_, k, o, _) in enumerate(rows))
    buffers = streaming.run_to_table(new(), f"{name}-b", resume=True).collect()
    assert first[1] < len(buffers) and sorted(x for r in buffers for x in r["values"]) == sorted(o for k in (0, 1) for o in [r[2] for r in rows if r[1] == k][: len([r for r in rows if r[1] == k]) // 5 * 5])


@pytest.mark.parametrize("where", ["between", "after the ledger", "before the effects"])
def test_effects_stand_once_after_a_failure(spark, tmp_path, where):
    """The run breaks in its third batch; a new run from the same folder leaves what one run would have left."""
    rng = random.Random(8)
    rows = [(ms, rng.randrange(40), n) for n, ms in enumerate(times(90))]
    in_files(tmp_path, rows, ["id", "ord"])
    name = f"effects-{tmp_path.name}-{where.replace(' ', '-')}"
    tries = []

    def effect(df):
        tries.append(df.count())
        if where == "before the effects" and len(tries) == 3:
            raise RuntimeError("broken")
        return df.select("id", (F.col("id") * 2).alias("sent"))

    read = lambda: streaming.read_stream(spark, str(tmp_path)).where("id >= 0").select("id", "ord")
    if where == "after the ledger":
        ledger = streaming.Ledger(spark, name)

        def applied(df, batch):
            ledger.apply(df, batch, "id", effect)
            if batch == 2:
                raise RuntimeError("broken")

        with pytest.raises(StreamingQueryException):
            streaming.once_per_key(read(), name, applied, resume=True)
    else:
        with pytest.raises(StreamingQueryException):
            streaming.effect_once(read(), name, "id", effect, broken_at=2 if where == "between" else None)
    ledger = streaming.effect_once(read(), name, "id", effect)
    ids = {i for _, i, _ in rows}
    assert Counter(tuple(r) for r in ledger.effects().collect()) == Counter((i, 2 * i) for i in ids)
    assert Counter(r.id for r in ledger.applied().collect()) == Counter(ids) and {r.query for r in ledger.applied().collect()} == {name}
    again = streaming.effect_once(read(), name, "id", effect)  # nothing is new
    assert again.effects().count() == len(ids)
