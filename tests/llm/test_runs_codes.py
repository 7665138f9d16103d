"""Periodic runs, packing by histogram and vector codes against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillstone.llm import histogram_packing, oracles, packing, periodic_runs, queries, vector_codes
from rillstone.llm.common import read


def plain_runs(w):
    """(start, length, period) by comparing at every lag."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed=3):
    rng, texts = random.Random(seed), ["a " * 5, "a " * 6, "a b " * 4, "x" + " a b c" * 4 + " a", "a b " * 7]
    for _ in range(120):
        w = [str(rng.randrange(rng.choice([1, 2, 5, 1000]))) for _ in range(rng.choice([5, 40, 300, 700]))]
        for _ in range(rng.randint(0, 3)):
            q, at = rng.choice([1, 2, 3, 15, 16, 17, 31, 32, 50, 64, 65, 100]), rng.randrange(len(w))
            block = w[at : at + q]
            w[at : at + rng.randint(0, 4)] = [block[i % len(block)] for i in range(rng.randint(3, 6) * q + rng.randint(-2, q))]
        texts.append(" ".join(w))
    return texts


def test_runs_equal_those_of_every_lag(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 50)
    texts = periodic_texts()
    wants = [plain_runs(t.encode().split()) for t in texts]
    assert sum(map(len, wants)) > 100 and max(q for w in wants for *_, q in w) > 64
    for (n, runs, text), whole, want in zip(periodic_runs._looked_at([t.encode() for t in texts]), texts, wants, strict=True):
        words = whole.encode().split()
        assert n == len(words) and [tuple(r) for r in runs.tolist()] == want
        assert text == plain_collapsed([w.decode() for w in words], want).encode()


def test_runs_of_odd_rows(spark, odd, none):
    rows = {r.doc_id: r for r in periodic_runs.runs(odd).collect()}
    assert periodic_runs.runs(odd).count() == odd.count() and periodic_runs.runs(none).count() == 0
    assert [tuple(r) for r in rows[12].runs] == [(0, 60000, 1)] and rows[12].collapsed == "long"
    assert [tuple(r) for r in rows[7].runs] == [(0, 1040, 26)] and rows[3].runs == [] and rows[3].collapsed == "" and rows[5].n_words == 0
    out = periodic_runs.collapse(odd)
    assert out.columns == odd.columns and periodic_runs.collapse(none).count() == 0
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    assert texts == Counter((r.doc_id, {12: "long", 7: "a b c d e f g h i j k l m n o p q r s t u v w x y z", 8: "a b c d e f g h i j k l m n o p q r s t u v w x y z end"}.get(r.doc_id, r.text)) for r in odd.collect())


def test_periodic_runs_query(spark, sf):
    """The whole table by the words of the contract, lag by lag where texts are short, else at the planted lags."""
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = read(spark, sf, "documents").collect()
    assert len(out) == len(docs)
    planted = 0
    for d in docs:
        w = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        want, r = plain_runs(w), out[d.doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
        planted += bool(h % 10 == 0 and want)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed([x.decode() for x in w], want).encode()).hexdigest()
    assert planted > 5


@pytest.mark.parametrize("capacity", [8, 64, 4096])
def test_plan_leaves_no_padding(capacity):
    rng = random.Random(capacity)
    for _ in range(20):
        counts = Counter(rng.choice([rng.randint(1, capacity), 1, 2, capacity, capacity // 2]) for _ in range(rng.choice([0, 1, 3, 50, 1500])))
        filled, pieces = defaultdict(list), defaultdict(list)
        for level, own, first, count, cut, size, sequence, packs, offset in histogram_packing.plan(counts, capacity).tolist():
            for i in range(count):
                filled[sequence + i % packs].append((offset + i // packs * size, size))
                pieces[own, first + i].append((level, cut, size))
        assert len(pieces) == sum(counts.values()) and all(i < counts[n] for n, i in pieces)
        for (n, _), parts in pieces.items():
            ends = list(itertools.accumulate(size for *_, size in sorted(parts)))
            assert [(k, cut) for k, cut, _ in sorted(parts)] == list(enumerate([0, *ends[:-1]])) and ends[-1] == n
        short = []
        for parts in filled.values():
            ends = list(itertools.accumulate(size for _, size in sorted(parts)))
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
            short += [ends[-1]] * (ends[-1] < capacity)
        assert len(set(short)) == len(short) and all(n & (n - 1) == 0 for n in short)


def packed(rows, docs, capacity=4096, end=2):
    """Check pieces and places against the tokenizer; the number of pieces beyond one per document."""
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, end] for i, t in docs}
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == ids.keys()
    for i, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    sizes = []
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == capacity or n & (n - 1) == 0 for n in sizes) and len(sizes) <= sum(map(len, ids.values())) // capacity + 13
    return len(rows) - len(ids)


def test_histogram_packing(spark, odd, none, sf):
    rows = queries.op12_histogram_packing(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    assert packed(rows, docs) < len(docs)
    one = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed(histogram_packing.pack(one, capacity=64).collect(), [(r.doc_id, r.text) for r in one.collect()], 64)
    assert sum(r.length for r in histogram_packing.pack(odd).collect() if r.doc_id == 1) == 2 * sum(r.length for r in histogram_packing.pack(odd.where("doc_id = 2")).collect())
    assert histogram_packing.pack(none).count() == 0


def test_ordinals_of_a_length_that_many_rows_have(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 10)
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40 + 8).cast("long").alias("length"))
    counts = packing.histogram(rows)
    got = defaultdict(list)
    for r in packing.with_ordinal(rows, counts, ["id"]).collect():
        got[r.length].append(r.ordinal)
    assert {n: sorted(v) for n, v in got.items()} == {n: list(range(c)) for n, c in counts.items()}


def test_hilbert_neighbours_are_one_step_apart():
    for width, bits in ((1, 3), (2, 4), (3, 3), (8, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
        place = vector_codes.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 8, 9), (63, 8, 4), (64, 2, 4), (1000, 8, 2000), (700, 1, 4), (300, 70, 50), (900, 8, 0)])
def test_kernels_equal_all_distances(n, width, spread):
    """With ties, equal points and blocks that one entry takes whole."""
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (8, n, width)) + (rng.integers(0, 3, (8, n, 1)) * 40000)
    order, *chunk = vector_codes.blocks_of(points)
    entries = points[:, :16].copy()
    far = ((points[:, :, None] - entries[:, None]) ** 2).sum(-1)
    nearest = far.argmin(-1)
    codes, errors = vector_codes._codes((n, *chunk), order, entries)
    assert (codes.T == nearest).all() and (errors == far.min(-1).sum(0)).all()
    sums = vector_codes._sums((n, *chunk), entries)
    for part in range(8):
        for k in range(entries.shape[1]):
            own = points[part][nearest[part] == k]
            assert sums[part, k, -1] == len(own) and (sums[part, k, :-1] == own.sum(0)).all()


def test_vector_codes_of_odd_rows(spark, tmp_path, monkeypatch):
    """Null and non-finite parts, other lengths, repeated and missing ids and labels, clashing columns, hot labels, against the SQL."""
    monkeypatch.setattr(vector_codes, "CHUNK", 50)
    monkeypatch.setattr(vector_codes, "HEAVY", 4)
    rng = random.Random(8)
    rows = []
    for i in range(300):
        v = [rng.choice([-1.5, 0.25, rng.gauss(0, 1)]) for _ in range(rng.choice([20, 20, 20, 17, 0]))]
        if i % 29 == 3:
            v = rng.choice([None, [None, 1.0], [float("nan")] * 20, [1.0, float("inf")]])
        rows.append((rng.choice([i, i, 7, None]), v, rng.choice([None, 1, 1, 2, i]), "k", 1.0, 2))
    rows += rows[:40]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error double, _label int").repartition(3)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = compare.connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    difference = compare.same(vector_codes.compress(read(spark, str(tmp_path), "embeddings")), con, oracles.CODES)
    assert not difference, difference
    assert vector_codes.compress(table.where("false")).count() == 0
    assert vector_codes.compress(table.where("vec_id = 7").limit(3)).count() <= 3
    with pytest.raises(ArithmeticError):
        vector_codes.whole_numbers(pa.array([[1e30]]), 8)
