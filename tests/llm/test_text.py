"""Encoding, scoring, packing, quality and media against plain versions on the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillstone.llm import bpe, hashing, mpeg, ngram_lm, packing, quality, queries
from rillstone.llm.common import read


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_bpe_matches_the_tokenizer(spark, odd, none, sf):
    docs = odd.select("doc_id", "text").union(read(spark, sf, "documents").select(F.col("doc_id") + 1000, "text"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in pairs(docs):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), plain.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, tuple(r.ids), r.text) for r in bpe.decode(bpe.encode(docs)).collect())
    assert got == want
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert bpe.encode(odd).count() == odd.count()


def test_bpe_of_words_of_more_than_65535_ids(spark):
    """Long texts without a space between words are one word each; other documents share their block."""
    lines = "\n".join(f"k{i},v{i * 7}" for i in range(30_000))
    rows = [(1, "before it"), (2, lines), (3, "after it, and more"), (4, "x " + lines + " y z"), (5, "日本" * 70_000), (6, "the last one")]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: plain.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert min(len(want[i]) for i in (2, 4, 5)) > 65_536
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (list(r.ids), r.text) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got == {i: (want[i], t) for i, t in rows}


def plain_scores(docs, corpus):
    """(doc_id as text, words, score) of ``docs`` by the counts of ``corpus``, word by word."""
    split = lambda t: (t or "").encode().lower().split()
    every, total = Counter(), 0
    for _, t in corpus:
        w = split(t)
        total += len(w)
        every.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    out = []
    for doc_id, t in docs:
        words, score = split(t), 0.0
        for i in range(len(words)):
            for n in range(min(3, i + 1), 0, -1):
                k = tuple(words[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log10(max(every[k], 0.5) / total)
                elif every[k]:
                    score += math.log10(every[k] / every[k[:-1]])
                    break
                else:
                    score += math.log10(0.4)
        out.append((str(doc_id), len(words), score))
    return sorted(out)


def assert_scores(df, want):
    got = sorted((str(r.doc_id), r.n_words, r.log10_score) for r in df.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)


def test_scores_match_a_plain_count(spark, odd, none):
    want = plain_scores(pairs(odd), pairs(odd))
    assert_scores(ngram_lm.scores(odd), want)
    assert_scores(ngram_lm.scores(odd, most_cells=0), want)
    assert_scores(ngram_lm.scores(odd.repartition(3, "lang")), want)
    assert ngram_lm.scores(none).count() == 0 and ngram_lm.scores(none, most_cells=0).count() == 0


def test_bpe_of_blocks_without_words(spark, none):
    """Partitions whose texts are all null or empty ask for nothing; others beside them do."""
    nothing = spark.createDataFrame([(1, ""), (2, None), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode(nothing).collect()) == [(0, []), (1, []), (2, [])]
    assert {r.text for r in bpe.decode(bpe.encode(nothing)).collect()} == {""}
    mixed = nothing.coalesce(1).union(spark.createDataFrame([(4, "some words, some words")], "doc_id long, text string"))
    for docs in (mixed, mixed.repartition(2), mixed.orderBy("doc_id").limit(4)):
        got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
        assert got == {1: "", 2: "", None: "", 4: "some words, some words"}


def test_scores_back_off_on_another_corpus(spark, odd, none):
    corpus = spark.createDataFrame([("one two three four",), ("two three one",), (None,), ("the end, the end",)], "text string")
    table = ngram_lm.count_table(corpus)
    counts = Counter({r["count"]: n for n, r in enumerate(table.collect())})
    assert table.where("n = 1").agg(F.sum("count")).first()[0] == 11 and max(counts) == 2
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "one two four three one"), (51, "two three four the end zebra"), (52, "zebra")], "doc_id long, text string"))
    for block in (None, 30):
        assert_scores(ngram_lm.scores_by_table(docs, table, block=block), plain_scores(pairs(docs), [(0, r.text) for r in corpus.collect()]))
    assert ngram_lm.scores_by_table(none, table).count() == 0
    assert {r.log10_score for r in ngram_lm.scores_by_table(docs.where("doc_id = 3"), ngram_lm.count_table(none)).collect()} == {0.0}


def test_packing_is_whole_and_gapless(spark, odd, none, sf):
    docs = odd.union(read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.lit(b"k"), F.lit(1), F.lit("x"), F.lit(2), F.array(F.lit(1))))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in pairs(docs):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    rows = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= -(-sum(ends.values()) // 2048) + 1
    assert packing.pack(none).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25), st.integers(1, 12))
def test_plan_places_every_piece_once(counts, groups):
    table, made = packing.plan(counts, 64, groups, 8)
    fill = {}
    for n, c in counts.items():
        own = table[table[:, 0] == n]
        assert own[0, 1] == 0
        for i in range(c):
            row = own[np.searchsorted(own[:, 1], i, side="right") - 1]
            fill.setdefault(int(row[2] + i - row[1]), []).append((int(row[3]), n))
    assert len(fill) == made
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=2000))
def test_media_round_trip(data):
    padded = mpeg.pad(data)
    stream = mpeg.encode(padded, len(data))
    back = mpeg.decode(stream)
    assert back.payload == padded and back.length == len(data) and not back.bad and not back.junk
    assert back.table_frames == len(back.offsets) + 1 and back.table_bytes == sum(back.sizes) + back.offsets[0] - len(mpeg._tag(len(data)))


def test_media_damage():
    padded = mpeg.pad(b"text " * 300)
    whole = mpeg.encode(padded, 1500)
    frames = mpeg.decode(whole).offsets
    broken = bytearray(whole)
    broken[frames[1] + 7] ^= 1
    assert mpeg.decode(bytes(broken)).bad == 1
    with_junk = whole[: frames[1]] + b"junk\xff\xff" + whole[frames[1] :]
    back = mpeg.decode(with_junk)
    assert back.junk == 6 and back.payload == padded
    assert mpeg.decode(b"").samples == 0


def other_stream(version, stereo, guarded, frames, table=b""):
    """Frames as other encoders write them: version bits, stereo or mono, with checksums or not; a table in the first."""
    side = {(True, True): 32, (True, False): 17, (False, True): 17, (False, False): 9}[version == 3, stereo]
    rate = {3: 44100, 2: 22050, 0: 11025}[version]
    out, sizes = [], []
    for n in range(frames):
        index, padding = (9, 5, 14)[n % 3], n % 2
        kbits = ((128, 64, 320) if version == 3 else (80, 40, 160))[n % 3]
        size = (144 if version == 3 else 72) * kbits * 1000 // rate + padding
        head = bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | (not guarded), index << 4 | padding << 1, 0x40 if stereo else 0xC0])
        body = bytes((n * 7 + k) % 251 for k in range(side))
        crc = int(mpeg.checksums(np.frombuffer(head[2:] + body, np.uint8)[None])[0]).to_bytes(2, "big") if guarded else b""
        frame = head + crc + body + (table if n == 0 else b"")
        out.append(frame.ljust(size, b"\x55"))
        sizes.append(size)
    return b"".join(out), sizes, rate


@pytest.mark.parametrize("version", [3, 2, 0])
@pytest.mark.parametrize("stereo", [True, False])
@pytest.mark.parametrize("guarded", [True, False])
def test_media_of_other_encoders(version, stereo, guarded):
    xing = b"Xing" + (7).to_bytes(4, "big") + (12).to_bytes(4, "big") + (3456).to_bytes(4, "big") + bytes(range(100))
    for table in (b"", xing):
        data, sizes, rate = other_stream(version, stereo, guarded, 12, table)
        got = mpeg.decode(b"ID3\x03\x00\x00\x00\x00\x00\x0a" + b"x" * 10 + data + b"TAG".ljust(128, b"\0"))
        skip = 1 if table else 0
        assert got.sizes == sizes[skip:] and got.offsets[0] == 20 + sum(sizes[:skip]) and got.rate == rate
        assert got.samples == (1152 if version == 3 else 576) * (12 - skip) and (got.bad, got.junk, got.payload) == (0, 0, b"")
        assert (got.table_frames, got.table_bytes, got.toc) == ((12, 3456, bytes(range(100))) if table else (None, None, b""))
    if guarded:
        broken = bytearray(data)
        broken[sizes[0] + 8] ^= 1
        assert mpeg.decode(bytes(broken)).bad == 1


def test_media_table_of_another_kind():
    vbri = b"VBRI" + bytes(6) + (9999).to_bytes(4, "big") + (8).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (4, 10, 2, 2)) + b"".join(n.to_bytes(2, "big") for n in (10, 20, 30, 40))
    data, sizes, _ = other_stream(3, True, False, 8, vbri)
    got = mpeg.decode(data)
    assert (got.table_frames, got.table_bytes) == (8, 9999) and len(got.offsets) == 7
    assert got.toc[0] == 0 and got.toc[50] == 30 * 255 // 100 and len(got.toc) == 100


def test_media_query(spark, odd, none):
    back = {r.doc_id: r for r in mpeg.from_media(mpeg.to_media(odd)).collect()}
    for i, t in pairs(odd):
        raw = (t or "").encode()
        assert back[i].payload == mpeg.pad(raw) and back[i].n_bytes == len(raw)
        assert back[i].media_sha256 == hashlib.sha256(mpeg.encode(mpeg.pad(raw), len(raw))).hexdigest()
    assert mpeg.from_media(mpeg.to_media(none)).count() == 0


def test_quality(spark, odd, none, sf):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 20 and right / len(rows) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = quality.fit(docs, labels, 50)
    scores = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert len(scores) == len(set(i for i, _ in pairs(odd))) and all(0 <= s <= 1 for s in scores.values())
    assert quality.classify(none, labels.where("false")).count() == 0
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}


def test_fit_gives_its_memory_back(spark):
    """The driver lives on after a fit, so that features of the sample must not stay with it (they took 80 MB)."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    held = lambda: int(re.search(r"Private_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    quality.fit(docs, labels, 5)  # what is loaded once
    before = held()
    quality.fit(docs, labels)
    assert held() - before < 30


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_score(text, value, bias):
    """A document's score from the learned value of each bucket, feature by feature."""
    byte, coef, p = hashing._EACH.tolist(), hashing._COEF.tolist(), int(hashing._P)
    bucket = lambda key, salt: ((key + salt) * 0x9E3779B97F4A7C15 & M64) >> 64 - quality.BUCKET_BITS
    raw, found = (text or "").encode(), []
    words = [plain_mix(sum(byte[b] * pow(p, k, 1 << 64) for k, b in enumerate(w)) + (len(w) - 1) * coef[63] & M64) for w in raw.split()]
    found += [bucket(w, 1) for w in words]
    found += [0 if a == b else bucket(a * coef[0] + b & M64, 2) for a, b in zip(words[:-1], words[1:], strict=True)]
    for size in (3, 4, 5):
        for at in range(len(raw) - size + 1):
            gram = raw[at : at + size]
            if len(gram[1:-1].split()) == 1 and gram[1:-1].strip() == gram[1:-1]:
                found.append(bucket(int.from_bytes(bytes(32 if b in b" \t\n\v\f\r" else b for b in gram), "little"), 2 + size))
    return 1 / (1 + math.exp(-(sum(float(value[b]) for b in found) / max(len(found), 1) + bias)))


def test_quality_scores_match_a_plain_sum(spark, odd, sf):
    docs = odd.where("doc_id IS NULL OR doc_id <> 12").select("doc_id", "text").union(read(spark, sf, "documents").select("doc_id", "text").limit(40))
    value, bias = quality.fit(read(spark, sf, "documents"), read(spark, sf, "labels"))
    want = sorted((str(i), plain_score(t, value, bias)) for i, t in pairs(docs))
    got = sorted((str(r.doc_id), r.score) for r in quality.score(docs, (value, bias)).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    kept = Counter((str(r.doc_id), r.text) for r in quality.keep_good(docs, read(spark, sf, "labels")).collect())
    model = quality.fit(docs, read(spark, sf, "labels"))
    assert kept == Counter((str(i), t) for i, t in pairs(docs) if plain_score(t, *model) >= quality.THRESHOLD)


@pytest.mark.parametrize("name", ["op3_stupid_backoff", "op4_bpe_encode_decode", "op6_best_fit_packing", "op8_mpeg_audio_columns", "op9_subword_quality"])
def test_query(spark, sf, name):
    ids = {r.doc_id for r in queries.QUERIES[name](spark, sf).select("doc_id").collect()}
    assert ids == {r.doc_id for r in read(spark, sf, "documents").collect()}
