"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from lexmill.llm import crc, resampling

SCHEMA = "doc_id long, text string, lang string, rank string, weight string, Text string"


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def plain(docs, target, percent, least, seed, n):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + n) / ((s[b] + 1) * (tt + n))))
    rows = []
    for d, x in docs:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=str)


def test_crc_of_spans_and_joined_spans():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    edges = sorted(rng.sample(range(5000), 60))
    start, end = edges[:-1], edges[1:]
    import numpy as np

    raw, a, b = np.frombuffer(data, np.uint8), np.array(start), np.array(end)
    got = crc.spans(raw, a, b)
    assert got.tolist() == [zlib.crc32(data[x:y]) for x, y in zip(start, end, strict=True)]
    joined = crc.shifted(crc.with_byte(got[:-1], 32), (b - a)[1:]) ^ got[1:]
    assert joined.tolist() == [zlib.crc32(data[x:y] + b" " + data[y:z]) for x, y, z in zip(start, end, end[1:], strict=False)]
    assert crc.spans(raw, a[:0], b[:0]).tolist() == []


@pytest.fixture
def docs():
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "élan", "x" * 90, "ß", "2024", "Straße"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [rows[50]] * 3  # repeated rows
    rows += [(None, None), (None, "gamma " * 25), (7001, ""), (7002, "..., !?"), (7003, "One"), (7004, "alpha, beta-" * 40_000), (7005, "w" * 300_000)]
    return rows


def test_resample_equals_plain(spark, docs):
    target = ["Alpha beta gamma", None, "", "gamma gamma straße"]
    got = resampling.resample(spark.createDataFrame([(*r, "x", "r", "w", "t") for r in docs], SCHEMA.replace(", Text string", ", note string")), spark.createDataFrame([(x,) for x in target], "text string"), 25, 20, 7, 500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, 25, 20, 7, 500)


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d " * 5)] * 8, "doc_id long, text string")
    none = docs.where("false")
    got = resampling.resample(docs, none.select("text"), 25, 20).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r["score"] for r in got}) == 1
    assert resampling.resample(none, none.select("text")).collect() == []
    assert resampling.drawn(docs, none.select("text")).count() == 8  # one doc_id: drawn together


def test_streams_hold_every_feature():
    texts = ["One two", None, "", "three"]
    stream, offsets = resampling.bucket_stream(pa.array(texts))
    want = [[zlib.crc32(f.encode()) % 10_000 for f in ("one", "one two", "two")], [], [], [zlib.crc32(b"three") % 10_000]]
    assert [stream[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    values, n = resampling.run_lengths(stream)
    assert dict(zip(values.tolist(), n.tolist(), strict=True)) == Counter(stream.tolist())
