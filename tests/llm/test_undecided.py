"""Sets that look alike without being similar: what they ask the groups after the hubs."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import jaccard, minhash
from tests.llm.test_minhash import plain


def below(n=400, seed=3):
    """Texts of one passage, mostly at similarities of 0.57 to 0.76 with each other, and a few similar pairs."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = [f"b{j}" for j in range(150)]
        for j in range(5):  # each changed word changes 4 of 147 shingles
            text[4 + 29 * j + rng.randrange(8)] = f"x{i}.{j}"
        docs.append(text)
        if i % 25 == 0:
            docs.append([*text[:-1], f"y{i}"])
    rng.shuffle(docs)
    return [(2 * i + 1, " ".join(t)) for i, t in enumerate(docs)]


def test_sets_below_the_limit_hardly_ask(spark, monkeypatch):
    rows, joined, opened = below(), [], jaccard.opened_groups

    def counted(live):
        unions = live.groupBy("signature", F.col("group").alias("asked")).agg(F.max("rank").alias("top"))
        joined.append(live.join(unions, "signature").where("top > rank").count())
        return opened(live)

    monkeypatch.setattr(jaccard, "opened_groups", counted)
    monkeypatch.setattr(jaccard, "GROUP_SETS", 16)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 4, 80)
    assert len(joined) == 1 and joined[0] < 300 * len(rows)


def _tables_shared(similar, bands, rows, n=200):
    """In how many tables each of n pairs of sets of a similarity of similar/100 meets."""
    rng, out = np.random.default_rng(similar), []
    for _ in range(n):
        tokens = rng.integers(0, 2**63, 100).astype(np.uint64)
        own = (100 - similar) // 2
        a, b = np.sort(tokens[own:]), np.sort(np.delete(tokens, slice(own, 2 * own)))
        keys = minhash.band_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands, rows, skip=1 << 12)
        out.append(int((keys[0] == keys[1]).sum()))
    return np.array(out)


def test_sharp_tables_keep_similar_sets_and_part_others():
    bands, rows = minhash.sharp_bands(80)
    at = {s: _tables_shared(s, bands, rows) for s in (40, 60, 80)}
    assert at[80].min() > 0 and abs(at[80].mean() / (bands * 0.8**rows) - 1) < 0.1
    assert at[60].mean() < 1.2 and at[40].mean() < 0.05


def test_sharp_bands_for_any_percent():
    for percent in (1, 10, 50, 80, 90, 99):
        bands, rows = minhash.sharp_bands(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISSED * 1.0001
    assert minhash.sharp_bands(100) == (1, 1)
