"""MinHash near duplicates against all pairs."""

import random
import re

import numpy as np

from lexmill.llm import jaccard, minhash


def shingles(text, k):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} - {()}


def plain(docs, k, percent):
    """doc_id, set size, smallest doc_id reachable; rows with words and one doc_id are one node."""
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = docs[i][0] == docs[j][0]
            if a and b and None not in (docs[i][0], docs[j][0]) and (same or 100 * len(a & b) >= percent * len(a | b)):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    rows = [(d, len(sets[i]), None if d is None else least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]
    return sorted(((*r, r[0] is None or r[0] == r[2]) for r in rows), key=str)


def made(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    docs = []
    for base in range(14):
        text = [word() for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(text)
            for _ in range(rng.randrange(0, max(1, len(copy) // 14) + 1)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    docs += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(15)]
    docs += ["", None, "One", "ONE", "a b", "  \t\n", "long " + "x y z w v " * 60_000]
    rng.shuffle(docs)
    rows = [(3 * i + 1, t) for i, t in enumerate(docs)]
    return rows + rows[:5] + [(rows[9][0], "quite another text under one doc id")] + [(None, docs[0]), (None, None)]


def test_near_duplicates_equal_plain(spark):
    rows = made()
    frame = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, `key` string, n_shingles int")
    got = minhash.near_duplicates(frame, shingle=4, percent=80)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 4, 80)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tables_are_pairs_of_half_keys(spark):
    rows = [(1, list(range(24))), (2, [*range(12), *range(100, 112)]), (3, list(range(50, 74)))]
    found = minhash.table_keys(spark.createDataFrame(rows, "key long, halves array<long>")).collect()
    # 1 and 2 share 6 halves of each collection: 36 tables; 3 shares halves of 1 and 2 with none of both.
    assert len(found) == 72 and {r["key"] for r in found} == {1, 2}


def test_half_keys_agree_as_often_as_the_sets():
    rng = np.random.default_rng(1)
    hits = total = 0
    for _ in range(150):
        tokens = rng.integers(0, 2**63, 110).astype(np.uint64)
        a, b = np.sort(tokens[:100]), np.sort(tokens[10:])  # 90 of 110 in common
        keys = minhash.half_keys(np.concatenate([a, b]), np.array([0, 100, 200]))
        hits, total = hits + (keys[0] == keys[1]).sum(), total + keys.shape[1]
    assert abs(hits / total - (90 / 110) ** minhash.ROWS) < 0.03


def test_groups_are_bounded_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 300)
    rows = made(6)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(frame, 4, 80).collect()), key=str) == plain(rows, 4, 80)
    got = jaccard.jaccard(frame, 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:3] for r in plain(rows, 3, 90)), key=str)
