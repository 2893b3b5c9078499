"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import spelling


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain(docs, least_length, least_count, factor, damage):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    n = {w: c for w, c in n.items() if c >= least_count}
    rows, form = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= factor * n[w]:
            form[w] = best
        rows[w] = len(others)
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], rows[w], n.get(form.get(w))))
    return sorted(out)


def made(seed=4, letters="abcé"):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 4, 5, 5, 6, 7]))) for _ in range(150)] + ["ÀÉÎÕ×÷ÿ", "Straße", "q" * 3000, "q" * 3001]
    words += ["aaaaab", "aaaab", "aaaaaab", "baaaa", "abaaa"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(150)]
    return docs + [docs[3]] * 2 + [(None, None), (None, "abcab abcab abcab"), (900, ""), (901, "12 ,.! €𝒳"), (902, "ABCab,abcAB!" * 20_000)]


@pytest.mark.parametrize("group_chars", [spelling.GROUP_CHARS, 300])
def test_variants_equal_plain(spark, group_chars):
    docs = made()
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = spelling.variants(frame, damage=13, group_chars=group_chars)  # 300: blocks are cut into parts
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain(docs, 5, 3, 2, 13)


def test_short_words_and_other_factors(spark):
    docs = made(9, "ab")
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), 1, 1, 1.5, 0, 2000)
    assert sorted(map(tuple, got.collect())) == plain(docs, 1, 1, 1.5, 0)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wavelet_tree_reports_ranges():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        left, low = rng.integers(0, n, 50), rng.integers(0, n, 50)
        right, high = rng.integers(left, n + 1), rng.integers(low, n + 1)
        query, value = tree.report(left, right, low, high)
        want = sorted((q, v) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q])
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == want


def test_roots_follow_long_ways(spark):
    ways = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(ways).collect()} == {(f"w{i}", "w37") for i in range(37)}
