import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from lexmill.llm import contamination, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_RNG = random.Random(3)
_VOCABULARY = ["".join(_RNG.choice("abcdefghijklmnop") for _ in range(_RNG.randint(3, 8))) for _ in range(900)]


def prose(n=100):
    return " ".join(_RNG.choice(_VOCABULARY) for _ in range(n))


def near(text):
    return " ".join(["other", *text.split()[1:]])


A, B, C, D, E, F, G, H, J, K = (prose() for _ in range(10))
PASSAGE = prose(40)
DIRTY, DIRTY2 = f"{prose()} {PASSAGE}", f"{PASSAGE} {prose()}"
SECRET = prose() + " password: hunter2222"
TEXTS = [
    *[(1, A), (1, B), (None, A), (None, near(B)), (None, C)],
    *[(2, "too short"), (2, D), (None, "short as well"), (None, "! " * 80)],
    *[(3, DIRTY), (3, E), (None, DIRTY2)],
    *[(4, F), (5, near(F)), (6, G), (6, G), (None, H), (None, H), (None, near(H))],
    *[(7, J), (7, near(J)), (8, SECRET), (None, None), (None, ""), (9, None), (9, " "), (10, K), (4, K)],
]
ROWS = [(i, t, "en", f"s{k % 3}" if t not in (G, H) else "s0", len(t or "")) for k, (i, t) in enumerate(TEXTS)]


def passes(row):
    text = row[1] or ""
    ws, lines = text.split(), [x for x in text.split("\n") if x.split()]
    n, runs = len(ws), [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    repeat = {k for i, g in enumerate(runs) if runs.count(g) > 1 for k in range(i, i + 3)}
    count = lambda marks: len(re.findall(marks, text))
    chars = sum(map(len, ws))
    return not (n < 50 or 2 * len(repeat) > n or 10 * count(r"[#*$%&|<>]") > n or 3 * count("!") > n or 10 * count("[A-Z]") > 4 * count("[A-Za-z]") or chars < 2 * n or chars > 20 * n or 2 * (len(lines) - len(set(lines))) > len(lines))


def groups(rows):
    """Rows of similar texts together; each row without words alone."""
    sets = [{tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if (ws := (r[1] or "").split()) else set() for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [[r for r, x in zip(rows, root, strict=True) if x == k] for k in sorted(set(root))]


def is_clean(row):
    ws, item = (row[1] or "").split(), PASSAGE.split()
    grams = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    hit = {k for i in range(len(ws)) if tuple(ws[i : i + 13]) in grams for k in range(i, i + 13)}
    return not hit or 20 * len(hit) < len(ws)


def one_of_each(got, wanted):
    """Of each group one row is in `got`, one with the smallest doc_id, and nothing else is."""
    first = lambda r: (r[0] is None, r[0] or 0)
    left = Counter(got)
    for g in wanted:
        hits = [r for r in dict.fromkeys(g) if first(r) == min(map(first, g)) and left[r]]
        assert hits, g
        left[hits[0]] -= 1
    assert not +left


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q1", PASSAGE), ("q2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_judge_rows(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda stage: [tuple(r) for r in stage(spark, docs, folder).select(docs.columns).collect()]
    assert Counter(rows(pipeline.quality_rules)) == Counter(filter(passes, ROWS))
    one_of_each(rows(pipeline.near_duplicates), groups(ROWS))
    assert Counter(rows(pipeline.decontamination)) == Counter(filter(is_clean, ROWS))
    by_shuffle = contamination.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), max_shared=1)
    assert Counter(map(tuple, by_shuffle.select(docs.columns).collect())) == Counter(filter(is_clean, ROWS))
    redacted = Counter((i, t.replace("password: hunter2222", "[SECRET]") if t else t) for i, t, *_ in ROWS)
    assert Counter(r[:2] for r in rows(pipeline.secret_scan)) == redacted and "assign" in secrets.BASE


def test_run(spark, folder):
    out = pipeline.run(spark, folder).collect()
    left = [g for g in groups(list(filter(passes, ROWS))) if is_clean(g[0])]
    size = lambda t: len(t.replace("password: hunter2222", "[SECRET]").split())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((*min((i is None, i or 0) for i, *_ in g), size(g[0][1])) for g in left)
