"""The stored index: layout by token, updates, bounds for the best hits, and queries as data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import batch as BA
from lexmill.operators import index as I
from lexmill.operators import search as S

SCHEMA = "id long, " + ", ".join(f"{f} string" for f in I.FIELDS) + ", project_root string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "alps", "betty", "be"]


def made(n=300, seed=1, first=0):
    rng = random.Random(seed)
    text = lambda m: " ".join(rng.choice(WORDS + ["the"] * 12) for _ in range(rng.randrange(m)))
    return [(first + i, "", text(4), text(60) + (" rare" if i % 50 == 0 else ""), "", "md", "", f"/p{i % 3}") for i in range(n)] + [(first + 100_000, "", "", "", "", "", "", "/p0")]


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    I.write_index(spark.createDataFrame(made(), SCHEMA), path, shards=24)
    return path


QUERIES = [
    lambda s: S.term(s, "rare"),
    lambda s: S.term(s, "alpha") & S.phrase(s, "the beta"),
    lambda s: S.prefix(s, "be") | S.term(s, "rare"),
    lambda s: S.Near((S.term(s, "gamma"), S.term(s, "delta")), 3) - S.term(s, "eps"),
    lambda s: S.term(s, "the").in_fields("signature").initial(),
]


def test_stored_equals_made_on_the_way(spark, stored):
    entities, index = spark.createDataFrame(made(), SCHEMA), I.open_index(spark, stored)
    for make in QUERIES:
        want = scores(S.rank_bm25(entities, make(spark)))
        assert want and scores(S.rank_bm25(index, make(spark))) == want
    have = {(r.id, r.field, r.token): r.positions for r in index.postings.collect()}
    assert have == {(r.id, r.field, r.token): r.positions for r in I.postings(entities).collect()}


def test_a_search_opens_only_shards_of_its_tokens(spark, stored):
    index = I.open_index(spark, stored)
    scan = S._Plan(S.term(spark, "gamma")).token_rows(index, I.FIELDS)
    scan.collect()
    files = len(index.table("postings").inputFiles())
    plan = scan._jdf.queryExecution().executedPlan()
    read = max(int(n) for n in re.findall(r"(\d+)", str(_metric(plan, "numFiles"))))
    assert 0 < read < files / 4, (read, files)


def _metric(plan, name):
    """A metric of the scan at the bottom of a plan that ran."""
    while plan.children().size():
        plan = plan.children().apply(0)
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        return _metric(plan.executedPlan(), name)
    return plan.metrics().apply(name).value()


def test_a_frequent_token_has_several_shards(spark, stored):
    index = I.open_index(spark, stored)
    rows = index.table("postings").where("token = 'the'").select("shard").distinct().count()
    assert rows > 1 and index.bounds[0].count("the") == rows - 1


def test_updates_deletes_and_compaction(spark, tmp_path):
    path = str(tmp_path)
    rows = made(40)
    I.write_index(spark.createDataFrame(rows, SCHEMA), path, shards=3)
    fresh = made(20, 9, 500)[:-1]
    gone = [r[0] for r in rows if r[0] % 4 == 0 and r[0] < 1000]
    frame = spark.createDataFrame([(i,) for i in gone], "id long")
    assert I.update_index(spark.createDataFrame(fresh, SCHEMA), path, frame, "b1", 2)
    assert not I.update_index(spark.createDataFrame(fresh, SCHEMA), path, frame, "b1", 2)  # committed before
    changed = [(1, "", "changed", "beta beta rare", "", "", "", "/p9")]
    assert I.update_index(spark.createDataFrame(changed, SCHEMA), path, spark.createDataFrame([(1,)], "id long"), "b2", 1)
    left = [r for r in rows if r[0] not in (*gone, 1)] + fresh + changed
    entities = spark.createDataFrame(left, SCHEMA)

    def same():
        index = I.open_index(spark, path)
        for make in QUERIES[:4]:
            assert scores(S.rank_bm25(index, make(spark))) == scores(S.rank_bm25(entities, make(spark)))
        top = [(r["id"], round(r["score"], 9)) for r in S.top_terms(index, ["the", "beta"], 7).collect()]
        assert top == [(r["id"], round(r["score"], 9)) for r in S.top_k(S.rank_bm25(entities, S.term(spark, "the") | S.term(spark, "beta")), 7, "score").collect()]
        df = {r[0]: r[1] for r in index.table("terms").groupBy("token").agg(F.sum("n")).collect() if r[1]}
        assert df == {r.token: r.df for r in I.term_stats(I.postings(entities)).collect()}
        assert {r.id for r in index.entities().select("id").collect()} == {r[0] for r in left}

    same()
    I.compact(spark, path, shards=2)
    assert len(I.open_index(spark, path).segments) == 1
    same()


def test_a_segment_that_was_cut_off_is_written_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    I.write_index(spark.createDataFrame(made(30), SCHEMA), path, shards=2)
    fresh, gone = spark.createDataFrame([(900, "", "", "rare", "", "", "", "/p0")], SCHEMA), spark.createDataFrame([(0,)], "id long")
    kept = I._statistics
    monkeypatch.setattr(I, "_statistics", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        I.update_index(fresh, path, gone, "b", 1)
    monkeypatch.setattr(I, "_statistics", kept)
    assert {r.id for r in S.matches(I.open_index(spark, path), S.term(spark, "rare")).collect()} == {0}
    assert I.update_index(fresh, path, gone, "b", 1)
    assert {r.id for r in S.matches(I.open_index(spark, path), S.term(spark, "rare")).collect()} == {900}


@pytest.mark.parametrize("tokens", [["the"], ["the", "rare"], ["alpha", "beta", "none"], ["none"]])
def test_best_hits_by_bounds(spark, stored, tokens):
    index, k = I.open_index(spark, stored), 5
    q = S.term(spark, tokens[0])
    for t in tokens[1:]:
        q = q | S.term(spark, t)
    full = S.rank_bm25(index, q)
    want = [(r["id"], round(r["score"], 9)) for r in S.top_k(full, k, "score").collect()]
    assert [(r["id"], round(r["score"], 9)) for r in S.top_terms(index, tokens, k).collect()] == want
    penalties = spark.range(100_001).select("id", (F.col("id") % 7 / 10).alias("penalty"))
    aged = full.join(penalties, "id").withColumn("adjusted_rank", F.col("score") + F.col("penalty"))
    want = [(r["id"], round(r["adjusted_rank"], 9)) for r in S.top_k(aged, k).collect()]
    assert [(r["id"], round(r["adjusted_rank"], 9)) for r in S.top_terms(index, tokens, k, penalties).collect()] == want


def test_bounds_score_a_tenth_of_a_common_term(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "", "", " ".join(["the"] * (0 if i % 5 > 1 else 9 if i % 500 == 0 else 1) + ["pad"] * rng.randrange(20, 300)), "", "", "", "/p") for i in range(3000)]
    I.write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path), shards=4)
    index = I.open_index(spark, str(tmp_path))
    best = S.top_terms(index, ["the"], 5)
    full = S.rank_bm25(index, S.term(spark, "the"))
    assert [r["id"] for r in best.collect()] == [r["id"] for r in S.top_k(full, 5, "score").collect()]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    found = re.search(r"level#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    levels = [int(x) for x in (found[1] or found[2]).split(",")]
    scored = index.table("postings").where(F.col("token") == "the").where(F.col("level").isin(levels)).count()
    assert 5 <= scored <= full.count() // 10


def trees(spark, rng, tokens, depth):
    if depth == 0 or rng.random() < 0.2:
        kind = rng.randrange(6)
        if kind == 0:
            return S.phrase(spark, " ".join(rng.sample(tokens, 2)))
        if kind == 1:
            return S.Phrase((rng.choice(tokens)[:2],), True)
        if kind == 2:
            return S.Near(tuple(S.Phrase((t,)) for t in rng.sample(tokens, rng.choice([2, 3]))), rng.randrange(1, 6))
        leaf = S.Phrase((rng.choice(tokens),))
        return leaf.in_fields("signature", "ext") if kind == 3 else leaf.initial() if kind == 4 else leaf
    return rng.choice([S.And, S.Or, S.Minus])(trees(spark, rng, tokens, depth - 1), trees(spark, rng, tokens, depth - 1))


def test_batches_of_trees_equal_single_searches(spark, stored):
    rng = random.Random(8)
    queries = {i: trees(spark, rng, [*WORDS, "the", "rare"], rng.randrange(4)) for i in range(100)}
    index = I.open_index(spark, stored)
    nodes = BA.query_table(spark, queries)
    got = {}
    for r in BA.matching(index, nodes).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = round(r["score"], 9)
    entities = spark.createDataFrame(made(), SCHEMA).cache()
    for i in rng.sample(range(100), 8):  # a plan and a run each
        assert got.get(i, {}) == scores(S.rank_bm25(entities, queries[i])), queries[i]
    direct = {(r["query_id"], r["id"]): round(r["score"], 9) for r in BA.matching(entities, nodes).collect()}
    assert direct == {(i, d): s for i, x in got.items() for d, s in x.items()}
    best = BA.search_trees(index, nodes, 3).collect()
    assert max(r["nth"] for r in best) == 3 and all(round(r["score"], 9) == got[r["query_id"]][r["id"]] for r in best)
