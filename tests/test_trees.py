"""Batches of query trees: what they read, deal out and keep."""

import random

from pyspark.sql import functions as F

from lexmill.jobs import stored
from lexmill.operators import batch as BA
from lexmill.operators import index as I
from lexmill.operators import search as S

SCHEMA = "id long, preamble string, signature string, body string, namespace string, ext string, path string, project_root string"
WORDS = ["alpha", "alpine", "beta", "bet", "gamma", "the", "the", "the"]


def entities(spark, texts):
    return spark.createDataFrame([(i, "", t[:12], t, "", "md", "", "/p") for i, t in texts], SCHEMA)


def some_texts(n=60, seed=5):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in range(n)]


def some_trees():
    one = lambda *t, **how: S.Phrase(t, **how)
    return {
        1: (one("the", "alpha") | S.Near((one("beta"), one("gamma")), 4)) & one("al", is_prefix=True).in_fields("body") - one("alpine"),
        2: S.Near((one("the", "be", is_prefix=True), one("gamma"), one("alpha")), 6) - (one("bet") & one("alpine")),
        3: one("the", "the", "b", is_prefix=True) | one("gamma", is_initial=True),
        4: one("alp", is_prefix=True).in_fields("signature") - (one("the") - one("beta")),
        5: S.Near((one("the"), one("the")), 0) & one("missing"),
        6: one("al", is_prefix=True).not_in_fields("body", "signature", "ext") | one("the", "gamma").in_fields(),
    }


def pairs(df):
    return sorted((r["query_id"], r["id"]) for r in df.collect())


def kept(monkeypatch):
    out, plain = [], BA.checkpointed
    monkeypatch.setattr(BA, "checkpointed", lambda df: (x := plain(df), out.append(x.count()))[0])
    return out


def test_the_query_deals_no_text_out_and_keeps_none(spark, tmp_path, monkeypatch):
    """search_trees: nothing that grows with the texts is shuffled, kept or written before its matches."""
    rng, words = random.Random(2), [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(200)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in [*range(20), 3, 3, 7]]  # some share an item_id
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = kept(monkeypatch)
    written, plain = [], I.update_index
    monkeypatch.setattr(I, "update_index", lambda *a, **how: written.append(1) or plain(*a, **how))
    found = stored.search_trees(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not written and sum(rows) == 0 and "Exchange" not in plan
    want = []
    for q in sorted({q for q, _ in asked}):
        trees = [text.split() for x, text in asked if x == q]
        for i, doc in enumerate(d.split() for d in texts):
            at = lambda w, doc=doc: [p for p, x in enumerate(doc) if x == w]
            phrase = any(y == x + 1 for t in trees for x in at(t[0]) for y in at(t[1]))
            near = any(abs(y - x) <= 6 for t in trees for x in at(t[2]) for y in at(t[3]))
            if (phrase or near) and any(x.startswith(t[4][:2]) for t in trees for x in doc) and not any(t[5] in doc for t in trees):
                want.append((q, i))
    assert want and pairs(found) == want


def test_matches_of_both_sources_equal_single_searches(spark, tmp_path, monkeypatch):
    rows = entities(spark, some_texts()).cache()
    I.write_index(rows, str(tmp_path), shards=6)
    index, nodes = I.open_index(spark, str(tmp_path)), BA.query_table(spark, some_trees())
    want = sorted((q, r["id"]) for q, tree in some_trees().items() for r in S.matches(rows, tree).collect())
    assert {q for q, _ in want} >= {1, 2, 3, 4} and pairs(BA.matches(rows, nodes)) == want
    assert pairs(BA.matches(index, nodes)) == want and pairs(BA.matching(index, nodes)) == want
    # In blocks of one or two trees, a few entities at a time.
    scores = {(r["query_id"], r["id"]): round(r["score"], 9) for r in BA.matching(rows, nodes).collect()}
    monkeypatch.setattr(BA, "MAX_NODES", 12)
    monkeypatch.setattr(BA, "MAX_CELLS", 40)
    assert len(list(BA._blocks(nodes))) > 2
    assert pairs(BA.matches(rows, nodes)) == want and pairs(BA.matches(index, nodes)) == want
    assert {(r["query_id"], r["id"]): round(r["score"], 9) for r in BA.matching(index, nodes).collect()} == scores
    assert BA.matches(rows, nodes.where("false")).collect() == BA.matching(rows, nodes.where("false")).collect() == []


def test_rows_that_share_an_id_are_one_entity(spark):
    rows = entities(spark, [(1, "alpha beta"), (1, "gamma delta"), (2, "alpha"), (3, "gamma delta")])
    both = S.Phrase(("alpha", "beta")) & S.Phrase(("gamma",))
    found = BA.matches(rows, BA.query_table(spark, {1: both, 2: S.Phrase(("gamma", "delta"))}))
    assert pairs(found) == [(1, 1), (2, 1), (2, 3)]


def test_a_posting_goes_once_for_all_phrases(spark, tmp_path):
    """An index: 60 phrases with one token in common do not multiply its places."""
    rows = entities(spark, [(i, " ".join(["the"] * 50 + [f"w{i}"])) for i in range(20)])
    I.write_index(rows, str(tmp_path), shards=4)
    index = I.open_index(spark, str(tmp_path))
    nodes = BA.query_table(spark, {i: S.Phrase(("the", f"w{i % 20}")) & S.Phrase(("the", "the", f"x{i}")) for i in range(30)})
    found = BA.matches(index, nodes)
    have = index.postings.where(F.col("token").rlike("^(the|w\\d+)$")).count()
    found.collect()
    records = _written(found._jdf.queryExecution().executedPlan())
    assert 0 < sum(records) <= have and pairs(found) == []


def _written(node):
    """Records that each shuffle of a plan wrote."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _written(node.executedPlan())
    inner = node.plan() if node.nodeName().endswith("QueryStage") else None
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if node.nodeName() == "Exchange" else []
    return own + [n for c in ([inner] if inner else [node.children().apply(i) for i in range(node.children().size())]) for n in _written(c)]
