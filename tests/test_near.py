import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.operators import batch as BA
from lexmill.operators import index as I
from lexmill.operators import search as S

SCHEMA = "id long, preamble string, signature string, body string, namespace string, ext string, path string, project_root string"


def entity(i, body):
    return (i, "", "", body, "", "", "", "/p")


def held(parts, distance):
    """Plainly: starts from or to an end at which every part stands within the distance."""
    reach = lambda x, n, e: x + n >= e and x <= e + distance
    ends = [e for e in (x + n for s, n in parts for x in s) if all(any(reach(x, n, e) for x in s) for s, n in parts)]
    return [sorted(x for x in s if any(reach(x, n, e) for e in ends)) for s, n in parts]


def test_near_instances_equal_all_pairs():
    rng = random.Random(3)
    rows, far = [], []
    for _ in range(400):
        field = lambda: rng.choice([0, 0, 1, 5]) * I.FIELD_STEP
        rows.append([([field() + rng.randrange(40) for _ in range(rng.randrange(5))], rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))])
        far.append(rng.choice([0, 1, 3, 10, 1 << 40]))
    parts = pa.array([[{"starts": s, "size": n} for s, n in r] for r in rows], pa.list_(pa.struct({"starts": pa.list_(pa.int64()), "size": pa.int32()})))
    got = S._near_instances(parts, pa.array(far))
    for r, d, found in zip(rows, far, got, strict=True):
        assert [list(x) for x in found] == held(r, d), (r, d)
    assert S._near_instances(parts.slice(0, 0), pa.array([], pa.int64())) == []


def test_near_in_a_long_entity_is_not_quadratic(spark):
    """60,000 instances in one entity: all pairs of them would take minutes."""
    long = " ".join(["alpha"] * 30_000 + ["pad"] * 50 + ["beta"] * 30_000)
    rows = spark.createDataFrame([entity(1, long), entity(2, "alpha x beta"), entity(3, "alpha a b c d e f beta")], SCHEMA).cache()
    near = S.Near((S.Phrase(("alpha",)), S.Phrase(("beta",))), 3)
    S.matches(rows.where("id > 1"), near).collect()
    began = time.perf_counter()
    assert {r["id"] for r in S.matches(rows, near).collect()} == {2}
    assert {r["id"] for r in BA.matching(rows, BA.query_table(spark, {7: near})).collect()} == {2}
    assert time.perf_counter() - began < 40


def test_prefixes_of_a_batch_take_no_row_a_token(spark, tmp_path, monkeypatch):
    """A prefix that 3,000 tokens have: kept are rows of entities and of the queries, and the levels add no shuffle."""
    rows = [entity(i, " ".join(f"ab{i}x{k} cd" for k in range(1000)) + (" rare" if i == 1 else "")) for i in range(3)]
    I.write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path), shards=4)
    kept, plain = [], BA.checkpointed
    monkeypatch.setattr(BA, "checkpointed", lambda df: (out := plain(df), kept.append(out.count()))[0])
    begun = S.Phrase(("ab",), True)
    found = BA.matching(I.open_index(spark, str(tmp_path)), BA.query_table(spark, {1: (begun & S.Phrase(("cd",))) - S.Phrase(("rare",)), 2: begun.in_fields("path"), 3: begun}))
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(1, 0), (1, 2), (3, 0), (3, 1), (3, 2)}
    assert max(kept) < 100
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(query_id") == 1
    scores = {r["id"]: round(r["score"], 9) for r in found.where(F.col("query_id") == 3).collect()}
    assert scores == {r["id"]: round(r["score"], 9) for r in S.rank_bm25(I.open_index(spark, str(tmp_path)), begun).collect()}
