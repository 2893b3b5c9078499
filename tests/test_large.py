"""What only larger tables show: sums beyond a long, batches, joins that multiply."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.jobs import catalog, more  # noqa: F401
from lexmill.llm import tables
from lexmill.operators import entities as E
from lexmill.operators import index as I
from lexmill.operators import search as S
from lexmill.operators import symbols as R


def test_sizes_of_large_keys(spark, tmp_path):
    keys = [(1, 100.5), (36_000_000, 499993.18)]
    spark.createDataFrame(keys, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r["size"] for r in catalog.QUERIES["humanise_bytes"](spark, str(tmp_path)).collect()}
    n = int(499993.18 * 36_000_000 * 36_000_000 * 7) % 9_000_000_000_000
    assert got == {1: "703B", 36_000_000: f"{n / 1024**3:.1f}".removesuffix(".0") + "GB"}


def test_counted_keys_with_ties(spark):
    """The commonest keys are found twice, on a cluster from rows in any order: ties must not be left open."""
    rows = spark.range(1000).withColumnRenamed("id", "k")
    joined = tables.join_counted(rows, tables.checkpointed(rows.withColumn("n", F.lit(1))), ["k"], heavy=5)
    assert joined.count() == joined.select("k").distinct().count() == 1000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [n#") == plan.count("DESC NULLS LAST, k#") == 2


def test_heirs_on_a_cycle(spark):
    """A type on a cycle is not between itself and its heirs: only what the heir declares is there."""
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "B"), ("D", "C")], "child string, parent string")
    methods = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("C", "x"), ("D", "z")], "owner string, member string")
    got = {(r.type, r.owner): (r.n_required, r.n_present) for r in R.compatible_heirs(methods, R.closure(edges)).collect()}
    # D has C and the cycle above it; B lies below A.
    assert got == {("A", "B"): (2, 1), ("B", "A"): (1, 1), ("A", "C"): (2, 2), ("B", "C"): (1, 1), ("A", "D"): (2, 2), ("B", "D"): (1, 1), ("C", "D"): (1, 0)}


def test_inherited_lie_with_their_heir(spark):
    """Members of one class go to its heirs in one row, and names of one class alone need no nearness."""
    edges = spark.createDataFrame([("B", "A"), ("C", "B")], "child string, parent string")
    members = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("C", "z")], "owner string, member string")
    found = R.inherited(members, R.closure(edges))
    assert sorted(map(tuple, found.collect())) == [("A", "x", "A", 0), ("A", "y", "A", 0), ("B", "x", "A", 1), ("B", "y", "B", 0), ("C", "x", "A", 2), ("C", "y", "B", 1), ("C", "z", "C", 0)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(found) and not re.search(r"hashpartitioning\(owner#\w+, member#", plan(found))
    some = lambda *rows: spark.createDataFrame(rows, "owner string, member string")
    assert sorted(map(tuple, R.counted_under_heirs(some(("A", "y")), members, R.closure(edges)).collect())) == [("A", "y", "A")]
    single = R.counted_under_heirs(some(("A", "x")), members, R.closure(edges))
    assert sorted(map(tuple, single.collect())) == [("A", "x", "A"), ("B", "x", "A"), ("C", "x", "A")] and "Aggregate" not in plan(single)


def test_batches_of_postings_are_bounded(spark):
    """Many and long entities are covered in runs of bounded tokens, with the postings of one pass."""
    sizes = [len(p) for p in I._parts(pa.RecordBatch.from_pydict({"tokens": pa.array([[0] * (I.PASS_TOKENS // 2)] * 5 + [[0] * (2 * I.PASS_TOKENS)] + [None, []])}))]
    assert sizes == [2, 2, 1, 1, 2]
    blank = {f: "" for f in I.FIELDS}
    rows = spark.createDataFrame([{"id": i} | blank | {"body": f"a b{i % 7} a"} for i in range(3000)], "id long, " + ", ".join(f"{f} string" for f in I.FIELDS)).coalesce(1)
    found = I.term_stats(I.postings(rows))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= I.BATCH_ROWS
    assert {r.token: (r.df, r.cf) for r in found.where("token IN ('a', 'b3')").collect()} == {"a": (3000, 6000), "b3": (429, 429)}


def test_small_files_are_dealt_out(spark):
    files = spark.createDataFrame([(f"/p{i}.js", f"function f{i}() {{ return 1 }}\n") for i in range(200)], "filename string, content string").coalesce(1)
    out = E.extract(files, "javascript").select("filename", "name", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in out}) > 1 and {r.name for r in out if r.name.startswith("f")} == {f"f{i}" for i in range(200)}


def test_many_searches_deal_postings_out_once(spark):
    blank = {f: "" for f in I.FIELDS}
    texts = ["thin line of ink", "thin thin paper", "of the line", "ink"]
    entities = spark.createDataFrame([{"id": i} | blank | {"body": t} for i, t in enumerate(texts)], "id long, " + ", ".join(f"{f} string" for f in I.FIELDS))
    asked = spark.createDataFrame([(1, ["thin", "ink"]), (2, ["line", "of"])], "query_id int, tokens array<string>")
    found = S.search_many(entities, asked, percent=60)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 0), (2, 0), (2, 2)]
    assert not re.search(r"hashpartitioning\(query_id#\w+, id#", found._jdf.queryExecution().executedPlan().toString())
