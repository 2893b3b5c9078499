import sqlite3

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import tokens as T
from lexmill.jobs import catalog
from lexmill.operators import entities as E
from lexmill.operators import index as I
from lexmill.operators import search as S
from lexmill.operators import snippets as SN
from lexmill.operators import symbols as R
from lexmill.sources import trees

TOKENS = {"getUserById": "get User By Id", "user_name": "user name", "App\\Models\\User": "App T5cK Models T5cK User", "parseHTMLString": "parse HTMLString", "$obj->method()": "T24K obj T2dK T3eK method T28K T29K", 'say "hi"': "say T27K hi T27K", "user2Name": "user2Name", "_": ""}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in TOKENS], "x string").select("x", F.array_join(T.encode_symbols(T.raw_tokens(F.col("x"))), " ").alias("t")).collect()
    assert {r.x: r.t for r in rows} == TOKENS


def test_identifiers_and_types(spark):
    row = spark.createDataFrame([("$userId", "A|null", "/** Save it.\n * More.\n * @return int */")], "x string, t string, d string")
    got = row.select(T.split_identifier(F.col("x"))["searchable"].alias("s"), X.type_matches(F.col("t"), F.lit("A")).alias("a"), X.type_matches(F.col("t"), F.lit("null")).alias("n"), X.doc_summary(F.col("d")).alias("d1"), X.doc_description(F.col("d")).alias("d2")).first()
    assert tuple(got) == ("$userId $ user Id id $userid", True, False, "Save it.", "More.")


def test_blocks():
    found = list(E.python_entities("a.py", 'class A:\n    """Doc."""\n    def __init__(self):\n        def inner():\n            pass\n\ndef f():\n    pass\n'))
    assert [(e["type"], e["name"], e["class_name"], e["line_start"]) for e in found] == [("file", "a.py", "", 1), ("class", "A", "", 1), ("method", "__init__", "A", 3), ("function", "f", "", 7)]
    text = '{ a("}"); /* } */ } x'
    assert E.brace_end(text, 0) == len(text) - 2
    assert [e["name"] for e in E.brace_entities("a.js", "class B { run() { return 1 } }\nconst g = (x) => { y }", "javascript")][1:] == ["B", "run", "g"]


ROWS = [(1, "foo bar", "baz qux foo"), (2, "foo", "x y z"), (3, "q", "Bar foo bar"), (5, "nothing", "at all here"), (6, "more", "x z"), (7, "pad", "pad"), (8, "pad2", "pad3"), (9, "r r r", "z9")]


@pytest.mark.parametrize("sql,make", [
    ("bar", lambda s: S.term(s, "bar")),
    ("foo bar", lambda s: S.term(s, "foo") & S.term(s, "bar")),
    ("foo + bar", lambda s: S.phrase(s, "foo bar")),
    ("bar NOT baz", lambda s: S.term(s, "bar") - S.term(s, "baz")),
    ("bar baz OR foo", lambda s: (S.term(s, "bar") & S.term(s, "baz")) | S.term(s, "foo")),
    ("pad*", lambda s: S.prefix(s, "pad")),
    ("NEAR(foo bar, 1)", lambda s: S.Near((S.term(s, "foo"), S.term(s, "bar")), 1)),
    ("^foo", lambda s: S.term(s, "foo").initial()),
    ("a : foo", lambda s: S.term(s, "foo").in_fields("signature")),
    ("r + r", lambda s: S.phrase(s, "r r")),
])
def test_search_equals_fts5(spark, sql, make):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", ROWS)
    want = {i: round(x, 5) for i, x in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (sql,))}
    entities = spark.createDataFrame([(i, "", a, b, "", "", "") for i, a, b in ROWS], "id long, " + ", ".join(f"{f} string" for f in I.FIELDS))
    assert {r.id: round(r.score, 5) for r in S.rank_bm25(entities, make(spark)).collect()} == want


def test_css_rules_of_all_style_elements(spark, tmp_path):
    html = '<style>a {x}</style><STYLE type="text/css">\nb\n{y}\n</STYLE><style media=print>c {z}</style ><styled>d {w}</styled>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.selector, r.body) for r in catalog.QUERIES["css_rules"](spark, str(tmp_path)).collect()) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_detokenise_and_sizes(spark):
    rows = spark.createDataFrame([("get User By Id T28K T29K", "[get] User", "[T24K] [user]"), ("say T27K hi T27K", "x", "[a] [T2eK] [b]")], "a string, b string, c string")
    got = [tuple(r) for r in rows.select(T.detokenise(F.col("a")), T.detokenise(F.col("b"), "[", "]"), T.detokenise(F.col("c"), "[", "]")).collect()]
    assert got == [("getUserById()", "[get] User", "[$user]"), ("say'hi'", "x", "[a.b]")]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (2 << 20,), (5 << 40,)], "n long").select(X.humanise_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["0B", "1023B", "1.5KB", "2MB", "5120GB"]


def test_tree_is_read(spark, tmp_path):
    files = {"a/b.py": b"x = 1\n", "c.bin": b"PK\0\1", "d.txt": b"caf\xe9 \x80", "e.txt": b"ok \x81\xff \xc3\xa9"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = trees.drop_binary(trees.read_tree(spark, str(tmp_path)))
    got = {r.filename.rsplit("/", 1)[1]: (r.text, r.length) for r in read.select("filename", "length", trees.decode(F.col("content")).alias("text")).collect()}
    assert got == {"b.py": ("x = 1\n", 6), "d.txt": ("café €", 6), "e.txt": ("ok  é", 8)}


def test_stored_index_is_rebuilt_by_project(spark, tmp_path):
    schema = "id long, " + ", ".join(f"{f} string" for f in I.FIELDS) + ", project_root string"
    rows = [(i, "", a, b, "", "", "", f"/p{i % 2}") for i, a, b in ROWS]
    I.write_index(spark.createDataFrame(rows, schema), str(tmp_path))
    I.write_index(spark.createDataFrame([(9, "", "new", "bar", "", "", "", "/p1")], schema), str(tmp_path))
    stored = I.open_index(spark, str(tmp_path))
    left = [r for r in rows if r[-1] == "/p0"] + [(9, "", "new", "bar", "", "", "", "/p1")]
    entities = spark.createDataFrame(left, schema)
    for q in (S.term(spark, "bar"), S.phrase(spark, "x z"), S.prefix(spark, "pad") | S.term(spark, "new")):
        want = {(r.id, round(r.score, 9)) for r in S.rank_bm25(entities, q).collect()}
        assert {(r.id, round(r.score, 9)) for r in S.rank_bm25(stored, q).collect()} == want and want
    plan = S.matches(stored, S.term(spark, "bar"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,bar)" in plan
    assert {r.id for r in S.matches(I.open_index(spark, str(tmp_path), "/p1"), S.term(spark, "bar")).collect()} == {9}


def test_fragments_of_any_field(spark):
    pad = " ".join(["pad"] * 50)
    rows = [(1, f"{pad} getHitById x, Hit! {pad} hit", ""), (2, "none", "a hit"), (3, "hit hit", "hit hit hit"), (4, "é hit-or_hit", "")]
    entities = spark.createDataFrame([(i, "", sig, body, "", "", "") for i, body, sig in rows], "id long, " + ", ".join(f"{f} string" for f in I.FIELDS))
    places = SN.hit_places(entities, S.term(spark, "hit"))
    got = {r["id"]: tuple(r)[1:] for r in SN.snippets(entities.select("id"), entities, places, 7).collect()}
    assert got[1] == ("body", 51, 2, "...[Hit]ById x, [Hit]!...")
    assert got[2] == ("signature", 0, 1, "a [hit]") and got[3] == ("signature", 0, 3, "[hit] [hit] [hit]") and got[4] == ("body", 0, 2, "é [hit]-or_[hit]")
    empty = SN.snippets(entities.select("id"), entities, places.where("id = 1"), 7).where("id = 2").first()
    assert tuple(empty) == (2, None, None, 0, "")
    both = S.phrase(spark, "hit by") | S.term(spark, "none")
    assert {r["id"]: r["places"] for r in SN.hit_places(entities, both).collect()} == {1: [2 * I.FIELD_STEP + 51, 2 * I.FIELD_STEP + 52], 2: [2 * I.FIELD_STEP]}


def test_scripts_and_given_extractors(spark):
    files = spark.createDataFrame([("/a/run", "#!/usr/bin/env node\nx"), ("/a/b.md", "# t"), ("/a/c.zig", "x")], "filename string, content string")
    table = spark.createDataFrame([("", "script", 90), ("md", "notes", 10), ("md", "other", 5)], "ext string, extractor string, priority int")
    out = E.extract_all(files, table, {"notes": lambda f, t: [{"type": "note", "name": t}]}).collect()
    assert sorted((r.extractor, r.type, r.name) for r in out) == [("notes", "note", "# t"), ("script", "file", "run")]


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in R.closure(edges).collect()}
    assert got[("a", "a")] == 3 and got[("d", "c")] == 3 and got[("d", "a")] == 1 and len(got) == 12
    assert {(r.child, r.depth) for r in R.below(edges, "b").collect()} == {("a", 1), ("c", 2), ("d", 2), ("b", 3)}
