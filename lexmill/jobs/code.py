"""Registered queries over code of several shapes: regular expressions, template text, heredocs, deep CSS."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.jobs.catalog import query
from lexmill.jobs.fixtures import view
from lexmill.jobs.more import _LINES, _UP, _code, _lines, _up
from lexmill.operators import entities as E
from lexmill.operators import lines as LI
from lexmill.operators import symbols as R
from lexmill.sources import listing as L

_COLUMNS = ("filename", "type", "name", "class_name", "line_start", "line_end")

#: Three shapes by key; k stands for the key.
_JS_SHAPES = (
    r"concat('class A', k, ' {\n  a() { return s.replace(/[\'{]/g, ', k, ') }\n  b() { return 4 / 2 / 1 }\n}\nfunction c() { return /}/ }\n')",
    r"concat('/* { */ class A', k, ' extends B {\n  x = `a ${ f({ y: `}` }) } {`\n  get b() { return 1 }\n  c(z = {}) {\n    if (z) { d() }\n  }\n}\n')",
    r"concat('const t = \'it\n', 'function f', k, '() { return \"}\" }\nvar g = (a, b) => {\n  return a\n}\n')",
)
_PHP_SHAPES = (
    r"concat('<p>it\'s {</p>\n<?php\nclass A', k, ' {\n  function a() { return <<<X\n it\'s } \n X; }\n  function b() {}\n}\nfunction c() {}\n')",
    r"concat('<?php\ninterface A', k, ' { function a(); }\ntrait T { # it\'s {\n  private function b() { $f = function () { return 1; }; }\n}\n?> { <?php function c() {}\n')",
    r"concat('<?php\nenum E', k, ': string { case A = \"{\"; function a() { return \'}\'; } }\n$x = E::class; $y = new class { };\nfunction b() { return \"\n}\"; }\n')",
)


def _shapes(shapes) -> str:
    return "CASE p_partkey % 3 " + " ".join(f"WHEN {i} THEN {s.replace('k,', 'p_partkey,')}" for i, s in enumerate(shapes)) + " END"


def _twin(ending: str, rows: list[list[tuple]]) -> str:
    """The rows of each shape: (type, name or name in front of the key, class, first line, last line)."""
    lines = [f"({i}, '{t}', '{n}', '{c}', {a}, {b})" for i, shape in enumerate(rows) for t, n, c, a, b in shape]
    name = lambda x: f"CASE WHEN {x} LIKE '%*' THEN replace({x}, '*', k::VARCHAR) ELSE {x} END"
    return (
        f"WITH p AS (SELECT p_partkey AS k, concat('/src/P', p_partkey, '{ending}') AS filename FROM part), r(shape, type, name, class_name, line_start, line_end) AS (VALUES {', '.join(lines)}) "
        f"SELECT filename, type, {name('name')} AS name, {name('class_name')} AS class_name, line_start, line_end FROM p JOIN r ON shape = k % 3"
    )


@query(_twin(".js", [
    [("class", "A*", "", 1, 4), ("method", "a", "A*", 2, 2), ("method", "b", "A*", 3, 3), ("function", "c", "", 5, 5)],
    [("class", "A*", "", 1, 7), ("method", "b", "A*", 3, 3), ("method", "c", "A*", 4, 6)],
    [("function", "f*", "", 2, 2), ("arrow-function", "g", "", 3, 5)],
]))
def javascript_shapes(spark, sf_dir):
    return E.extract(_code(spark, sf_dir, _shapes(_JS_SHAPES), ".js"), "javascript").where("type <> 'file'").select(*_COLUMNS)


@query(_twin(".php", [
    [("class", "A*", "", 3, 8), ("method", "a", "A*", 4, 6), ("method", "b", "A*", 7, 7), ("function", "c", "", 9, 9)],
    [("interface", "A*", "", 2, 2), ("method", "a", "A*", 2, 2), ("trait", "T", "", 3, 5), ("method", "b", "T", 4, 4), ("function", "c", "", 6, 6)],
    [("enum", "E*", "", 2, 2), ("method", "a", "E*", 2, 2), ("function", "b", "", 4, 5)],
]))
def php_shapes(spark, sf_dir):
    return E.extract(_code(spark, sf_dir, _shapes(_PHP_SHAPES), ".php"), "php").where("type <> 'file'").select(*_COLUMNS)


@query("SELECT concat('/src/P', p_partkey, '.css') AS filename, CAST(p_size % 12 AS BIGINT) AS n_media, CAST(1 + p_size % 5 AS BIGINT) AS n_rules FROM part")
def css_deep(spark, sf_dir):
    """At-rules in up to eleven levels around rules with braces in their text."""
    text = "concat(repeat('@media m { ', p_size % 12), repeat('a > b { content: \"}\" /* { */ }\n', 1 + p_size % 5), repeat(' }', p_size % 12))"
    found = E.css_rules(_code(spark, sf_dir, text, ".css"))
    return found.groupBy("filename").agg(F.count_if(F.col("type") == "css-media-query").alias("n_media"), F.count_if(F.col("type") == "css-rule").alias("n_rules"))


_EDGES = (
    "WITH RECURSIVE e0 AS (SELECT DISTINCT child, parent FROM fx_type_edges), "
    "e AS (SELECT child, parent FROM e0 WHERE (length(child) + length(parent)) % 7 <> 0 UNION SELECT concat('N', p_size), concat('C', p_size) FROM part), "
    "w(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT w.child, e.parent, w.depth + 1 FROM w JOIN e ON w.ancestor = e.child WHERE w.depth < 40) "
)


@query(_EDGES + "SELECT child, ancestor, min(depth) AS depth FROM w GROUP BY child, ancestor")
def closure_updated(spark, sf_dir):
    """The class graph's closure after some edges are removed and others added, without a fresh one."""
    edges = view(spark, sf_dir, "fx_type_edges").select("child", "parent").distinct()
    odd = (F.length("child") + F.length("parent")) % 7 == 0
    known = R.closure_without(R.closure(edges), edges.where(~odd), edges.where(odd))
    size = F.col("p_size").cast("string")
    added = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("N"), size).alias("child"), F.concat(F.lit("C"), size).alias("parent")).distinct()
    return R.closure_with(known, added)


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS n_rows FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND lang <> 'de' AND NOT (lang = 'fr' AND source LIKE 'src1_') GROUP BY lang, source")
def listed_tree(spark, sf_dir):
    """The documents' ids as files by language and source; the rows of the files that a listing with ignore rules finds."""
    base = f"{R.shared_folder(spark)}/tree-{uuid.uuid4()}"
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL AND source IS NOT NULL").select("lang", "source", F.col("doc_id").cast("string").alias("value"))
    ids.write.partitionBy("lang", "source").text(base)
    root = base.removeprefix("file:").replace("///", "/")
    rules = [(root, 1, "lang=de/"), (f"{root}/lang=fr", 1, "source=src1?/"), (root, 2, "_*"), (root, 3, ".*")]
    files = L.list_tree(spark, root, rules, content=True)
    part = lambda c: F.regexp_extract("filename", f"/{c}=([^/]*)/", 1).alias(c)
    lines = files.select(part("lang"), part("source"), F.explode(F.split(F.trim(F.regexp_replace(F.col("content").cast("string"), "\n$", "")), "\n")).alias("line"))
    return lines.groupBy("lang", "source").agg(F.count("*").alias("n_rows"))


@query(f"WITH {_LINES} SELECT kind, line FROM lines WHERE regexp_matches(line, '(?i)(CLASS|trait) [ct][0-9]*1$|::a[0-9]_3$|tion f[0-9]*77')")
def find_symbols_stored(spark, sf_dir):
    """A regular expression over the stored lines, by their trigrams."""
    path = LI.line_folder(spark)
    LI.write_lines(_lines(spark, sf_dir), path)
    return LI.find_lines(spark, path, "(CLASS|trait) [ct][0-9]*1$|::a[0-9]_3$|tion f[0-9]*77", ignore_case=True)


_LINE = (
    "a AS (SELECT *, owner AS declared_in, 0 AS depth FROM fx_values UNION ALL SELECT c.child, m.kind, m.member, m.visibility, m.is_static, m.is_readonly, m.type_expr, m.value, c.ancestor, c.depth FROM c JOIN fx_values m ON m.owner = c.ancestor), "
    "h AS (SELECT * FROM a WHERE kind <> 'method' QUALIFY row_number() OVER (PARTITION BY owner, kind, member ORDER BY depth, declared_in) = 1), "
    "l AS (SELECT f.fqn, f.kind = 'enum' AND h.kind = 'constant' AS is_case, h.kind, member, is_static, value, declared_in, CASE WHEN f.kind = 'enum' AND h.kind = 'constant' THEN concat('case ', member, coalesce(' = ' || value, '')) WHEN h.kind = 'constant' THEN concat('constant ', member, ' = ', coalesce(value, 'NULL')) "
    "ELSE concat('property ', visibility, ' ', CASE WHEN is_static THEN 'static ' ELSE '' END, CASE WHEN h.is_readonly THEN 'readonly ' ELSE '' END, coalesce(type_expr, 'mixed'), ' $', member) END AS line FROM h JOIN fx_class_flags f ON f.fqn = h.owner) "
)


@query(f"{_UP} {_LINE} SELECT fqn, CASE WHEN is_case THEN 'case' ELSE kind END AS kind, member, line, CASE WHEN kind = 'property' AND is_static THEN value END AS default_value, CASE WHEN declared_in <> fqn THEN declared_in ELSE '' END AS origin FROM l")
def value_pages(spark, sf_dir):
    """The pages of all constants, enum cases and properties."""
    return R.value_lines(view(spark, sf_dir, "fx_values"), view(spark, sf_dir, "fx_class_flags"), _up(spark, sf_dir))


@query(
    f"{_UP} {_LINE}, g AS (SELECT fqn, " + ", ".join(f"coalesce(string_agg(line, '; ' ORDER BY line) FILTER ({w}), '') AS {n}" for n, w in (("cases", "is_case"), ("constants", "kind = 'constant' AND NOT is_case"), ("properties", "kind = 'property'"))) + " FROM l GROUP BY fqn), "
    "w(child, ancestor) AS (SELECT child, parent FROM fx_type_edges UNION SELECT w.child, e.parent FROM w JOIN fx_type_edges e ON e.child = w.ancestor), "
    "p AS (SELECT child AS fqn, min(parent) AS parent FROM fx_type_edges WHERE rel = 'extends' GROUP BY child), "
    "i AS (SELECT child AS fqn, string_agg(DISTINCT ancestor, ',' ORDER BY ancestor) AS interfaces FROM w WHERE ancestor IN (SELECT parent FROM fx_type_edges WHERE rel = 'implements') GROUP BY child), "
    "u AS (SELECT child AS fqn, string_agg(DISTINCT parent, ',' ORDER BY parent) AS traits FROM fx_type_edges WHERE rel = 'uses' GROUP BY child) "
    "SELECT f.fqn, f.kind, concat_ws(' ', CASE WHEN is_final THEN 'final' END, CASE WHEN is_abstract THEN 'abstract' END, CASE WHEN is_readonly THEN 'readonly' END, f.kind, f.fqn) AS head, trim(replace(replace(doc, '/** ', ''), ' */', '')) AS summary, "
    "coalesce(parent, '') AS parent, coalesce(interfaces, '') AS interfaces, coalesce(traits, '') AS traits, coalesce(cases, '') AS cases, coalesce(constants, '') AS constants, coalesce(properties, '') AS properties "
    "FROM fx_class_flags f LEFT JOIN p USING (fqn) LEFT JOIN i USING (fqn) LEFT JOIN u USING (fqn) LEFT JOIN g USING (fqn)"
)
def class_sheets(spark, sf_dir):
    """Whole class pages: modifiers, relations, cases, constants and properties with their values."""
    edges = view(spark, sf_dir, "fx_type_edges")
    closed = R.closure(edges.select("child", "parent").distinct())
    return R.class_sheets(view(spark, sf_dir, "fx_class_flags"), edges, closed, view(spark, sf_dir, "fx_values"), _up(spark, sf_dir))
