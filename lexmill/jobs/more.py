"""More registered queries with their DuckDB twins: decoding, entities of all kinds, members, pages, maintenance, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import tokens as T
from lexmill.jobs.catalog import _CLOSED, _DIFF, _DISTINCT, _HAS, _TOK, _WORDS, _change_stream, _edges, _enc, _raw, index, query
from lexmill.jobs.fixtures import NOW, view
from lexmill.operators import entities as E
from lexmill.operators import files as FI
from lexmill.operators import index as I
from lexmill.operators import maintain as M
from lexmill.operators import search as S
from lexmill.operators import symbols as R
from lexmill.sources import trees
from lexmill.streaming import changes as C

# --- sources and entities ---------------------------------------------------------------------------------------


@query(
    "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id % 50 <> 0) "
    "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 AND NOT regexp_matches(text, '[^\\x00-\\xFF]') AND regexp_matches(text, '[^\\x00-\\x7F]') THEN concat('caf', chr(233), ' ', chr(8364), ' ', text) ELSE text END) AS digest FROM d"
)
def decode_files(spark, sf_dir):
    """Files as bytes: every 50th has a NUL, a third of those that Latin-1 can hold are in Windows-1252."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    single = (F.col("doc_id") % 3 == 1) & ~F.col("text").rlike(r"[^\x00-\xFF]") & F.col("text").rlike(r"[^\x00-\x7F]")
    old = F.concat(F.lit(bytearray(b"caf\xe9 \x80 ")), F.encode("text", "ISO-8859-1"))
    content = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit(bytearray(b"PK\0")), F.col("text").cast("binary"))).when(single, old).otherwise(F.col("text").cast("binary"))
    files = trees.drop_binary(d.select("doc_id", content.alias("content")))
    return files.select("doc_id", F.md5(trees.decode(F.col("content"))).alias("digest"))


@query("SELECT filename, md5(content) AS file_hash, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS n_lines, CAST(length(content) AS BIGINT) AS n_chars, filetime AS mtime, entry_count FROM fx_files")
def fingerprint_full(spark, sf_dir):
    return trees.fingerprint(view(spark, sf_dir, "fx_files").withColumnRenamed("filetime", "mtime"))


@query("SELECT filename, 'file' AS type, 1 AS line_start, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INT) AS line_end, md5(content) AS digest FROM fx_files")
def file_entities(spark, sf_dir):
    return E.file_entities(view(spark, sf_dir, "fx_files")).select("filename", "type", "line_start", "line_end", F.md5("body").alias("digest"))


@query("SELECT id, md5(left(body, 1000)) AS digest FROM fx_entities")
def cap_body(spark, sf_dir):
    return view(spark, sf_dir, "fx_entities").select("id", F.md5(X.cap_body(F.col("body"), 1000)).alias("digest"))


_PART = "regexp_extract(filename, 'Part[0-9]+')"


@query(
    f"WITH f AS (SELECT filename, {_PART} AS part, split_part(content, chr(10), 3) AS head, substr(split_part(content, chr(10), 2), 3) AS doc FROM fx_code_files WHERE lower(right(filename, 3)) = '.py') "
    "SELECT filename, 'file' AS type, regexp_extract(filename, '[^/]*$') AS name, '' AS class_name, filename AS signature, '' AS docblock, '' AS visibility, 1 AS line_start, 7 AS line_end FROM f UNION ALL "
    "SELECT filename, 'class', part, '', rtrim(head, ':'), concat('# ', doc, chr(10), doc), 'public', 3, 7 FROM f UNION ALL SELECT filename, 'method', 'getPriceById', part, 'def getPriceById(self, part_id)', '', 'public', 5, 7 FROM f"
)
def python_entities(spark, sf_dir):
    out = E.extract(view(spark, sf_dir, "fx_code_files").where("lower(right(filename, 3)) = '.py'"), "python")
    return out.select("filename", "type", "name", "class_name", "signature", "docblock", "visibility", "line_start", "line_end")


def _code(spark, sf_dir, text: str, ending: str):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("/src/P"), "p_partkey", F.lit(ending)).alias("filename"), F.expr(text).alias("content"))


_JS = """concat('/** About ', p_name, ' */\nexport class P', p_partkey, ' extends Base {\n  // a } here\n  #hidden(x) { return \"}\"; }\n  run() {\n    if (this.x) { go(); }\n  }\n}\nfunction f', p_partkey, '(a, b) { return a }\nconst g = async (x) => { y }\n')"""


@query(
    "WITH p AS (SELECT concat('/src/P', p_partkey, '.js') AS filename, p_partkey AS k, p_name FROM part) "
    "SELECT filename, 'file' AS type, concat('P', k, '.js') AS name, '' AS class_name, filename AS signature, '' AS docblock, 'public' AS visibility, 1 AS line_start, 11 AS line_end FROM p "
    "UNION ALL SELECT filename, 'class', concat('P', k), '', concat('export class P', k, ' extends Base'), concat('/** About ', p_name, ' */'), 'public', 2, 8 FROM p "
    "UNION ALL SELECT filename, 'method', '#hidden', concat('P', k), '#hidden(x)', '', 'private', 4, 4 FROM p UNION ALL SELECT filename, 'method', 'run', concat('P', k), 'run()', '', 'public', 5, 7 FROM p "
    "UNION ALL SELECT filename, 'function', concat('f', k), '', concat('function f', k, '(a, b)'), '', 'public', 9, 9 FROM p UNION ALL SELECT filename, 'arrow-function', 'g', '', 'const g = async (x) =>', '', 'public', 10, 10 FROM p"
)
def javascript_entities(spark, sf_dir):
    out = E.extract(_code(spark, sf_dir, _JS, ".js"), "javascript")
    return out.select("filename", "type", "name", "class_name", "signature", "docblock", F.when(F.col("type") == "file", "public").otherwise(F.col("visibility")).alias("visibility"), "line_start", "line_end")


_PHP = """concat('<?php\nnamespace App', chr(92), 'N', p_partkey % 7, ';\n/** The ', p_name, '. */\nfinal class P', p_partkey, ' extends Base {\n    # a } here\n    private function one(int $a): ?string { return \"{\"; }\n    abstract protected function two();\n}\ninterface I', p_partkey, ' { public function three(); }\nfunction f', p_partkey, '() { return 1; }\n')"""


@query(
    "WITH p AS (SELECT concat('/src/P', p_partkey, '.php') AS filename, p_partkey AS k, concat('App', chr(92), 'N', p_partkey % 7) AS namespace, p_name FROM part) "
    "SELECT filename, 'file' AS type, concat('P', k, '.php') AS name, namespace, '' AS class_name, filename AS signature, '' AS docblock, 'public' AS visibility, 1 AS line_start, 11 AS line_end FROM p "
    "UNION ALL SELECT filename, 'class', concat('P', k), namespace, '', concat('final class P', k, ' extends Base'), concat('/** The ', p_name, '. */'), 'public', 4, 8 FROM p "
    "UNION ALL SELECT filename, 'method', 'one', namespace, concat('P', k), 'private function one(int $a): ?string', '', 'private', 6, 6 FROM p UNION ALL SELECT filename, 'method', 'two', namespace, concat('P', k), 'abstract protected function two()', '', 'protected', 7, 7 FROM p "
    "UNION ALL SELECT filename, 'interface', concat('I', k), namespace, '', concat('interface I', k), '', 'public', 9, 9 FROM p UNION ALL SELECT filename, 'method', 'three', namespace, concat('I', k), 'public function three()', '', 'public', 9, 9 FROM p "
    "UNION ALL SELECT filename, 'function', concat('f', k), namespace, '', concat('function f', k, '()'), '', 'public', 10, 10 FROM p"
)
def php_entities(spark, sf_dir):
    out = E.extract(_code(spark, sf_dir, _PHP, ".php"), "php")
    return out.select("filename", "type", "name", "namespace", "class_name", "signature", "docblock", F.when(F.col("type") == "file", "public").otherwise(F.col("visibility")).alias("visibility"), "line_start", "line_end")


_CSS = """concat('a', p_partkey, ' { color: red }\n@media print { p { x: 1 } b, i { y: ', p_size, ' } }\n@supports (x: y) { @media (min-width: 9px) { u { z: 2 } } }\n@keyframes k { from { a: 1 } }')"""


@query(
    "WITH p AS (SELECT concat('/src/P', p_partkey, '.css') AS filename, p_partkey AS k, p_size AS s FROM part) SELECT filename, concat('a', k) AS selector, 'css-rule' AS type FROM p WHERE k % 9 <> 0 "
    "UNION ALL SELECT filename, unnest(['@media print', 'p', 'b, i', '@supports (x: y)', '@media (min-width: 9px)', 'u', '@keyframes k', 'from']), unnest(['css-media-query', 'css-rule', 'css-rule', 'css-at-rule', 'css-media-query', 'css-rule', 'css-keyframes', 'css-rule']) FROM p WHERE k % 9 <> 0 "
    "UNION ALL SELECT filename, concat('P', k, '.css'), 'file' FROM p WHERE k % 9 = 0"
)
def css_nested(spark, sf_dir):
    files = _code(spark, sf_dir, f"CASE WHEN p_partkey % 9 = 0 THEN '/* none */' ELSE {_CSS} END", ".css")
    return E.css_rules(files).select("filename", "selector", "type")


_SHEBANGS = ("/usr/bin/php", "/usr/bin/env python3", "/usr/bin/env node", "/bin/bash", "/bin/sh", "/usr/bin/env ruby", "/usr/bin/perl -w", "/opt/tool")


@query("SELECT p_partkey, ['php', 'python', 'javascript', 'bash', 'bash', 'ruby', 'perl', 'script'][p_partkey % 8 + 1] AS language FROM part WHERE p_partkey % 9 <> 0")
def script_languages(spark, sf_dir):
    line = F.element_at(F.array(*[F.lit(f"#!{x}\nrest") for x in _SHEBANGS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.script_language(F.when(F.col("p_partkey") % 9 == 0, "no script").otherwise(line)).alias("language"))
    return rows.where("language IS NOT NULL")


_KIND = "CASE lower(right(filename, 3)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' ELSE 'script' END"


@query(
    f"SELECT filename, {_KIND} AS extractor, CASE WHEN {_KIND} = 'python' THEN 3 ELSE 1 END AS n, CASE WHEN {_KIND} = 'javascript' THEN 'javascript' ELSE 'python' END AS language, CASE WHEN filename LIKE '%7.js' THEN 1 ELSE 0 END AS n_errors FROM fx_code_files WHERE filename NOT LIKE '%7.js' "
    "UNION ALL SELECT filename, 'javascript', 1, NULL, 1 FROM fx_code_files WHERE filename LIKE '%7.js'"
)
def extract_all(spark, sf_dir):
    """Each file goes to the extractor of its extension; a file that its extractor cannot read is recorded."""

    def picky(name, text):
        if name.endswith("7.js"):
            raise ValueError("unreadable")
        return E.brace_entities(name, text, "javascript")

    out = E.extract_all(view(spark, sf_dir, "fx_code_files"), FI.registry(spark), {"javascript": picky})
    return out.groupBy("filename", "extractor").agg(F.count("*").cast("int").alias("n"), F.max("language").alias("language"), F.count("error").cast("int").alias("n_errors"))


@query("SELECT ext, CAST(count(filename) AS BIGINT) AS n_files FROM (VALUES " + ", ".join(f"('{e}')" for e in sorted({e for _, _, es in FI.EXTRACTORS for e in es})) + ") t(ext) LEFT JOIN fx_code_files ON ext = lower(regexp_extract(filename, '\\.([^./]+)$', 1)) GROUP BY ext")
def supported_extensions(spark, sf_dir):
    """How many files each supported extension has."""
    files = view(spark, sf_dir, "fx_code_files").select("filename", X.extension(F.col("filename")).alias("ext"))
    return FI.supported_extensions(FI.registry(spark)).join(files, "ext", "left").groupBy("ext").agg(F.count("filename").alias("n_files"))


# --- tokens and texts -------------------------------------------------------------------------------------------


@query(
    f"WITH t AS (SELECT doc_id, array_to_string(list_transform({_raw('text')}, lambda t: CASE WHEN regexp_matches(t, '^[^\\p{{L}}\\p{{N}}]$') THEN concat(chr(1), CASE WHEN t = chr(34) THEN chr(39) ELSE t END, chr(1)) ELSE t END), ' ') AS x FROM documents), "
    "u AS (SELECT doc_id, regexp_replace(x, concat(' ?', chr(1), '+ ?'), '', 'g') AS x FROM t) "
    "SELECT doc_id, md5(regexp_replace(regexp_replace(x, '(\\p{Ll}) (\\p{Lu}\\p{Ll})', '\\1\\2', 'g'), '(\\p{Ll}) (\\p{Lu}\\p{Ll})', '\\1\\2', 'g')) AS digest FROM u"
)
def detokenise(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(T.detokenise(F.array_join(T.encode_symbols(T.raw_tokens(F.col("text"))), " "))).alias("digest"))


@query(
    "WITH m AS (SELECT p_partkey, regexp_extract_all(concat('$part->get', p_partkey, '(', p_name, ') => ', p_type), '[a-zA-Z_][a-zA-Z0-9_]*') AS m FROM part), "
    f"e AS (SELECT p_partkey, flatten(list_transform(m, lambda w: list_concat([w], {_DISTINCT.format(x=_raw('w'))}))) AS t FROM m), d AS (SELECT p_partkey, {_DISTINCT.format(x='t')} AS t FROM e), "
    "l AS (SELECT p_partkey, flatten(list_transform(t, lambda y: [y, lower(y)])) AS t FROM d) "
    f"SELECT p_partkey, array_to_string({_DISTINCT.format(x='t')}, ' ') AS words FROM l"
)
def identifiers_in(spark, sf_dir):
    line = F.concat(F.lit("$part->get"), "p_partkey", F.lit("("), "p_name", F.lit(") => "), "p_type")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.identifiers_in(line).alias("words"))


@query(
    "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x00-\\x7F]') AND regexp_matches(c, '[^\\p{L}\\p{N}]') THEN concat('x', hex(encode(c))) ELSE c END), '')) AS digest FROM (SELECT doc_id, concat(text, chr(8364), chr(169), chr(233)) AS text FROM documents)"
)
def encode_odd(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(T.encode_odd(F.concat("text", F.lit("€©é")))).alias("digest"))


def _words_sql(key: str, text: str, table: str) -> str:
    """The searchable words of a snippet."""
    return (
        f"l AS (SELECT {key}, regexp_extract_all({text}, '[a-zA-Z_$@#][a-zA-Z0-9_]*|->|=>|::|[^\\s]+') AS m FROM {table}), e AS (SELECT {key}, unnest(m) AS w, unnest(range(len(m))) AS i FROM l), "
        f"p AS (SELECT {key}, i, trim(w) AS w, list_filter({_raw('trim(w)')}, lambda t: t NOT IN ('_', '-', '.', chr(92), '/')) AS t0 FROM e), q AS (SELECT {key}, i, list_concat([w], {_DISTINCT.format(x='t0')}) AS t FROM p), "
        f"r AS (SELECT {key}, i, list_filter(list_transform(list_filter(t, lambda y: trim(y) <> '' AND y NOT IN (';', ',', '.', ':', '=')), lambda y: " + _WORDS.replace("{t}", "y") + "), lambda y: y IS NOT NULL) AS n0 FROM q), "
        f"s AS (SELECT {key}, i, {_DISTINCT.format(x='n0')} AS n FROM r), u AS (SELECT {key}, i, flatten(list_transform(n, lambda y: CASE WHEN lower(y) IN ('dollar', 'arrow', 'at') THEN [y] ELSE [y, lower(y)] END)) AS a FROM s), "
        f"v AS (SELECT {key}, flatten(list(a ORDER BY i)) AS a FROM u GROUP BY {key}), words AS (SELECT {key}, coalesce(array_to_string({_DISTINCT.format(x='a')}, ' '), '') AS words FROM v)"
    )


@query("WITH " + _words_sql("p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('function getPart', p_size, '(', p_type, ' $x): ', p_brand) END", "part") + " SELECT p.p_partkey AS id, concat('getPart', p_partkey, ' get Part', p_partkey, ' part', p_partkey) AS name_words, coalesce(words, '') AS signature_words FROM part p LEFT JOIN words USING (p_partkey)")
def searchable_columns(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    signature = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("function getPart"), "p_size", F.lit("("), "p_type", F.lit(" $x): "), "p_brand"))
    out = T.with_searchable(part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("getPart"), "p_partkey").alias("name"), signature.alias("signature")))
    lower = F.array_join(F.filter(F.split("name_words", " "), lambda w: ~w.isin("getpart")), " ")
    return out.select("id", F.array_join(F.filter(F.split(lower, " "), lambda w: w != F.concat(F.lit("getpart"), F.col("id"))), " ").alias("name_words"), "signature_words")


@query(
    "WITH n AS (SELECT o_orderkey, CAST(o_totalprice * o_orderkey * o_orderkey * 7 AS BIGINT) % 9000000000000 AS n FROM orders), s AS (SELECT o_orderkey, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS k FROM n) "
    "SELECT o_orderkey, concat(regexp_replace(printf('%.1f', round(n / pow(1024, k), 1)), '\\.0$', ''), ['B', 'KB', 'MB', 'GB'][k + 1]) AS size FROM s"
)
def humanise_bytes(spark, sf_dir):
    # The remainder is taken of the double, where it is exact: the product of large keys is beyond a long.
    n = F.expr("CAST(o_totalprice * o_orderkey * o_orderkey * 7 % 9000000000000D AS BIGINT)")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", X.humanise_bytes(n).alias("size"))


# --- searches ---------------------------------------------------------------------------------------------------


@query(f"WITH {_TOK} SELECT id FROM (({_HAS.format(t='thin')} UNION {_HAS.format(t='und')}) INTERSECT {_HAS.format(t='of')}) EXCEPT (SELECT a.id FROM tok a JOIN tok b ON a.id = b.id WHERE a.token = 'that' AND b.token = 'is')")
def search_grouped(spark, sf_dir):
    t = lambda x: S.term(spark, x)
    return S.matches(index(spark, sf_dir), ((t("thin") | t("und")) & t("of")) - (t("that") & t("is")))


@query(
    f"WITH {_TOK}, h AS ({_HAS.format(t='of')}) SELECT id, concat(filename, ':', line_start, '-', line_end) AS place, CASE WHEN length(body) > length(signature) THEN body END AS shown FROM fx_entities WHERE id IN (SELECT id FROM h)"
)
def format_hits(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entities")
    hits = e.join(S.matches(index(spark, sf_dir), S.term(spark, "of")), "id", "left_semi").withColumn("snippet", F.col("body"))
    return S.format_hits(hits).select("id", "place", "shown")


@query(
    f"WITH {_TOK} SELECT id, filename FROM fx_entities WHERE id IN ({_HAS.format(t='of')}) AND NOT starts_with(filename, '/corpus/src1/de/') AND NOT (starts_with(filename, '/corpus/src2/') AND NOT starts_with(filename, '/corpus/src2/en/')) "
    "AND NOT regexp_matches(filename, '^/corpus/src3/en/1[^/]\\.md') AND NOT regexp_matches(filename, '^/corpus/src3/fr/(.*/)[12][^/]*\\.md') AND NOT starts_with(filename, '/corpus/src4/es')"
)
def search_visible(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entities").select("id", "filename")
    hits = e.join(S.matches(index(spark, sf_dir), S.term(spark, "of")), "id", "left_semi")
    return S.visible(hits, view(spark, sf_dir, "fx_ignore_rules")).select("id", "filename")


@query("SELECT count(*) AS n_entities, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM fx_entities WHERE filename IN (SELECT filename FROM fx_files WHERE project_root = '/corpus/src7')")
def entities_of_project(spark, sf_dir):
    own = view(spark, sf_dir, "fx_files").where("project_root = '/corpus/src7'").select("filename")
    return view(spark, sf_dir, "fx_entities").join(own, "filename", "left_semi").agg(F.count("*").alias("n_entities"), F.sum(F.length("body")).alias("n_chars"))


@query("SELECT filename AS path FROM fx_files WHERE language = 'de' UNION ALL SELECT filename FROM fx_files WHERE language <> 'de' AND project_root IN ('/corpus/src1', '/corpus/src2')")
def inside_project(spark, sf_dir):
    roots = view(spark, sf_dir, "fx_projects").where("project_name IN ('de', 'src1', 'src2')").select("project_root")
    return FI.inside_project(view(spark, sf_dir, "fx_files").select(F.col("filename").alias("path")), roots)


@query("SELECT filename FROM fx_code_files WHERE NOT regexp_matches(filename, '/(vendor|[.]cache)/') AND NOT regexp_matches(filename, '^/code/p3/.*[.]js$')")
def visible_code(spark, sf_dir):
    """Local rules that include vendor/ again do not lift the directories that are never entered."""
    rules = spark.createDataFrame([("/code", 1, "!vendor/"), ("/code/p3", 1, "*.js")], "dir string, rule_no int, pattern string")
    return FI.apply_ignore_rules(view(spark, sf_dir, "fx_code_files").select("filename"), rules, skip_dirs=True)


# --- maintenance ------------------------------------------------------------------------------------------------

_OWNED = "SELECT id, filename, concat('/corpus/', namespace) AS project_root, signature, body FROM fx_entities"


def _owned(spark, sf_dir):
    return view(spark, sf_dir, "fx_entities").select("id", "filename", F.concat(F.lit("/corpus/"), F.col("namespace")).alias("project_root"), "signature", "body")


@query(f"WITH e AS ({_OWNED}) SELECT id, filename, CASE WHEN project_root = '/corpus/src3' THEN concat('new ', signature) ELSE signature END AS signature FROM e WHERE project_root <> '/corpus/src3' OR id % 5 <> 0")
def rebuild_project(spark, sf_dir):
    e = _owned(spark, sf_dir)
    fresh = e.where("id % 5 <> 0").withColumn("signature", F.concat(F.lit("new "), "signature"))  # as if read again: other projects' rows are not taken
    return M.rebuild_project(e, fresh, "/corpus/src3").select("id", "filename", "signature")


_NEW = "n AS (SELECT CAST(1000000 + item_id AS BIGINT) AS id, concat('/corpus/src', item_id % 20, '/en/new', item_id, '.md') AS filename, text FROM benchmark)"


def _fresh(spark, sf_dir):
    """Entities read from the listing: new files hold benchmark texts, changed ones their old text with a word more."""
    old = view(spark, sf_dir, "fx_entities").withColumn("body", F.concat("body", F.lit(" zusatz")))
    new = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = F.concat(F.lit("/corpus/src"), F.col("item_id") % 20, F.lit("/en/new"), F.col("item_id"), F.lit(".md"))
    rows = new.select((F.lit(1000000) + F.col("item_id")).cast("long").alias("id"), *[F.lit("").alias(c) for c in ("preamble", "signature")], F.col("text").alias("body"), *[F.lit("").alias(c) for c in ("namespace", "ext", "path")], F.lit("file").alias("type"), name.alias("filename"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    return old.unionByName(rows)


def _diffed(spark, sf_dir):
    return M.file_diff(view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_listing"))


@query(f"{_DIFF}, {_NEW} SELECT e.id, e.filename, md5(CASE WHEN status = 'changed' THEN concat(body, ' zusatz') ELSE body END) AS digest FROM fx_entities e JOIN d USING (filename) WHERE status <> 'deleted' UNION ALL SELECT id, filename, md5(text) FROM n")
def update_entities(spark, sf_dir):
    after = M.update_entities(view(spark, sf_dir, "fx_entities"), _diffed(spark, sf_dir), _fresh(spark, sf_dir))
    return after.select("id", "filename", F.md5("body").alias("digest"))


@query(
    f"{_DIFF}, {_NEW}, a AS (SELECT e.id, CASE WHEN status = 'changed' THEN concat(body, ' zusatz') ELSE body END AS body FROM fx_entities e JOIN d USING (filename) WHERE status <> 'deleted' UNION ALL SELECT id, text FROM n), "
    "t AS (SELECT id, unnest(" + f"list_transform({_enc('body')}, lambda t: strip_accents(lower(t)))" + ") AS token FROM a) SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY token"
)
def update_postings(spark, sf_dir):
    """Statistics of the body postings after an incremental update; only new and changed files are tokenised again."""
    e, diff = view(spark, sf_dir, "fx_entities"), _diffed(spark, sf_dir)
    touched = diff.where("status IN ('new', 'changed')").select("filename")
    fresh = I.postings(_fresh(spark, sf_dir).join(touched, "filename", "left_semi"))
    after = M.update_postings(index(spark, sf_dir).postings.drop("project_root"), e.select("id", "filename"), diff, fresh).where("field = 'body'")
    return after.groupBy("token").agg(F.countDistinct("id").alias("df"), F.sum("tf").alias("cf"))


@query(
    f"WITH {_TOK}, g AS (SELECT id FROM fx_entities WHERE filename IN (SELECT filename FROM fx_files WHERE project_root = '/corpus/src5')), p AS (SELECT DISTINCT id, f, token FROM tok) "
    "SELECT (SELECT count(*) FROM fx_files WHERE project_root = '/corpus/src5') AS files, (SELECT count(*) FROM g) AS entities, (SELECT count(*) FROM p WHERE id IN (SELECT id FROM g)) AS postings, "
    "(SELECT count(*) FROM fx_files WHERE project_root <> '/corpus/src5') AS files_left, (SELECT count(*) FROM fx_entities WHERE id NOT IN (SELECT id FROM g)) AS entities_left, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM g)) AS postings_left"
)
def delete_project_everywhere(spark, sf_dir):
    found = index(spark, sf_dir).postings
    *left, gone = M.delete_project_everywhere("/corpus/src5", view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_entities"), found)
    for name, df in zip(("files_left", "entities_left", "postings_left"), left, strict=True):
        gone = gone.join(F.broadcast(df.agg(F.count("*").alias(name))))  # rows of scalars
    return gone


@query("SELECT id, md5(CASE WHEN id % 7 = 0 THEN concat(body, ' zusatz') ELSE body END) AS digest FROM fx_entities WHERE id % 7 <> 0 OR id % 2 = 0")
def reindex_files(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entities").select("id", "filename", "body")
    fresh = e.where("id % 2 = 0").withColumn("body", F.concat("body", F.lit(" zusatz")))
    return M.reindex_files(e, e.where("id % 7 = 0").select("filename"), fresh).select("id", F.md5("body").alias("digest"))


@query(
    "SELECT filename FROM fx_files WHERE filename IN (SELECT filename FROM fx_listing) AND NOT starts_with(filename, '/corpus/src1/de/') AND NOT (starts_with(filename, '/corpus/src2/') AND NOT starts_with(filename, '/corpus/src2/en/')) "
    "AND NOT regexp_matches(filename, '^/corpus/src3/en/1[^/]\\.md') AND NOT regexp_matches(filename, '^/corpus/src3/fr/(.*/)[12][^/]*\\.md') AND NOT starts_with(filename, '/corpus/src4/es')"
)
def purge_ignored(spark, sf_dir):
    return M.purge(view(spark, sf_dir, "fx_files").select("filename"), view(spark, sf_dir, "fx_listing"), view(spark, sf_dir, "fx_ignore_rules"))


@query(
    _DIFF + ", c AS (SELECT regexp_replace(filename, '/[^/]*$', '') AS dir FROM d WHERE status = 'changed'), dd AS (SELECT dir FROM c UNION SELECT regexp_replace(dir, '/[^/]*$', '') FROM c) "
    "SELECT filename, 'markdown' AS extractor FROM d WHERE status = 'new' AND regexp_replace(filename, '/[^/]*$', '') IN (SELECT dir FROM dd) AND NOT starts_with(filename, '/corpus/src4/en/')"
)
def discover(spark, sf_dir):
    stored, listing = view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_listing")
    rules = spark.createDataFrame([("/corpus/src4", 1, "en/")], "dir string, rule_no int, pattern string")
    return M.discover(listing, stored, M.file_diff(stored, listing).where("status = 'changed'"), FI.registry(spark), rules)


@query(f"SELECT project_root, project_name, CAST(CASE WHEN project_name = 'de' OR length(project_name) = 4 THEN {NOW} ELSE 3 END AS BIGINT) AS last_indexed FROM fx_projects")
def stamp_projects(spark, sf_dir):
    p = view(spark, sf_dir, "fx_projects")
    stored = p.where("project_name <> 'de'").withColumns({"registered_at": F.lit(5).cast("long"), "last_accessed": F.lit(7).cast("long"), "last_indexed": F.lit(3).cast("long")})
    return M.upsert_projects(stored, p.where("project_name = 'de' OR length(project_name) = 4"), NOW, indexed=True).select("project_root", "project_name", "last_indexed")


@query(_DIFF + f", {_NEW} SELECT CAST(count(*) FILTER (status IN ('new', 'changed')) AS BIGINT) AS indexed, CAST(count(*) FILTER (status = 'unchanged') AS BIGINT) AS skipped, CAST(count(*) FILTER (status = 'deleted') AS BIGINT) AS removed, (SELECT count(*) FROM n) + (SELECT count(*) FROM fx_entities JOIN d USING (filename) WHERE status = 'changed') AS entities FROM d")
def full_run_report(spark, sf_dir):
    diff = _diffed(spark, sf_dir)
    touched = diff.where("status IN ('new', 'changed')").select("filename")
    return M.run_report(diff, _fresh(spark, sf_dir).join(touched, "filename", "left_semi"))


# --- symbols ----------------------------------------------------------------------------------------------------

_UP = "WITH RECURSIVE c AS (SELECT child, parent AS ancestor, 1 AS depth FROM fx_type_edges WHERE rel = 'extends' UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN fx_type_edges e ON e.child = c.ancestor WHERE e.rel = 'extends' AND c.depth < 40), "
_HAVE = (
    "a AS (SELECT owner, kind, member, modifiers, owner AS declared_in, 0 AS depth FROM fx_members UNION ALL SELECT c.child, m.kind, m.member, m.modifiers, c.ancestor, c.depth FROM c JOIN fx_members m ON m.owner = c.ancestor), "
    "h AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY owner, kind, member ORDER BY depth, declared_in) = 1) "
)


def _up(spark, sf_dir):
    return R.closure(_edges(spark, sf_dir).where("rel = 'extends'"))


def _heirs_sql(test: str) -> str:
    return (
        f"{_UP} d AS (SELECT DISTINCT owner, member, {test} AS hit FROM fx_params), m AS (SELECT owner, member, bool_or(hit) AS hit FROM d GROUP BY ALL), "
        "a AS (SELECT owner, member, hit, owner AS declared_in, 0 AS depth FROM m UNION ALL SELECT c.child, m.member, m.hit, c.ancestor, c.depth FROM c JOIN m ON m.owner = c.ancestor) "
        "SELECT owner, member, declared_in FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY owner, member ORDER BY depth, declared_in) = 1) WHERE hit"
    )


@query(_heirs_sql("regexp_matches(type_expr, '(^|[^0-9A-Za-z])T3($|[|])')"))
def accepts_inherited(spark, sf_dir):
    p = view(spark, sf_dir, "fx_params")
    return R.counted_under_heirs(R.accepts(p, "T3"), p, _up(spark, sf_dir))


@query(_heirs_sql("return_type = 'RType'"))
def returns_inherited(spark, sf_dir):
    p = view(spark, sf_dir, "fx_params")
    return R.counted_under_heirs(R.returns(p, "RType"), p, _up(spark, sf_dir))


@query(
    f"{_UP} m AS (SELECT DISTINCT owner, member FROM fx_members WHERE kind = 'method'), u AS (SELECT DISTINCT ancestor AS type, child AS owner FROM c WHERE ancestor <> child), "
    "r AS (SELECT u.type, u.owner, m.member FROM u JOIN m ON m.owner = u.type), s AS (SELECT child AS owner, ancestor AS place FROM c UNION SELECT child, child FROM c), "
    "h AS (SELECT DISTINCT r.type, r.owner, r.member FROM r JOIN s ON s.owner = r.owner JOIN m ON m.owner = s.place AND m.member = r.member JOIN u ON u.type = r.type AND u.owner = s.place) "
    "SELECT type, owner, count(DISTINCT r.member) AS n_required, count(DISTINCT h.member) AS n_present FROM r LEFT JOIN h USING (type, owner, member) GROUP BY type, owner"
)
def compatible_heirs(spark, sf_dir):
    methods = view(spark, sf_dir, "fx_members").where("kind = 'method'").select("owner", "member")
    return R.compatible_heirs(methods, _up(spark, sf_dir))


_LINES = (
    "lines AS (SELECT kind, concat(kind, ' ', fqn) AS line FROM fx_classes UNION ALL SELECT DISTINCT 'trait', concat('trait ', parent) FROM fx_type_edges WHERE rel = 'uses' UNION ALL SELECT kind, concat(owner, '::', member) FROM fx_members "
    "UNION ALL SELECT DISTINCT 'function', concat('function ', member) FROM fx_functions) "
)


def _lines(spark, sf_dir):
    v = lambda name: view(spark, sf_dir, name)
    line = lambda df, kind, *parts: df.select(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.concat(*parts).alias("line"))
    out = line(v("fx_classes"), F.col("kind"), F.col("kind"), F.lit(" "), F.col("fqn"))
    out = out.unionByName(line(v("fx_type_edges").where("rel = 'uses'"), "trait", F.lit("trait "), F.col("parent")).distinct())
    out = out.unionByName(line(v("fx_members"), F.col("kind"), F.col("owner"), F.lit("::"), F.col("member")))
    return out.unionByName(line(v("fx_functions"), "function", F.lit("function "), F.col("member")).distinct())


@query(f"WITH {_LINES} SELECT kind, line FROM lines WHERE regexp_matches(line, '(?i)(C|t|i|f)[0-9]*7(::a[0-9]_3)?$')")
def find_symbols_all(spark, sf_dir):
    return R.find_symbols(_lines(spark, sf_dir), "(C|t|i|f)[0-9]*7(::a[0-9]_3)?$", ignore_case=True)


@query(f"WITH {_LINES} SELECT kind, count(*) AS n FROM lines WHERE contains(line, '7') GROUP BY ROLLUP (kind)")
def results_by_kind(spark, sf_dir):
    return R.counts_with_total(_lines(spark, sf_dir).where(F.contains("line", F.lit("7"))), "kind")


@query("SELECT attribute, target_kind, count(*) AS n FROM fx_attributes GROUP BY ROLLUP (attribute, target_kind)")
def attributes_with_total(spark, sf_dir):
    return R.counts_with_total(view(spark, sf_dir, "fx_attributes"), "attribute", "target_kind")


@query("SELECT type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM (SELECT kind AS type FROM fx_classes UNION ALL SELECT kind FROM fx_members UNION ALL SELECT 'file' FROM fx_files) GROUP BY type")
def entities_by_type(spark, sf_dir):
    kinds = view(spark, sf_dir, "fx_classes").select(F.col("kind").alias("type")).unionByName(view(spark, sf_dir, "fx_members").select(F.col("kind").alias("type")))
    return FI.by_type(kinds.unionByName(view(spark, sf_dir, "fx_files").select(F.lit("file").alias("type"))))


@query("SELECT fqn, kind FROM fx_classes ORDER BY fqn, kind")
def sorted_classes(spark, sf_dir):
    return view(spark, sf_dir, "fx_classes").select("fqn", "kind").orderBy("fqn", "kind")


def _list_sql(kind: str) -> str:
    return f"coalesce(string_agg(CASE WHEN declared_in <> owner THEN concat(member, ' [from ', declared_in, ']') ELSE member END, ', ' ORDER BY member, declared_in) FILTER (kind = '{kind}'), '') AS {kind}_list"


@query(_UP + _HAVE + f"SELECT owner AS fqn, {_list_sql('constant')}, {_list_sql('property')}, {_list_sql('method')} FROM h GROUP BY owner")
def class_members(spark, sf_dir):
    return R.class_members(view(spark, sf_dir, "fx_members"), _up(spark, sf_dir))


def _page_sql(kinds: str) -> str:
    return _UP + _HAVE + f"SELECT kind, member, modifiers, CASE WHEN declared_in <> owner THEN declared_in ELSE '' END AS origin FROM h WHERE owner = 'C700' AND kind IN ({kinds})"


@query(_page_sql("'method'"))
def method_page(spark, sf_dir):
    return R.member_page(view(spark, sf_dir, "fx_members"), _up(spark, sf_dir), "C700", ("method",))


@query(_page_sql("'property', 'constant'"))
def property_page(spark, sf_dir):
    return R.member_page(view(spark, sf_dir, "fx_members"), _up(spark, sf_dir), "C700", ("property", "constant"))


@query(
    "WITH t AS (SELECT owner, member, return_type, ordinal, concat(coalesce(type_expr || ' ', ''), CASE WHEN is_variadic THEN '...' ELSE '' END, CASE WHEN by_ref THEN '&' ELSE '' END, '$', name, coalesce(' = ' || default_value, '')) AS text FROM fx_functions) "
    "SELECT owner, member, concat(member, '(', string_agg(text, ', ' ORDER BY ordinal, text), '): ', coalesce(return_type, 'mixed')) AS signature FROM t GROUP BY owner, member, return_type"
)
def function_pages(spark, sf_dir):
    return R.function_pages(view(spark, sf_dir, "fx_functions"))


@query(
    "WITH n AS (SELECT fqn AS name, 'class' AS kind, 1 AS p FROM fx_classes UNION ALL SELECT DISTINCT concat('I', l_linenumber), 'namespace', 2 FROM lineitem UNION ALL SELECT DISTINCT concat('C', l_suppkey * 40), 'function', 3 FROM lineitem UNION ALL SELECT concat(owner, '::', member), kind, CASE kind WHEN 'method' THEN 1 WHEN 'property' THEN 2 ELSE 3 END FROM fx_members "
    "UNION ALL SELECT concat(owner, '::', member), 'constant', 3 FROM fx_members WHERE kind = 'method'), t AS (SELECT DISTINCT concat('C', o_orderkey % 3000) AS target FROM orders UNION SELECT DISTINCT concat('I', o_orderkey % 90) FROM orders UNION SELECT DISTINCT concat(owner, '::', member) FROM fx_members) "
    "SELECT target, arg_min(kind, p) AS kind FROM t JOIN n ON n.name = t.target GROUP BY target"
)
def resolve_any(spark, sf_dir):
    """Class-like before namespace before function; method before property before constant; by exact case."""
    line, members = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), view(spark, sf_dir, "fx_members")
    named = lambda df, name, kind, p: df.select(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(p) if isinstance(p, int) else p).alias("priority")).distinct()
    whole = F.concat("owner", F.lit("::"), "member")
    names = named(view(spark, sf_dir, "fx_classes"), F.col("fqn"), "class", 1).unionByName(named(line, F.concat(F.lit("I"), "l_linenumber"), "namespace", 2)).unionByName(named(line, F.concat(F.lit("C"), F.col("l_suppkey") * 40), "function", 3))
    names = names.unionByName(named(members, whole, F.col("kind"), F.when(F.col("kind") == "method", 1).when(F.col("kind") == "property", 2).otherwise(3))).unionByName(named(members.where("kind = 'method'"), whole, "constant", 3))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    targets = orders.select(F.concat(F.lit("C"), F.col("o_orderkey") % 3000).alias("target")).unionByName(orders.select(F.concat(F.lit("I"), F.col("o_orderkey") % 90).alias("target"))).unionByName(members.select(whole.alias("target"))).distinct()
    return R.resolve(targets, names)


@query("SELECT fqn, min(filename) AS filename FROM (SELECT filename, concat('Pkg', chr(92), split_part(filename, '/', 4), chr(92), regexp_replace(split_part(filename, '/', 5), '\\.[^./]*$', '')) AS fqn FROM (SELECT replace(filename, concat('/Part', p), concat('/Part', p % 97)) AS filename FROM (SELECT filename, CAST(regexp_extract(filename, 'Part([0-9]+)', 1) AS INT) AS p FROM fx_code_files))) GROUP BY fqn")
def class_map(spark, sf_dir):
    """Packages that map to one namespace hold the same classes; the first path of each class counts."""
    part = F.regexp_extract("filename", "Part([0-9]+)", 1)
    files = view(spark, sf_dir, "fx_code_files").select(F.replace("filename", F.concat(F.lit("/Part"), part), F.concat(F.lit("/Part"), (part.cast("int") % 97).cast("string"))).alias("filename"))
    roots = files.select(F.concat(F.lit("/code/"), F.split("filename", "/")[2]).alias("directory"), F.lit("Pkg").alias("namespace")).distinct()
    return R.class_map(files, roots)


# --- streams ----------------------------------------------------------------------------------------------------


@query("SELECT filename, count(DISTINCT ts) AS n, count(*) * 2 AS n_read FROM fx_changes GROUP BY filename")
def stream_dedupe(spark, sf_dir):
    """Every change comes twice; each (filename, ts) is kept once."""
    twice = lambda: _change_stream(spark, sf_dir).unionByName(_change_stream(spark, sf_dir))
    kept = C.run_to_end(C.drop_duplicates(twice())).groupBy("filename").agg(F.count("*").alias("n"))
    read = C.run_to_end(twice()).groupBy("filename").agg(F.count("*").alias("n_read"))
    return kept.join(read, "filename")


@query("SELECT ts < TIMESTAMP '2024-01-29 00:00:00' AS late, filename, count(*) AS n FROM fx_changes GROUP BY ALL")
def stream_split(spark, sf_dir):
    recent, late = (C.run_to_end(x) for x in C.split_late(_change_stream(spark, sf_dir), "2024-01-30 00:00:00"))
    both = recent.select(F.lit(False).alias("late"), "filename").unionByName(late.select(F.lit(True).alias("late"), "filename"))
    return both.groupBy("late", "filename").agg(F.count("*").alias("n"))


@query("SELECT filename, epoch_us(max(ts)) AS micros, CAST(arg_max(event_id, (epoch_us(ts), event_id)) AS BIGINT) AS event_id, count(*) AS n_seen FROM fx_changes GROUP BY filename")
def stream_states(spark, sf_dir):
    return C.last_states(_change_stream(spark, sf_dir))
