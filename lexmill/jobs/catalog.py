"""Registered queries over the views of fixtures.py, each with its DuckDB twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import tokens as T
from lexmill.jobs.fixtures import NOW, view, with_views
from lexmill.operators import entities as E
from lexmill.operators import files as FI
from lexmill.operators import index as I
from lexmill.operators import maintain as M
from lexmill.operators import search as S
from lexmill.operators import snippets as SN
from lexmill.operators import symbols as R
from lexmill.sources import trees
from lexmill.streaming import changes as C

Make = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Make] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Make], Make]:
    def register(make: Make) -> Make:
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLE_SQL[make.__name__] = with_views(sql)
        return make

    return register


# Token expressions in DuckDB SQL.
_RAW = r"regexp_extract_all(regexp_replace({x}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0B]')"
_ENC = r"list_transform({raw}, lambda t: CASE WHEN regexp_matches(t, '^[^\p{{L}}\p{{N}}]$') THEN concat('T', lower(hex(encode(CASE WHEN t = '\"' THEN chr(39) ELSE t END))), 'K') ELSE t END)"


def _raw(x: str) -> str:
    return _RAW.format(x=x)


def _enc(x: str) -> str:
    return _ENC.format(raw=_raw(x)).replace("'\\\"'", "'\"'")


def _idx(x: str) -> str:
    return f"list_transform({_enc(x)}, lambda t: strip_accents(lower(t)))"


#: id, field number, position, token of fx_entities
_TOK = "tok AS (" + " UNION ALL ".join(f"SELECT id, {k} AS f, unnest({_idx(c)}) AS token, unnest(range(len({_idx(c)}))) AS pos FROM fx_entities" for k, c in enumerate(I.FIELDS)) + ")"


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_enc('text')} AS t FROM documents)")
def tokenize_docs(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.encode_symbols(T.raw_tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT page_id, {_idx('html')} AS t FROM pages)")
def fold_tokens(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.index_tokens(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


_DISTINCT = "list_filter({x}, lambda y, i: list_position({x}, y) = i)"


@query(
    "WITH n AS (SELECT filename, trim(regexp_extract(filename, '[^/]*$')) AS name FROM fx_code_files), "
    f"p AS (SELECT *, list_filter({_raw('name')}, lambda t: t NOT IN ('_', '-', '.', chr(92), '/')) AS t0 FROM n), "
    f"d AS (SELECT *, {_DISTINCT.format(x='t0')} AS t FROM p), "
    "s AS (SELECT *, list_concat([name], flatten(list_transform(t, lambda y: [y, lower(y)])), [lower(name)]) AS s0 FROM d) "
    f"SELECT filename, array_to_string(t, ' ') AS tokens, array_to_string({_DISTINCT.format(x='s0')}, ' ') AS searchable FROM s"
)
def identifier_tokens(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_code_files").select("filename", T.split_identifier(X.basename(F.col("filename"))).alias("s"))
    return rows.select("filename", F.array_join("s.tokens", " ").alias("tokens"), "s.searchable")


_WORDS = "CASE {t} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.OPERATOR_WORDS.items()) + r" ELSE CASE WHEN regexp_matches({t}, '^[a-zA-Z0-9_]+$') OR regexp_matches({t}, '[^\x00-\x7F]') THEN {t} END END"


@query(
    "WITH l AS (SELECT p_partkey, regexp_extract_all(concat('$part->get', p_partkey, '(', p_name, ') => [\"', p_type, '\"]; // ', p_brand), '[a-zA-Z_$@#][a-zA-Z0-9_]*|->|=>|::|[^\\s]+') AS m FROM part), "
    "e AS (SELECT p_partkey, unnest(m) AS w, unnest(range(len(m))) AS i FROM l), "
    f"p AS (SELECT p_partkey, i, trim(w) AS w, list_filter({_raw('trim(w)')}, lambda t: t NOT IN ('_', '-', '.', chr(92), '/')) AS t0 FROM e), "
    f"q AS (SELECT p_partkey, i, list_concat([w], {_DISTINCT.format(x='t0')}) AS t FROM p), "
    "r AS (SELECT p_partkey, i, list_filter(list_transform(list_filter(t, lambda y: trim(y) <> '' AND y NOT IN (';', ',', '.', ':', '=')), lambda y: " + _WORDS.replace("{t}", "y") + "), lambda y: y IS NOT NULL) AS n0 FROM q), "
    f"s AS (SELECT p_partkey, i, {_DISTINCT.format(x='n0')} AS n FROM r), "
    "u AS (SELECT p_partkey, i, flatten(list_transform(n, lambda y: CASE WHEN lower(y) IN ('dollar', 'arrow', 'at') THEN [y] ELSE [y, lower(y)] END)) AS a FROM s), "
    "v AS (SELECT p_partkey, flatten(list(a ORDER BY i)) AS a FROM u GROUP BY p_partkey) "
    f"SELECT p_partkey, coalesce(array_to_string({_DISTINCT.format(x='a')}, ' '), '') AS words FROM v"
)
def code_tokens(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat(F.lit("$part->get"), F.col("p_partkey"), F.lit("("), F.col("p_name"), F.lit(') => ["'), F.col("p_type"), F.lit('"]; // '), F.col("p_brand"))
    return part.select("p_partkey", T.snippet_words(line).alias("words"))


@query("SELECT id, trim(split_part(substr(doc, 4), chr(10), 1)) AS summary, trim(regexp_replace(split_part(doc, chr(10), 2), '^\\s*\\*\\s?', '')) AS description FROM fx_symbols")
def doc_summary(spark, sf_dir):
    return view(spark, sf_dir, "fx_symbols").select("id", X.doc_summary(F.col("doc")).alias("summary"), X.doc_description(F.col("doc")).alias("description"))


@query("SELECT filename, regexp_extract(filename, '[^/]*$') AS base, regexp_replace(filename, '/[^/]*$', '') AS dir, lower(regexp_extract(filename, '\\.([^./]+)$', 1)) AS ext, concat('/code,/code/', split_part(filename, '/', 3), ',/code/', split_part(filename, '/', 3), '/', split_part(filename, '/', 4)) AS above FROM fx_code_files")
def path_parts(spark, sf_dir):
    p = F.col("filename")
    return view(spark, sf_dir, "fx_code_files").select("filename", X.basename(p).alias("base"), X.dirname(p).alias("dir"), X.extension(p).alias("ext"), F.array_join(X.ancestors(p), ",").alias("above"))


_AGE = f"greatest(0.0, ({NOW}.0 - filetime) / (365.0 * 86400))"


@query(f"SELECT filename, round(4.0 * pow({_AGE}, 1.5) / (1.0 + pow({_AGE}, 1.5)), 6) AS penalty FROM fx_files")
def age_penalty(spark, sf_dir):
    return view(spark, sf_dir, "fx_files").select("filename", F.round(X.age_penalty(F.col("filetime"), NOW), 6).alias("penalty"))


@query("SELECT owner, member, concat(string_agg(concat(type_expr, ' $', name), ', ' ORDER BY ordinal, concat(type_expr, ' $', name)), ': ', return_type) AS line FROM fx_params GROUP BY owner, member, return_type")
def format_types(spark, sf_dir):
    p = view(spark, sf_dir, "fx_params")
    # One row a member: its parameters in order.
    listed = p.groupBy("owner", "member", "return_type").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(X.format_type(F.col("type_expr")), F.lit(" $"), F.col("name")).alias("text")))).alias("ps"))
    return listed.select("owner", "member", F.concat(F.array_join(F.transform("ps", lambda x: x["text"]), ", "), F.lit(": "), "return_type").alias("line"))


@query("SELECT type_expr, count(*) AS n FROM fx_params WHERE regexp_replace(regexp_replace(regexp_replace(type_expr, '\\|null$', ''), '^\\?', ''), '^App\\\\', '') IN ('T1', 'T2', 'T3') GROUP BY type_expr")
def type_match(spark, sf_dir):
    p = view(spark, sf_dir, "fx_params")
    hit = F.exists(F.array(F.lit("T1"), F.lit("T2"), F.lit("T3")), lambda w: X.type_matches(F.col("type_expr"), w))
    return p.where(hit).groupBy("type_expr").agg(F.count("*").alias("n"))


_FIELD = "CASE f " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(I.FIELDS)) + " END"


@query(f"WITH {_TOK} SELECT id, {_FIELD} AS field, token, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM tok GROUP BY id, f, token")
def postings(spark, sf_dir):
    p = I.postings(view(spark, sf_dir, "fx_entities"))
    return p.select("id", "field", "token", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"WITH {_TOK} SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM tok GROUP BY token")
def term_stats(spark, sf_dir):
    return I.term_stats(I.postings(view(spark, sf_dir, "fx_entities")))


@query(f"WITH {_TOK} SELECT id, count(*) AS dl FROM tok GROUP BY id")
def doc_stats(spark, sf_dir):
    return I.doc_stats(view(spark, sf_dir, "fx_entities"))


_INDEXES: dict[tuple[str, str, int], str] = {}


def index(spark, sf_dir) -> I.Index:
    """The stored index of fx_entities: built at the first search of a session, only read by the later ones."""
    # Files and times of change, so that a table that was written anew is indexed anew.
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    stamp = files.agg(F.bit_xor(F.xxhash64("file_path", "file_modification_time"))).first()[0]
    key = (spark.sparkContext.applicationId, sf_dir, stamp)
    if key not in _INDEXES:
        path = f"{R.shared_folder(spark)}/index-{uuid.uuid4()}"
        I.write_index(view(spark, sf_dir, "fx_entities").withColumn("project_root", F.concat(F.lit("/corpus/"), F.col("namespace"))), path)
        _INDEXES[key] = path
    return I.open_index(spark, _INDEXES[key])


_HAS = "SELECT DISTINCT id FROM tok WHERE token = '{t}'"


def _search(make_query, sql: str | None = None):
    def register(name: str):
        def run(spark, sf_dir):
            return S.matches(index(spark, sf_dir), make_query(spark))

        run.__name__ = name
        query(sql)(run)

    return register


_search(lambda s: S.term(s, "thin"), f"WITH {_TOK} {_HAS.format(t='thin')}")("search_term")
_search(lambda s: S.term(s, "thin") & S.term(s, "of"), f"WITH {_TOK} {_HAS.format(t='thin')} INTERSECT {_HAS.format(t='of')}")("search_and")
_search(lambda s: S.term(s, "thin") | S.term(s, "und"), f"WITH {_TOK} {_HAS.format(t='thin')} UNION {_HAS.format(t='und')}")("search_or")
_search(lambda s: S.term(s, "of") - S.term(s, "thin"), f"WITH {_TOK} {_HAS.format(t='of')} EXCEPT {_HAS.format(t='thin')}")("search_not")
_search(lambda s: S.phrase(s, "of the"), f"WITH {_TOK} SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND a.f = b.f AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'")("search_phrase")
_search(lambda s: S.prefix(s, "thor"), f"WITH {_TOK} SELECT DISTINCT id FROM tok WHERE starts_with(token, 'thor')")("search_prefix")
_search(lambda s: S.Near((S.term(s, "thin"), S.term(s, "that")), 3), f"WITH {_TOK} SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND a.f = b.f AND abs(a.pos - b.pos) <= 4 WHERE a.token = 'thin' AND b.token = 'that'")("search_near")
_search(lambda s: S.term(s, "the").in_fields("signature"), f"WITH {_TOK} SELECT DISTINCT id FROM tok WHERE token = 'the' AND f = 1")("search_field")
_search(lambda s: S.term(s, "the").not_in_fields("preamble", "path").initial(), f"WITH {_TOK} SELECT DISTINCT id FROM tok WHERE token = 'the' AND pos = 0 AND f IN (1, 2, 3, 4)")("search_initial")


@query(f"WITH {_TOK} SELECT id FROM fx_entities WHERE starts_with(filename, '/corpus/src1/') AND id IN ({_HAS.format(t='of')})")
def search_scope(spark, sf_dir):
    e = view(spark, sf_dir, "fx_entities")
    return S.under(e, "/corpus/src1").select("id").join(S.matches(index(spark, sf_dir), S.term(spark, "of")), "id", "left_semi")


@query(f"WITH {_TOK} SELECT count(*) AS n FROM ({_HAS.format(t='thin')})")
def count_matches(spark, sf_dir):
    return S.matches(index(spark, sf_dir), S.term(spark, "thin")).agg(F.count("*").alias("n"))


_SCORES = (
    f"WITH {_TOK}, dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id), st AS (SELECT (SELECT count(*) FROM fx_entities) AS n, sum(dl) * 1.0 / (SELECT count(*) FROM fx_entities) AS avgdl FROM dl), "
    "tf AS (SELECT id, token, count(*) AS f FROM tok GROUP BY id, token), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), "
    "sc AS (SELECT tf.id, tf.token, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (token) JOIN dl USING (id), st) "
)


@query(
    _SCORES + f", q AS (SELECT id, -sum(s) AS score FROM sc WHERE token IN ('thin', 'that') GROUP BY id HAVING count(*) = 2), "
    f"r AS (SELECT id, filename, score, score + 4.0 * pow({_AGE}, 1.5) / (1.0 + pow({_AGE}, 1.5)) AS adjusted FROM q JOIN fx_entities USING (id) JOIN (SELECT filename, filetime FROM fx_files) USING (filename)) "
    "SELECT id, filename, round(score, 6) AS score, round(adjusted, 6) AS adjusted_rank FROM r ORDER BY round(adjusted, 6), id LIMIT 20"
)
def search_ranked(spark, sf_dir):
    e, files = view(spark, sf_dir, "fx_entities"), view(spark, sf_dir, "fx_files")
    hits = S.rank_bm25(index(spark, sf_dir), S.term(spark, "thin") & S.term(spark, "that"))
    best = S.top_k(S.adjusted_rank(hits, e, files, NOW))
    return best.select("id", "filename", F.round("score", 6).alias("score"), F.round("adjusted_rank", 6).alias("adjusted_rank"))


@query(
    _SCORES + f", qt AS (SELECT item_id AS query_id, unnest(list_distinct({_idx('text')})) AS token, len(list_distinct({_idx('text')})) AS wanted FROM benchmark), "
    "h AS (SELECT query_id, id, -sum(s) AS score FROM qt JOIN sc USING (token) GROUP BY query_id, id, wanted HAVING count(*) * 100 >= wanted * 60) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), id) AS nth, id, round(score, 6) AS score FROM h QUALIFY nth <= 10"
)
def search_many(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.array_distinct(T.index_tokens(F.col("text"))).alias("tokens"))
    out = S.search_many(index(spark, sf_dir), asked, percent=60)
    return out.select("query_id", F.col("nth").cast("long").alias("nth"), "id", F.round("score", 6).alias("score"))


_EXT = "lower(regexp_extract(filename, '\\.([^./]+)$', 1))"
_LANG = f"CASE {_EXT} WHEN '' THEN CASE WHEN starts_with(content, '#!') THEN 'script' END " + " ".join(f"WHEN '{e}' THEN '{n}'" for n, es in FI.LANGUAGES.items() for e in es) + " END"


@query(f"SELECT filename, {_LANG} AS language FROM fx_code_files WHERE {_LANG} IS NOT NULL")
def language_map(spark, sf_dir):
    return FI.with_language(view(spark, sf_dir, "fx_code_files")).select("filename", "language")


@query("SELECT filename FROM fx_code_files WHERE NOT regexp_matches(regexp_replace(filename, '/[^/]*$', ''), '(^|/)(\\.[^/]+|node_modules|vendor|__pycache__|dist|build|coverage)(/|$)')")
def skip_dirs(spark, sf_dir):
    return FI.drop_skipped_dirs(view(spark, sf_dir, "fx_code_files")).select("filename")


@query(
    "SELECT filename FROM fx_files WHERE NOT starts_with(filename, '/corpus/src1/de/') AND NOT (starts_with(filename, '/corpus/src2/') AND NOT starts_with(filename, '/corpus/src2/en/')) "
    "AND NOT regexp_matches(filename, '^/corpus/src3/en/1[^/]\\.md') AND NOT regexp_matches(filename, '^/corpus/src3/fr/(.*/)[12][^/]*\\.md') AND NOT starts_with(filename, '/corpus/src4/es')"
)
def ignore_rules(spark, sf_dir):
    return FI.apply_ignore_rules(view(spark, sf_dir, "fx_files").select("filename"), view(spark, sf_dir, "fx_ignore_rules"))


@query(
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{n}', {p})" for n, p, es in FI.EXTRACTORS for e in es) + ") AS t(ext, extractor, priority)) "
    f"SELECT filename, extractor FROM (SELECT filename, extractor, row_number() OVER (PARTITION BY filename ORDER BY priority DESC, extractor) AS k FROM (SELECT filename, {_EXT} AS ext FROM fx_code_files) JOIN r USING (ext)) WHERE k = 1"
)
def route_extractor(spark, sf_dir):
    return FI.route_extractor(view(spark, sf_dir, "fx_code_files"), FI.registry(spark))


@query("SELECT filename, md5(content) AS file_hash, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS n_lines, CAST(length(content) AS BIGINT) AS n_chars FROM fx_files")
def fingerprint(spark, sf_dir):
    return trees.fingerprint(view(spark, sf_dir, "fx_files").select("filename", "content"))


@query(
    "WITH t AS (SELECT conv_id, string_agg('# ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id), "
    "l AS (SELECT conv_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) + 1 AS no FROM t), "
    "s AS (SELECT *, count(*) FILTER (regexp_matches(line, '^#\\s+.')) OVER (PARTITION BY conv_id ORDER BY no) AS sec FROM l) "
    "SELECT conv_id, CAST(min(no) AS BIGINT) AS line_start, CAST(max(no) AS BIGINT) AS line_end, arg_min(line, no) AS signature, md5(string_agg(line, chr(10) ORDER BY no)) AS digest FROM s WHERE sec > 0 GROUP BY conv_id, sec"
)
def markdown_sections(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")))
    files = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("text")))).alias("turns"))
    files = files.select(F.col("conv_id").alias("filename"), F.array_join(F.transform("turns", lambda x: x["text"]), "\n").alias("content"))
    s = E.markdown_sections(files)
    return s.select(F.col("filename").alias("conv_id"), "line_start", "line_end", "signature", F.md5("body").alias("digest"))


@query(
    "WITH m AS (SELECT page_id, regexp_extract_all(html, '<style>(.*?)</style>', 1) AS css FROM pages), c AS (SELECT page_id, unnest(css) AS css FROM m), "
    "r AS (SELECT page_id, unnest(regexp_extract_all(css, '([^{}]+)\\{[^{}]*\\}', 1)) AS selector, unnest(regexp_extract_all(css, '[^{}]+\\{([^{}]*)\\}', 1)) AS body FROM c) "
    "SELECT page_id, trim(selector) AS selector, body, CASE WHEN starts_with(trim(selector), '@media') THEN 'css-media-query' WHEN starts_with(trim(selector), '@keyframes') THEN 'css-keyframes' WHEN starts_with(trim(selector), '@') THEN 'css-at-rule' ELSE 'css-rule' END AS type FROM r"
)
def css_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    css = pages.select(F.col("page_id").alias("filename"), F.explode(F.regexp_extract_all("html", F.lit("(?is)<style(?:\\s[^>]*)?>(.*?)</style\\s*>"), F.lit(1))).alias("content"))
    return E.css_rules(css).select(F.col("filename").alias("page_id"), "selector", "body", "type")


@query("SELECT filename, 'python' AS language, split_part(content, chr(10), 1) AS signature FROM fx_code_files")
def script_language(spark, sf_dir):
    f = view(spark, sf_dir, "fx_code_files")
    return f.where("startswith(content, '#!')").select("filename", X.script_language(F.col("content")).alias("language"), F.substring_index("content", "\n", 1).alias("signature"))


@query("SELECT project_root, count(*) AS n_files, CAST(sum(entry_count) AS BIGINT) AS n_entities, round(sum(entry_count) * 1.0 / count(*), 1) AS per_file FROM fx_files GROUP BY project_root")
def project_summary(spark, sf_dir):
    return FI.project_summary(view(spark, sf_dir, "fx_files"))


@query("SELECT language, count(*) AS n_files, CAST(sum(entry_count) AS BIGINT) AS n_entities FROM fx_files GROUP BY language")
def by_language(spark, sf_dir):
    return FI.by_language(view(spark, sf_dir, "fx_files"))


@query("SELECT type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM (SELECT kind AS type FROM fx_classes) GROUP BY type")
def by_type(spark, sf_dir):
    return FI.by_type(view(spark, sf_dir, "fx_classes").withColumnRenamed("kind", "type"))


@query("SELECT filename, entry_count FROM fx_files ORDER BY entry_count DESC, filename LIMIT 5")
def largest_files(spark, sf_dir):
    return FI.largest_files(view(spark, sf_dir, "fx_files"))


@query("SELECT project_root, project_name, CASE WHEN project_name = 'de' THEN 'Never' ELSE '2024-01-01' END AS accessed FROM fx_projects")
def project_list(spark, sf_dir):
    p = view(spark, sf_dir, "fx_projects").withColumn("last_accessed", F.when(F.col("project_name") != "de", F.lit(NOW)))
    shown = F.coalesce(F.date_format(F.timestamp_seconds("last_accessed"), "yyyy-MM-dd"), F.lit("Never"))
    return p.orderBy(F.desc_nulls_last("last_accessed"), "project_root").select("project_root", "project_name", shown.alias("accessed"))


@query("SELECT filename AS path, CASE WHEN language = 'de' THEN concat(project_root, '/de') ELSE project_root END AS project_root FROM fx_files")
def longest_prefix(spark, sf_dir):
    return FI.longest_prefix(view(spark, sf_dir, "fx_files").select(F.col("filename").alias("path")), view(spark, sf_dir, "fx_projects"))


@query(
    "SELECT concat('/repo/', c_nationkey) AS directory, array_to_string(list_filter(['.git', 'composer.json', 'package.json', 'go.mod'], lambda m: list_contains(list(DISTINCT CASE c_custkey % 4 WHEN 0 THEN '.git' WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod' ELSE 'composer.json' END), m)), ',') AS markers, "
    "list_filter(['.git', 'composer.json', 'package.json', 'go.mod'], lambda m: list_contains(list(DISTINCT CASE c_custkey % 4 WHEN 0 THEN '.git' WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod' ELSE 'composer.json' END), m))[1] AS first_marker FROM customer GROUP BY c_nationkey"
)
def project_candidates(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    marker = F.when(F.col("c_custkey") % 4 == 0, ".git").when(F.col("c_custkey") % 4 == 1, "package.json").when(F.col("c_custkey") % 4 == 2, "go.mod").otherwise("composer.json")
    return FI.project_candidates(c.select(F.concat(F.lit("/repo/"), F.col("c_nationkey"), F.lit("/"), marker).alias("filename")))


_DIFF = "WITH d AS (SELECT filename, f.filetime, l.mtime, CASE WHEN f.filetime IS NULL THEN 'new' WHEN l.mtime IS NULL THEN 'deleted' WHEN f.filetime < l.mtime THEN 'changed' ELSE 'unchanged' END AS status FROM fx_files f FULL JOIN fx_listing l USING (filename)) "


@query(_DIFF + "SELECT filename, status FROM d")
def file_diff(spark, sf_dir):
    return M.file_diff(view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_listing")).select("filename", "status")


@query(_DIFF + "SELECT filename, CASE WHEN status = 'unchanged' THEN filetime ELSE mtime END AS filetime FROM d WHERE status <> 'deleted'")
def update_project(spark, sf_dir):
    return M.update_files(view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_listing"))


@query("SELECT project_root, count(*) AS n_files FROM fx_files WHERE project_root <> '/corpus/src5' GROUP BY project_root")
def delete_project(spark, sf_dir):
    return M.delete_project(view(spark, sf_dir, "fx_files"), "/corpus/src5").groupBy("project_root").agg(F.count("*").alias("n_files"))


@query("SELECT filename FROM fx_files WHERE filename IN (SELECT filename FROM fx_listing)")
def purge(spark, sf_dir):
    return M.purge(view(spark, sf_dir, "fx_files").select("filename"), view(spark, sf_dir, "fx_listing"))


@query(
    f"WITH o AS (SELECT filename FROM fx_files WHERE verified_time < {NOW - 86400} ORDER BY verified_time, filename LIMIT 50) "
    f"SELECT filename, CASE WHEN verified_time >= {NOW - 86400} OR filename IN (SELECT filename FROM o) THEN CAST({NOW} AS BIGINT) ELSE verified_time END AS verified_time FROM fx_files"
)
def verify_batch(spark, sf_dir):
    return M.verify_batch(view(spark, sf_dir, "fx_files").select("filename", "verified_time"), NOW)


@query(
    _DIFF + ", c AS (SELECT regexp_replace(filename, '/[^/]*$', '') AS dir FROM d WHERE status = 'changed'), dd AS (SELECT dir FROM c UNION SELECT regexp_replace(dir, '/[^/]*$', '') FROM c) "
    "SELECT filename FROM d WHERE status = 'new' AND regexp_replace(filename, '/[^/]*$', '') IN (SELECT dir FROM dd)"
)
def near_changes(spark, sf_dir):
    stored, listing = view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_listing")
    return M.near_changes(listing, stored, M.file_diff(stored, listing).where("status = 'changed'"))


@query(f"SELECT project_root FROM fx_projects WHERE length(project_root) % 3 = 0 OR {NOW} - ({NOW} - length(project_root) * 4) >= 60")
def due_projects(spark, sf_dir):
    p = view(spark, sf_dir, "fx_projects").withColumn("last_update_check", F.when(F.length("project_root") % 3 != 0, F.lit(NOW) - F.length("project_root") * 4))
    return M.due_projects(p, NOW).select("project_root")


@query(f"SELECT project_root, project_name, CAST(CASE WHEN project_name = 'de' THEN {NOW} ELSE 5 END AS BIGINT) AS registered_at, CAST(CASE WHEN project_name = 'de' OR length(project_name) = 4 THEN {NOW} ELSE 7 END AS BIGINT) AS last_accessed FROM fx_projects")
def upsert_projects(spark, sf_dir):
    p = view(spark, sf_dir, "fx_projects")
    stored = p.where("project_name <> 'de'").withColumns({"registered_at": F.lit(5).cast("long"), "last_accessed": F.lit(7).cast("long")})
    return M.upsert_projects(stored, p.where("project_name = 'de' OR length(project_name) = 4"), NOW)


@query("SELECT sum(CASE WHEN status IN ('new', 'changed') THEN 1 ELSE 0 END)::BIGINT AS indexed, sum(CASE WHEN status = 'unchanged' THEN 1 ELSE 0 END)::BIGINT AS skipped, sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END)::BIGINT AS removed FROM (" + _DIFF + " SELECT * FROM d)")
def run_report(spark, sf_dir):
    return M.run_report(M.file_diff(view(spark, sf_dir, "fx_files"), view(spark, sf_dir, "fx_listing")))


_CLOSED = "WITH RECURSIVE c AS (SELECT child, parent AS ancestor FROM fx_type_edges WHERE rel <> 'uses' UNION SELECT c.child, e.parent FROM c JOIN fx_type_edges e ON e.child = c.ancestor WHERE e.rel <> 'uses') "


def _edges(spark, sf_dir):
    return view(spark, sf_dir, "fx_type_edges").where("rel <> 'uses'")


@query(_CLOSED + "SELECT child, ancestor FROM c")
def closure(spark, sf_dir):
    return R.closure(_edges(spark, sf_dir)).select("child", "ancestor")


@query(_CLOSED + "SELECT fqn, kind, CASE WHEN doc = '' THEN '' ELSE trim(split_part(substr(doc, 4), chr(10), 1)) END AS summary FROM fx_classes WHERE kind <> 'interface' AND fqn IN (SELECT child FROM c WHERE ancestor = 'I3')")
def implements(spark, sf_dir):
    return R.implementers(view(spark, sf_dir, "fx_classes"), R.below(_edges(spark, sf_dir), "I3"), "I3")


@query("WITH RECURSIVE c AS (SELECT child, parent AS ancestor, 1 AS depth FROM fx_type_edges WHERE rel = 'extends' UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN fx_type_edges e ON e.child = c.ancestor WHERE e.rel = 'extends' AND c.depth < 40) SELECT child AS fqn, CAST(min(depth) AS INT) AS depth FROM c WHERE ancestor = 'C2' AND child <> 'C2' GROUP BY child")
def extends(spark, sf_dir):
    return R.subclasses(R.below(_edges(spark, sf_dir).where("rel = 'extends'"), "C2"), "C2")


@query("SELECT child AS fqn FROM fx_type_edges WHERE rel = 'uses' AND parent = 'T4'")
def uses(spark, sf_dir):
    return R.users_of_trait(view(spark, sf_dir, "fx_type_edges"), "T4")


@query("SELECT DISTINCT owner, member FROM fx_params WHERE type_expr IN (concat('App', chr(92), 'T3'), 'T4|null', '?T5') AND regexp_extract(type_expr, '[0-9]+') = '3'")
def accepts(spark, sf_dir):
    return R.accepts(view(spark, sf_dir, "fx_params"), "T3")


@query("SELECT DISTINCT owner, member FROM fx_params WHERE return_type = 'RType'")
def returns(spark, sf_dir):
    return R.returns(view(spark, sf_dir, "fx_params"), "RType")


@query(
    _CLOSED + ", m AS (SELECT DISTINCT owner, concat('a', substr(name, 2)) AS member FROM fx_params), q AS (SELECT DISTINCT concat('T', o) AS type, concat('a', k) AS member FROM range(1, 4) r(o), range(1, 8) s(k) WHERE k <= o * 2) "
    "SELECT owner, type, count(DISTINCT member) AS n_present, max(n) AS n_required FROM m JOIN q USING (member) JOIN (SELECT type, count(DISTINCT member) AS n FROM q GROUP BY type) USING (type) GROUP BY owner, type"
)
def compatible(spark, sf_dir):
    members = view(spark, sf_dir, "fx_params").select("owner", F.col("name").alias("member")).distinct()
    required = spark.sql("SELECT concat('T', o.id) AS type, concat('a', k.id) AS member FROM range(1, 4) o JOIN range(1, 8) k ON k.id <= o.id * 2")
    return R.compatible(required, members)


@query("SELECT attribute, target_kind, count(*) AS n FROM fx_attributes GROUP BY attribute, target_kind")
def attributes(spark, sf_dir):
    return R.attribute_counts(view(spark, sf_dir, "fx_attributes"))


@query("SELECT target_kind, owner, member, attribute FROM fx_attributes WHERE attribute = 'HIGH'")
def attribute_users(spark, sf_dir):
    return R.attribute_users(view(spark, sf_dir, "fx_attributes"), "IGH", ("H",))


@query("SELECT 'class' AS kind, concat('class ', fqn) AS line FROM fx_symbols WHERE regexp_matches(fqn, '(?i)brand1.c[0-9]*7$') UNION ALL SELECT 'method', concat(owner, '::', member) FROM fx_params WHERE regexp_matches(concat(owner, '::', member), '(?i)brand1.c[0-9]*7$')")
def find_symbols(spark, sf_dir):
    lines = view(spark, sf_dir, "fx_symbols").select("kind", F.concat(F.lit("class "), "fqn").alias("line"))
    lines = lines.unionByName(view(spark, sf_dir, "fx_params").select(F.lit("method").alias("kind"), F.concat("owner", F.lit("::"), "member").alias("line")))
    return R.find_symbols(lines, r"brand1.c[0-9]*7$", ignore_case=True)


@query("SELECT 'namespace' AS kind, replace(p_brand, '#', '') AS name, count(*) AS n FROM part GROUP BY 2")
def namespace_listing(spark, sf_dir):
    return R.namespace_listing(view(spark, sf_dir, "fx_symbols"), "App")


@query(
    _CLOSED + ", i AS (SELECT DISTINCT parent FROM fx_type_edges WHERE rel = 'implements') SELECT fqn, coalesce((SELECT min(parent) FROM fx_type_edges WHERE rel = 'extends' AND child = fqn), '') AS parent, "
    "coalesce((SELECT string_agg(DISTINCT ancestor, ',' ORDER BY ancestor) FROM c WHERE child = fqn AND ancestor IN (SELECT parent FROM i)), '') AS interfaces, "
    "coalesce((SELECT string_agg(DISTINCT parent, ',' ORDER BY parent) FROM fx_type_edges WHERE rel = 'uses' AND child = fqn), '') AS traits FROM fx_classes"
)
def class_page(spark, sf_dir):
    return R.class_page(view(spark, sf_dir, "fx_classes"), view(spark, sf_dir, "fx_type_edges"), R.closure(_edges(spark, sf_dir)))


@query(
    "WITH RECURSIVE c AS (SELECT child, parent AS ancestor, 1 AS depth FROM fx_type_edges WHERE rel = 'extends' UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN fx_type_edges e ON e.child = c.ancestor WHERE e.rel = 'extends' AND c.depth < 40), "
    "m AS (SELECT DISTINCT owner, name AS member FROM fx_params), a AS (SELECT owner, member, owner AS declared_in, 0 AS depth FROM m UNION ALL SELECT c.child, m.member, c.ancestor, c.depth FROM c JOIN m ON m.owner = c.ancestor) "
    "SELECT owner, member, declared_in, CAST(depth AS INT) AS depth FROM a QUALIFY row_number() OVER (PARTITION BY owner, member ORDER BY depth, declared_in) = 1"
)
def inherited_members(spark, sf_dir):
    members = view(spark, sf_dir, "fx_params").select("owner", F.col("name").alias("member")).distinct()
    return R.inherited(members, R.closure(_edges(spark, sf_dir).where("rel = 'extends'")))


@query("SELECT target, kind FROM (SELECT DISTINCT parent AS target, CASE WHEN parent IN (SELECT fqn FROM fx_classes) THEN 'class' ELSE 'trait' END AS kind FROM fx_type_edges WHERE parent IN (SELECT fqn FROM fx_classes) OR starts_with(parent, 'T'))")
def resolve_target(spark, sf_dir):
    edges, classes = view(spark, sf_dir, "fx_type_edges"), view(spark, sf_dir, "fx_classes")
    named = classes.select(F.col("fqn").alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("priority")).unionByName(edges.where("rel = 'uses'").select(F.col("parent").alias("name"), F.lit("trait").alias("kind"), F.lit(2).alias("priority")).distinct())
    return R.resolve(edges.select(F.col("parent").alias("target")).distinct(), named)


@query("SELECT upper(fqn) AS asked, fqn AS name FROM fx_symbols WHERE upper(fqn) <> fqn")
def suggest_name(spark, sf_dir):
    s = view(spark, sf_dir, "fx_symbols")
    return R.suggest(s.select(F.col("fqn").alias("name")), s.select(F.upper("fqn").alias("asked")))


@query("SELECT filename, concat('Pkg', split_part(filename, '/', 3), chr(92), split_part(filename, '/', 4), chr(92), regexp_replace(split_part(filename, '/', 5), '\\.[^./]*$', '')) AS fqn FROM fx_code_files")
def psr4_map(spark, sf_dir):
    files = view(spark, sf_dir, "fx_code_files")
    roots = files.select(F.concat(F.lit("/code/"), F.split("filename", "/")[2]).alias("directory"), F.concat(F.lit("Pkg"), F.split("filename", "/")[2]).alias("namespace")).distinct()
    roots = roots.unionByName(spark.createDataFrame([("/code", "Wrong")], "directory string, namespace string"))
    return R.module_names(files, roots)


@query(
    f"SELECT filename, CASE WHEN a < 60 THEN concat(a, 's') WHEN a < 3600 THEN concat(a // 60, 'm') WHEN a < 86400 THEN concat(a // 3600, 'h') WHEN a < 604800 THEN concat(a // 86400, 'd') "
    f"WHEN a < 2592000 THEN concat(a // 604800, 'w') ELSE concat(a // 2592000, 'mo') END AS age FROM (SELECT filename, {NOW} - filetime AS a FROM fx_files)"
)
def humanise_age(spark, sf_dir):
    return view(spark, sf_dir, "fx_files").select("filename", X.humanise_age(F.lit(NOW) - F.col("filetime")).alias("age"))


@query("SELECT id, CASE WHEN length(s) > 50 THEN concat(left(s, 47), '...') ELSE s END AS preview FROM (SELECT id, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS s FROM fx_entities)")
def signature_preview(spark, sf_dir):
    return view(spark, sf_dir, "fx_entities").select("id", X.preview(X.collapse_space(F.col("signature"))).alias("preview"))


_MEMBER = "concat(repeat('_', CAST(id % 4 AS INT)), 'm', id, CASE WHEN id % 2 = 0 THEN '__' ELSE '' END)"


@query(f"SELECT name, CASE WHEN starts_with(name, '__') AND NOT ends_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS visibility FROM (SELECT {_MEMBER} AS name FROM fx_symbols)")
def member_visibility(spark, sf_dir):
    return view(spark, sf_dir, "fx_symbols").select(F.expr(_MEMBER).alias("name")).select("name", X.visibility(F.col("name")).alias("visibility"))


@query("SELECT filename, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT filename, substr(content, 1, strpos(content, 'return') - 1) AS b FROM fx_code_files)")
def line_of_return(spark, sf_dir):
    return view(spark, sf_dir, "fx_code_files").select("filename", X.line_of(F.col("content"), F.locate("return", F.col("content")) - 1).cast("long").alias("line"))


_SIGNS = ", ".join(f"'{t}'" for t in T.OPERATOR_WORDS if len(t) == 1)


@query(
    "SELECT filename, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT filename, "
    f"list_filter({_raw('content')}, lambda y: trim(y) <> '' AND y NOT IN (';', ',', '.', ':', '=') AND NOT (length(y) = 1 AND NOT regexp_matches(y, '^[A-Za-z0-9]$') AND y NOT IN ({_SIGNS}))) AS t FROM fx_code_files)"
)
def significant_tokens(spark, sf_dir):
    kept = view(spark, sf_dir, "fx_code_files").select("filename", F.filter(T.raw_tokens(F.col("content")), T.significant).alias("t"))
    return kept.select("filename", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


_CHARS = " + ".join(f"length({c})" for c in I.FIELDS)


@query(f"SELECT namespace, count(*) AS n_entities, CAST(sum({_CHARS}) AS BIGINT) AS n_chars, round(CAST(sum({_CHARS}) AS DOUBLE) / count(*), 1) AS per_entity FROM fx_entities GROUP BY namespace")
def index_size(spark, sf_dir):
    chars = F.sum(F.expr(_CHARS))
    return view(spark, sf_dir, "fx_entities").groupBy("namespace").agg(F.count("*").alias("n_entities"), chars.alias("n_chars"), F.round(chars.cast("double") / F.count("*"), 1).alias("per_entity"))


@query(f"SELECT filename, verified_time FROM fx_files WHERE verified_time >= {NOW} - 86400")
def recently_verified(spark, sf_dir):
    return view(spark, sf_dir, "fx_files").where(F.col("verified_time") >= NOW - X.DAY).select("filename", "verified_time").orderBy(F.desc("verified_time"), "filename")


def _change_stream(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file source takes a folder and a pattern of names, a table folder or a single file.
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    user = F.col("user_id")
    name = F.concat(F.lit("/corpus/src"), user % 20, F.lit("/f"), user, F.lit(".md"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), name.alias("filename"), F.concat(F.lit("/corpus/src"), user % 20).alias("project_root"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.concat("event_type", F.lit(" "), "props").alias("content"))


@query("SELECT filename, event_id, content FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ts DESC, event_id DESC) AS k FROM fx_changes) WHERE k = 1 AND op <> 'delete'")
def stream_latest(spark, sf_dir):
    return C.replay(_change_stream(spark, sf_dir)).select("filename", "event_id", "content")


@query("SELECT epoch(time_bucket(INTERVAL 60 SECONDS, ts))::BIGINT AS start, project_root, count(*) AS n FROM fx_changes WHERE time_bucket(INTERVAL 60 SECONDS, ts) + INTERVAL 60 SECONDS <= (SELECT max(ts) FROM fx_changes) - INTERVAL 24 HOURS GROUP BY ALL")
def stream_throttle(spark, sf_dir):
    return C.run_to_end(C.per_minute(_change_stream(spark, sf_dir))).select(F.unix_timestamp("start").alias("start"), "project_root", "n")


@query("SELECT filename, count(*) AS n FROM fx_changes WHERE ts < TIMESTAMP '2024-01-29 00:00:00' GROUP BY filename")
def stream_late(spark, sf_dir):
    _, late = C.split_late(_change_stream(spark, sf_dir), "2024-01-30 00:00:00")
    return C.run_to_end(late).groupBy("filename").agg(F.count("*").alias("n"))


@query(None)
def python_blocks(spark, sf_dir):
    return E.extract(view(spark, sf_dir, "fx_code_files").where("lower(right(filename, 3)) = '.py'"), "python").select("filename", "type", "name", "class_name", "signature", "visibility", "line_start", "line_end")


@query(None)
def snippets(spark, sf_dir):
    q = S.term(spark, "thin") & S.term(spark, "that")
    best = S.top_k(S.rank_bm25(index(spark, sf_dir), q), by="score").select("id")
    return SN.snippets(best, view(spark, sf_dir, "fx_entities"), SN.hit_places(index(spark, sf_dir), q)).select("id", "snippet")
