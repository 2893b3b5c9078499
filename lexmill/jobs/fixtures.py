"""Views over the given tables in the shape of an index: one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = 1704067200

VIEWS = {
    "fx_files": """SELECT concat('/corpus/',source,'/',lang,'/',doc_id,'.md') AS filename, concat('/corpus/',source) AS project_root,
 CAST(1704067200 - doc_id*3600 AS BIGINT) AS filetime, CAST(1704067200 - (doc_id % 72)*3600 AS BIGINT) AS verified_time,
 md5(text) AS file_hash, lang AS language, text AS content, CAST(length(text) % 17 AS BIGINT) AS entry_count FROM documents""",
    "fx_entities": """SELECT doc_id AS id, '' AS preamble, split_part(text, chr(10), 1) AS signature, text AS body, source AS namespace, lang AS ext,
 concat(lang,'/',doc_id,'.md') AS path, 'file' AS type, concat('/corpus/',source,'/',lang,'/',doc_id,'.md') AS filename,
 1 AS line_start, CAST(length(text)-length(replace(text,chr(10),''))+1 AS INT) AS line_end FROM documents""",
    "fx_code_files": """SELECT concat('/code/p',p_partkey % 7,'/',CASE p_partkey % 5 WHEN 0 THEN 'vendor' WHEN 1 THEN '.cache' ELSE 'src' END,'/Part',p_partkey,
 CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.PY' ELSE '' END) AS filename,
 concat('#!/usr/bin/env python3',chr(10),'# ',p_name,chr(10),'class Part',p_partkey,'(Base',p_size,'):',chr(10),'    \"\"\"',p_name,'\"\"\"',chr(10),
 '    def getPriceById(self, part_id):',chr(10),'        return self._price >= ',p_size,chr(10)) AS content FROM part""",
    "fx_symbols": """SELECT p_partkey AS id, concat('App',chr(92),replace(p_brand,'#',''),chr(92),'C',p_partkey) AS fqn, 'class' AS kind,
 concat('/** ',p_name,chr(10),' * more about ',p_type,chr(10),' * @see x */') AS doc FROM part""",
    "fx_type_edges": """SELECT concat('C',p_partkey) AS child, concat('C',CAST(floor((p_partkey-1)/3.0) AS BIGINT)) AS parent, 'extends' AS rel FROM part WHERE p_partkey > 0
 UNION ALL SELECT concat('C',p_partkey), concat('I',p_size), 'implements' FROM part WHERE p_partkey % 5 = 0
 UNION ALL SELECT DISTINCT concat('I',p_size), concat('I',CAST(floor(p_size/2.0) AS BIGINT)), 'implements' FROM part WHERE p_size > 1
 UNION ALL SELECT concat('C',p_partkey), concat('T',p_partkey % 11), 'uses' FROM part WHERE p_partkey % 4 = 0""",
    "fx_classes": """SELECT concat('C',p_partkey) AS fqn, CASE WHEN p_partkey % 9 = 0 THEN 'enum' ELSE 'class' END AS kind,
 concat('/** ',p_name,chr(10),' * more about ',p_type,chr(10),' * @see x */') AS doc FROM part UNION ALL SELECT DISTINCT concat('I',p_size), 'interface', '' FROM part""",
    "fx_params": """SELECT concat('C',l_partkey) AS owner, concat('m',l_orderkey,'_',l_linenumber) AS member, 0 AS ordinal, concat('a',l_linenumber) AS name,
 CASE l_suppkey % 3 WHEN 0 THEN concat('App',chr(92),'T',l_suppkey) WHEN 1 THEN concat('T',l_suppkey,'|null') ELSE concat('?T',l_suppkey) END AS type_expr,
 concat(l_returnflag,'Type') AS return_type FROM lineitem""",
    "fx_members": """SELECT owner, kind, member, min(modifiers) AS modifiers FROM (SELECT concat('C',l_partkey) AS owner,
 CASE l_linenumber % 4 WHEN 0 THEN 'property' WHEN 2 THEN 'constant' ELSE 'method' END AS kind, concat('a',l_linenumber,'_',l_suppkey % 5) AS member,
 CASE WHEN l_quantity > 25 THEN 'public' ELSE 'protected static' END AS modifiers FROM lineitem) m GROUP BY owner, kind, member""",
    "fx_class_flags": """SELECT concat('C',p_partkey) AS fqn, CASE WHEN p_partkey % 9 = 0 THEN 'enum' WHEN p_partkey % 11 = 0 THEN 'trait' ELSE 'class' END AS kind,
 p_partkey % 4 = 0 AS is_final, p_partkey % 5 = 1 AS is_abstract, p_partkey % 6 = 0 AS is_readonly, concat('/** ',p_name,' */') AS doc FROM part""",
    "fx_values": """SELECT owner, kind, member, min(visibility) AS visibility, min(is_static) = 1 AS is_static, min(is_readonly) = 1 AS is_readonly, min(type_expr) AS type_expr, min(value) AS value FROM (SELECT concat('C',l_partkey) AS owner,
 CASE l_linenumber % 3 WHEN 0 THEN 'property' WHEN 1 THEN 'constant' ELSE 'method' END AS kind, concat('a',l_linenumber,'_',l_suppkey % 5) AS member,
 CASE WHEN l_quantity > 25 THEN 'public' ELSE 'private' END AS visibility, l_suppkey % 2 AS is_static, l_suppkey % 3 AS is_readonly,
 CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('?T',l_suppkey % 9) END AS type_expr, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat(chr(39),l_returnflag,chr(39)) END AS value FROM lineitem) m GROUP BY owner, kind, member""",
    "fx_functions": """SELECT concat('C',l_orderkey % 50) AS owner, concat('f',l_orderkey) AS member, l_linenumber AS ordinal, concat('a',l_linenumber) AS name,
 CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('?T',l_suppkey % 9) END AS type_expr, l_linenumber = 7 AS is_variadic, l_partkey % 5 = 0 AS by_ref,
 CASE l_returnflag WHEN 'R' THEN 'null' WHEN 'A' THEN '?' END AS default_value, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE concat('R',l_orderkey % 7) END AS return_type FROM lineitem""",
    "fx_attributes": """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'property' ELSE 'constant' END AS target_kind,
 concat('C',o_custkey) AS owner, concat('m',o_orderkey) AS member, substr(o_orderpriority,3) AS attribute FROM orders""",
    "fx_changes": """SELECT event_id, ts, concat('/corpus/src',user_id % 20,'/f',user_id,'.md') AS filename, concat('/corpus/src',user_id % 20) AS project_root,
 CASE WHEN event_type='error' THEN 'delete' ELSE 'upsert' END AS op, concat(event_type,' ',props) AS content FROM events""",
    "fx_listing": """SELECT concat('/corpus/',source,'/',lang,'/',doc_id,'.md') AS filename, CAST(1704067200 - doc_id*3600 + CASE WHEN doc_id % 7 = 0 THEN 60 ELSE 0 END AS BIGINT) AS mtime
 FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT concat('/corpus/src',item_id % 20,'/en/new',item_id,'.md'), CAST(1704067200 AS BIGINT) FROM benchmark""",
    "fx_projects": """SELECT DISTINCT concat('/corpus/',source) AS project_root, source AS project_name FROM documents
 UNION SELECT DISTINCT concat('/corpus/',source,'/',lang), lang FROM documents WHERE lang = 'de'""",
    "fx_ignore_rules": "SELECT * FROM (VALUES ('/corpus/src1',1,'de/'),('/corpus/src2',1,'*.md'),('/corpus/src2',2,'!/en/'),('/corpus/src3',1,'# comment'),('/corpus/src3',2,'en/1?.md'),('/corpus/src3/fr',1,'**/[12]*.md'),('/corpus/src4',1,'/es'),('/corpus/src4',2,'!9*.md')) AS r(dir, rule_no, pattern)",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in sf_dir."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql, tables = VIEWS[name], {}

    def named(m: re.Match) -> str:
        tables[m[1]] = spark.read.parquet(f"{sf_dir}/{m[1]}.parquet")
        return "{" + m[1] + "}"

    sql = re.sub(r"(?<=FROM )(documents|benchmark|part|lineitem|orders|events)\b", named, sql)
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def with_views(sql: str) -> str:
    """The query with the views that it names as common table expressions in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not used:
        return sql
    head = re.match(r"\s*WITH(\s+RECURSIVE)?\s+", sql)
    return f"WITH {'RECURSIVE ' if head and head[1] else ''}{ctes}, {sql[head.end():]}" if head else f"WITH {ctes} {sql}"
