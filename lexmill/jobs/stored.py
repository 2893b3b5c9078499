"""Registered queries over stored indexes: layout, bounded top-k, query trees, updates and change feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import tokens as T
from lexmill.jobs.catalog import _AGE, _FIELD, _SCORES, _TOK, _change_stream, _idx, index, query
from lexmill.jobs.fixtures import NOW, view
from lexmill.jobs.more import _DIFF, _NEW, _diffed, _fresh
from lexmill.operators import batch as BA
from lexmill.operators import index as I
from lexmill.operators import search as S
from lexmill.operators import snippets as SN
from lexmill.operators import symbols as R
from lexmill.streaming import changes as C


@query(f"WITH {_TOK} SELECT id, {_FIELD} AS field, token, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions, concat('/corpus/', namespace) AS project_root FROM tok JOIN fx_entities USING (id) GROUP BY id, f, token, namespace")
def stored_postings(spark, sf_dir):
    """The postings as the stored index gives them back."""
    p = index(spark, sf_dir).postings
    return p.select("id", "field", "token", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), "project_root")


@query(f"WITH {_TOK} SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM tok GROUP BY token")
def stored_terms(spark, sf_dir):
    """The index's term dictionary."""
    return index(spark, sf_dir).table("terms").groupBy("token").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


@query(
    _SCORES + ", q AS (SELECT id, -sum(s) AS score FROM sc WHERE token IN ('thin', 'that', 'und') GROUP BY id), "
    f"r AS (SELECT id, score, score + 4.0 * pow({_AGE}, 1.5) / (1.0 + pow({_AGE}, 1.5)) AS adjusted FROM q JOIN fx_entities USING (id) JOIN (SELECT filename, filetime FROM fx_files) USING (filename)) "
    "SELECT id, round(score, 6) AS score, round(adjusted, 6) AS adjusted_rank FROM r ORDER BY round(adjusted, 6), id LIMIT 20"
)
def search_best(spark, sf_dir):
    """The best 20 of any of three tokens, age included, by bounds: only levels that can hold one of them are read."""
    e, files = view(spark, sf_dir, "fx_entities"), view(spark, sf_dir, "fx_files")
    ages = e.select("id", "filename").join(files.select("filename", "filetime"), "filename").select("id", X.age_penalty(F.col("filetime"), NOW).alias("penalty"))
    best = S.top_terms(index(spark, sf_dir), ["thin", "that", "und"], 20, ages)
    return best.select("id", F.round("score", 6).alias("score"), F.round("adjusted_rank", 6).alias("adjusted_rank"))


#: Of each benchmark text's tokens t: ((t1 t2 as a phrase, or t3 near t4) and any token that begins like t5 in the body), but not t6.
_TREES = (
    f"WITH {_TOK}, qt AS (SELECT item_id AS q, {_idx('text')} AS t FROM benchmark), ql AS (SELECT q, t[1] AS t1, t[2] AS t2, t[3] AS t3, t[4] AS t4, left(t[5], 2) AS t5, t[6] AS t6 FROM qt WHERE len(t) >= 6), "
    "a AS (SELECT DISTINCT q, x.id FROM ql JOIN tok x ON x.token = t1 JOIN tok y ON y.token = t2 AND y.id = x.id AND y.f = x.f AND y.pos = x.pos + 1), "
    "b AS (SELECT DISTINCT q, x.id FROM ql JOIN tok x ON x.token = t3 JOIN tok y ON y.token = t4 AND y.id = x.id AND y.f = x.f AND abs(y.pos - x.pos) <= 6), "
    "c AS (SELECT DISTINCT q, x.id FROM ql JOIN tok x ON starts_with(x.token, t5) AND x.f = 2), "
    "d AS (SELECT DISTINCT q, x.id FROM ql JOIN tok x ON x.token = t6) "
    "SELECT q AS query_id, id FROM ((SELECT * FROM a UNION SELECT * FROM b) INTERSECT SELECT * FROM c) EXCEPT SELECT q, id FROM d"
)


def query_trees(spark, sf_dir):
    """A tree for each benchmark text, as rows; texts that share an item_id are alternatives in one tree."""
    t = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("query_id"), T.index_tokens(F.col("text")).alias("t")).where("size(t) >= 6")
    t = t.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("t")) - 1)
    token = lambda *i: F.array(*[F.get("t", F.lit(k)) for k in i])
    start = F.array(F.substring(F.get("t", F.lit(4)), 1, 2))
    body, none = F.array(F.lit("body")), F.lit(None)
    rows = [(0, None, 0, "minus", none, False, none, None), (1, 0, 0, "and", none, False, none, None), (2, 1, 0, "or", none, False, none, None), (3, 2, 0, "phrase", token(0, 1), False, none, None), (4, 2, 1, "near", none, False, none, 5),
            (5, 4, 0, "phrase", token(2), False, none, None), (6, 4, 1, "phrase", token(3), False, none, None), (7, 1, 1, "phrase", start, True, body, None), (8, 0, 1, "phrase", token(5), False, none, None)]
    own = lambda n: F.lit(n).cast("int") if n is None or n < 3 else F.lit(n) + 6 * F.col("nth")
    node = lambda n, p, s, op, ts, pre, fs, d: F.struct(own(n).alias("node"), own(p).alias("parent"), F.lit(s).alias("side"), F.lit(op).alias("op"), ts.cast("array<string>").alias("tokens"), F.lit(pre).alias("is_prefix"), fs.cast("array<string>").alias("fields"), F.lit(False).alias("is_initial"), F.lit(d).cast("int").alias("distance"))
    tree = F.array(*[node(*r) for r in rows])
    return t.select("query_id", F.inline(F.filter(tree, lambda x: (F.col("nth") == 0) | (x["node"] > 2))))


@query(_TREES)
def search_trees(spark, sf_dir):
    """The trees ask for nearly every posting of a body once, so the texts are read as they are: an index of them would have to be
    written first, and dealt out again by entity."""
    return BA.matches(view(spark, sf_dir, "fx_entities").where("id IS NOT NULL"), query_trees(spark, sf_dir))


@query(
    f"{_DIFF}, {_NEW}, a AS (SELECT e.id, CASE WHEN status = 'changed' THEN concat(body, ' zusatz') ELSE body END AS body FROM fx_entities e JOIN d USING (filename) WHERE status <> 'deleted' UNION ALL SELECT id, text FROM n), "
    f"t AS (SELECT id, unnest({_idx('body')}) AS token FROM a) SELECT token, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY token"
)
def updated_index(spark, sf_dir):
    """A stored index of bodies after an update is written to it: the term dictionary, which holds differences."""
    path = f"{R.shared_folder(spark)}/index-{uuid.uuid4()}"
    only_body = lambda df: df.select("id", *[F.lit("").alias(c) if c != "body" else F.col(c) for c in I.FIELDS], F.lit("/corpus").alias("project_root"), "filename")
    I.write_index(only_body(view(spark, sf_dir, "fx_entities")), path)
    diff = _diffed(spark, sf_dir)
    fresh = _fresh(spark, sf_dir).join(diff.where("status IN ('new', 'changed')").select("filename"), "filename", "left_semi")
    gone = I.open_index(spark, path).entities().join(diff.where("status <> 'unchanged'").select("filename"), "filename", "left_semi").select("id")
    I.update_index(only_body(fresh), path, gone, "update")
    terms = I.open_index(spark, path).table("terms").groupBy("token").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
    return terms.where("df > 0")


@query(
    "WITH v AS (SELECT filename, content FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ts DESC, event_id DESC) AS k FROM fx_changes) WHERE k = 1 AND op <> 'delete'), "
    f"t AS (SELECT filename, unnest({_idx('content')}) AS token FROM v) SELECT token, count(DISTINCT filename) AS df, count(*) AS cf FROM t GROUP BY token"
)
def stream_to_index(spark, sf_dir):
    """The term dictionary of an index that a change stream was run into."""
    base = f"{R.shared_folder(spark)}/fed-{uuid.uuid4()}"
    made = lambda rows: rows.select(F.xxhash64("filename").alias("id"), *[F.lit("").alias(c) if c != "body" else F.col("content").alias(c) for c in I.FIELDS], "project_root", "filename")
    C.index_changes(_change_stream(spark, sf_dir), f"{base}/index", made, f"{base}/feed", 2)
    return I.open_index(spark, f"{base}/index").table("terms").groupBy("token").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).where("df > 0")


@query(
    "SELECT filename, epoch_us(ts) AS micros, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY filename ORDER BY ts, event_id) AS next FROM fx_changes) "
    "WHERE next IS NULL AND ts + INTERVAL 24 HOURS < (SELECT max(ts) FROM fx_changes)"
)
def stream_quiet(spark, sf_dir):
    """Files without a change in the last day of the feed, given out by their timers; of each its last quiet time."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = C.run_to_end(C.quiet_files(_change_stream(spark, sf_dir)))
    finally:
        spark.conf.set(key, before)
    return found.groupBy("filename").agg(F.max(F.struct("micros", "event_id")).alias("s")).select("filename", "s.*")


@query(
    _SCORES + ", ids AS (SELECT id FROM sc WHERE token IN ('thin', 'that') GROUP BY id HAVING count(*) = 2 ORDER BY round(-sum(s), 6), id LIMIT 20), "
    "h AS (SELECT id, f, pos FROM tok JOIN ids USING (id) WHERE token IN ('thin', 'that')), n AS (SELECT id, f, count(*) AS n FROM tok JOIN ids USING (id) GROUP BY id, f), "
    "w AS (SELECT DISTINCT id, f, least(pos, greatest(n - 45, 0)) AS s FROM h JOIN n USING (id, f)), "
    "c AS (SELECT w.id, w.f, w.s, count(*) AS n_hits FROM w JOIN h ON h.id = w.id AND h.f = w.f AND h.pos BETWEEN w.s AND w.s + 44 GROUP BY ALL) "
    f"SELECT id, {_FIELD} AS field, s AS first, n_hits FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_hits DESC, f, s) = 1"
)
def best_fragments(spark, sf_dir):
    """Where the best fragments of the best 20 hits stand, in whatever field."""
    q = S.term(spark, "thin") & S.term(spark, "that")
    best = S.top_k(S.rank_bm25(index(spark, sf_dir), q), by="score").select("id")
    return SN.snippets(best, view(spark, sf_dir, "fx_entities"), SN.hit_places(index(spark, sf_dir), q)).select("id", "field", "first", "n_hits")
