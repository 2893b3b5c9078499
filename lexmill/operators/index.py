"""Postings and corpus statistics of an entity table, and a stored index that is laid out by token.

Positions are numbered per field: position = field number * FIELD_STEP + token number, so one array holds an
entity's positions of a token in all fields and nothing ever spans two fields.

A stored index is a folder of Parquet tables, each cut into segments:

- `postings/segment=S/shard=K`: a shard holds one range of tokens, sorted by token and by level (how much an occurrence can add to
  a score), so a search opens the shards of its tokens only and may stop at a level. A token with many rows has several shards;
- `terms`: per token and level how many entities have it, and bounds of what it adds;
- `shards`: the token range of each shard; `corpus`: entities and tokens of each project; `dead`: ids whose rows in older
  segments no longer count; `entities`: what was indexed;
- `commits`: a row for each complete segment. A segment without one is not there for readers, and is written anew.

Counts in `terms` and `corpus` of a later segment are differences: what an update takes away is negative. One writer at a
time is assumed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import cap_body
from lexmill.functions.tokens import index_tokens

FIELDS = ("preamble", "signature", "body", "namespace", "ext", "path")
FIELD_STEP = 1 << 32
K1, B = 1.2, 0.75

#: Levels of a token's postings, and the entity length for which they are drawn.
LEVELS = 16
LEVEL_LENGTH = 256
#: Entities, and tokens of each, that show where shards begin. They only decide how rows are dealt out.
SAMPLE_ENTITIES = 1000
SAMPLE_TOKENS = 256
#: Entities and bytes of an Arrow batch that goes to a Python worker, and tokens that one pass there covers (a longer entity goes alone).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
PASS_TOKENS = 1 << 18


def tokenised(entities: DataFrame, fields: tuple[str, ...] = FIELDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, `carry`, and one array of (position, token) structs over all fields."""
    placed = lambda k: lambda t, i: F.struct((F.lit(k * FIELD_STEP) + i).alias("position"), t.alias("token"))
    per_field = [F.transform(index_tokens(F.coalesce(F.col(f), F.lit(""))), placed(k)) for k, f in enumerate(fields)]
    return entities.select("id", *carry, F.concat(*per_field).alias("tokens"))


def added(f: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What a token with `f` occurrences adds to the score of an entity of `dl` tokens, for an inverse frequency of 1."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch where they are larger, so that a worker's memory does not grow with the table."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        digits = spark.conf.get(key).strip().lower().removesuffix("b")
        if not (digits.isdigit() and 0 < int(digits) <= most):
            spark.conf.set(key, str(most))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about PASS_TOKENS tokens."""
    ends = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PASS_TOKENS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def postings(entities: DataFrame, fields: tuple[str, ...] = FIELDS, carry: tuple[str, ...] = (), bounds: list[str] | None = None) -> DataFrame:
    """id, field, token, tf, positions (in the field), dl (tokens of the entity), whether the row is the entity's first one of the
    token, f (the token's occurrences in the entity) and `carry`.

    All tokens of an entity are in its own row, so they are grouped there, an Arrow batch at a time: no shuffle. With
    `bounds` (of shard_bounds()) rows also have a level and a shard, and each entity has a row with an empty token.
    """
    id_type = entities.schema["id"].dataType.simpleString()
    carried = "".join(f", {c} {entities.schema[c].dataType.simpleString()}" for c in carry)
    edges = None if bounds is None else np.array(bounds, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            lists = batch.column("tokens")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            position, token = lists.flatten().flatten()
            token = token.dictionary_encode()
            position, code, owner = position.to_numpy(), token.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((position, code, owner))
            position, code, owner = position[order], code[order], owner[order]
            in_field = position // FIELD_STEP
            other = np.ones(len(order), bool)
            other[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            new = other.copy()
            new[1:] |= in_field[1:] != in_field[:-1]
            at = np.flatnonzero(new)
            each = np.diff(np.append(np.flatnonzero(other), len(order)))
            f = each[np.cumsum(other[at]) - 1] if len(at) else each
            rows = {
                "id": batch.column("id").take(pa.array(owner[at])),
                "field": pa.array(fields).take(pa.array(in_field[at])),
                "token": token.dictionary.take(pa.array(code[at])),
                "tf": np.diff(np.append(at, len(order))),
                "positions": pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), pa.array(position % FIELD_STEP)),
                "dl": sizes[owner[at]].astype(np.int64),
                "is_first": other[at],
                "f": f,
            } | {c: batch.column(c).take(pa.array(owner[at])) for c in carry}
            if edges is not None:
                names = np.array(token.dictionary.to_pylist(), object)
                low, high = (np.searchsorted(edges, names, side) for side in ("left", "right"))
                salt = owner[at] + zlib.crc32(str(batch.column("id")[0]).encode()) % (1 << 20)
                rows["level"] = np.minimum(added(f, rows["dl"], LEVEL_LENGTH) / (K1 + 1) * LEVELS, LEVELS - 1).astype(np.int32)
                rows["shard"] = (low[code[at]] + salt % (high - low + 1)[code[at]]).astype(np.int32)
                n = len(sizes)
                whole = {"id": batch.column("id"), "field": pa.nulls(n, pa.string()), "token": pa.array([""] * n), "tf": np.zeros(n, np.int64), "positions": pa.nulls(n, pa.list_(pa.int64())), "dl": sizes.astype(np.int64), "is_first": np.ones(n, bool), "f": np.zeros(n, np.int64)} | {c: batch.column(c) for c in carry}
                whole |= {"level": np.zeros(n, np.int32), "shard": (np.arange(n) % (np.searchsorted(edges, "", "right") + 1)).astype(np.int32)}
                yield pa.RecordBatch.from_pydict(whole)
            if len(at):
                yield pa.RecordBatch.from_pydict(rows)

    _bound_batches(entities.sparkSession)
    laid_out = "" if bounds is None else ", level int, shard int"
    return tokenised(entities, fields, carry).mapInArrow(run, f"id {id_type}, field string, token string, tf long, positions array<long>, dl long, is_first boolean, f long{carried}{laid_out}")


def term_stats(found: DataFrame) -> DataFrame:
    """token, df (entities with the token), cf (occurrences), from postings: one map-side combined shuffle."""
    return found.groupBy("token").agg(F.count_if("is_first").alias("df"), F.sum("tf").alias("cf"))


def doc_stats(entities: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, dl: tokens of all fields. No shuffle."""
    return tokenised(entities, fields).select("id", F.size("tokens").cast("long").alias("dl"))


def shard_bounds(entities: DataFrame, shards: int) -> list[str]:
    """Tokens at which the shards but the first begin, from a bounded sample of entities; a token that fills several shards is
    there several times."""
    n = entities.count()
    some = entities.sample(min(1.0, SAMPLE_ENTITIES / n), 7) if n > SAMPLE_ENTITIES else entities
    tokens = F.slice(F.array_distinct(F.expr("transform(tokens, x -> x.token)")), 1, SAMPLE_TOKENS)
    each = tokenised(some.limit(2 * SAMPLE_ENTITIES)).select(F.explode(F.concat(F.array(F.lit("")), tokens)).alias("token"))
    counts = sorted((r[0], r[1]) for r in each.groupBy("token").agg(F.count("*")).collect())
    ends = np.cumsum([c for _, c in counts]) if counts else np.zeros(0)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards) if len(ends) else []
    return [counts[i][0] for i in at]


@dataclass(frozen=True)
class Index:
    """A stored index, as it was when opened."""

    spark: SparkSession
    path: str
    segments: tuple[int, ...]
    batches: tuple[str, ...]
    bounds: dict[int, list[str]] = field(hash=False)
    project: str | None = None

    def table(self, name: str) -> DataFrame:
        """One of the index's tables; rows of segments that are not complete, or replaced, are left out."""
        df = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={s}" for s in self.segments])
        return df if self.project is None or "project_root" not in df.columns else df.where(F.col("project_root") == self.project)

    def living(self, rows: DataFrame) -> DataFrame:
        """The rows (id, segment) that no later segment has taken away."""
        if len(self.segments) == 1:
            return rows
        dead = self.table("dead").select(F.col("id").alias("_id"), F.col("segment").alias("_until"))
        return rows.join(dead, (rows["id"] == dead["_id"]) & (rows["segment"] < dead["_until"]), "left_anti")

    def entities(self) -> DataFrame:
        return self.living(self.table("entities")).drop("segment")

    def rows(self, wanted: Column | None = None, places: Column | None = None) -> DataFrame:
        """Living postings; `places` is a condition on the segment and shard."""
        found = self.table("postings").where(F.col("token") != "")
        for condition in (places, wanted):
            found = found if condition is None else found.where(condition)
        return self.living(found)

    @property
    def postings(self) -> DataFrame:
        return self.rows().drop("segment", "shard", "level")

    def places(self, keys: list[tuple[str, bool]]) -> Column:
        """The shards whose token range may hold one of the (token, is a prefix)."""
        out = F.lit(False)
        for segment, edges in self.bounds.items():
            lows, highs = ["", *edges], [*edges, None]
            mine = [k for k, (low, high) in enumerate(zip(lows, highs, strict=True)) if any((low <= t or p and low.startswith(t)) and (high is None or high >= t) for t, p in keys)]
            out = out | ((F.col("segment") == segment) & F.col("shard").isin(mine))
        return out

    def _shards_of(self, tokens: DataFrame, is_prefix: bool = False) -> Column:
        """The shards that may hold one of the tokens (token), or one that begins so."""
        ranges = [(s, k, low, high) for s, edges in self.bounds.items() for k, (low, high) in enumerate(zip(["", *edges], [*edges, None], strict=True))]
        shards = F.broadcast(self.spark.createDataFrame(ranges, "segment int, shard int, low string, high string"))  # a row a shard
        low = F.col("token") >= F.col("low")
        low = low | F.col("low").startswith(F.col("token")) if is_prefix else low
        hit = tokens.join(shards, low & (F.col("high").isNull() | (F.col("token") <= F.col("high")))).select("segment", "shard").distinct().collect()
        mine: dict[int, list[int]] = {}
        for segment, shard in hit:
            mine.setdefault(segment, []).append(shard)
        places = F.lit(False)
        for segment, shard in mine.items():
            places = places | ((F.col("segment") == segment) & F.col("shard").isin(shard))
        return places

    def of_tokens(self, tokens: DataFrame) -> DataFrame:
        """Living postings of the tokens of a table (token); only the shards that may hold one of them are read."""
        return self.rows(places=self._shards_of(tokens)).join(tokens.select("token").distinct(), "token", "left_semi")

    def of_ranges(self, begun: DataFrame, whole: DataFrame) -> DataFrame:
        """Living postings of the shards that may hold one of the `whole` tokens (token) or one that begins like one of `begun`."""
        return self.rows(places=self._shards_of(begun, True) | self._shards_of(whole))

    def terms(self, tokens: list[str]) -> DataFrame:
        """token, level, n (entities), most, least (bounds of what an occurrence list adds, for an inverse frequency of 1 and the
        average length at writing), avgdl (at writing). `n` may be negative: sums over all rows count."""
        return self.table("terms").where(self.places([(t, False) for t in tokens]) & F.col("token").isin(tokens))

    @property
    def corpus(self) -> DataFrame:
        """project_root, n (entities), tokens."""
        return self.table("corpus").groupBy("project_root").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))

    def n_dead(self) -> int:
        return self.table("dead").count() if len(self.segments) > 1 else 0


def _commits(spark: SparkSession, path: str) -> list[dict]:
    try:
        return [json.loads(r[0]) for r in spark.read.text(f"{path}/commits").collect()]  # a row a segment
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def open_index(spark: SparkSession, path: str, project: str | None = None) -> Index:
    found = sorted(_commits(spark, path), key=lambda c: c["segment"])
    if not found:
        raise ValueError(f"no index at {path}")
    first = max(c["segment"] for c in found if c["replaces"])
    live = [c for c in found if c["segment"] >= first]
    return Index(spark, path, tuple(c["segment"] for c in live), tuple(c["batch"] for c in found), {c["segment"]: c["bounds"] for c in live}, project)


def _statistics(rows: DataFrame, avgdl: float) -> DataFrame:
    """shard, token, level, n, cf, most, least, avgdl of postings."""
    adds = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return rows.where("token <> ''").groupBy("shard", "token", "level").agg(F.count_if("is_first").alias("n"), F.sum("tf").alias("cf"), F.max(adds).alias("most"), F.min(adds).alias("least")).withColumn("avgdl", F.lit(avgdl))


def _write(df: DataFrame, path: str, name: str, segment: int, *by: str) -> str:
    at = f"{path}/{name}/segment={segment}"
    df.write.mode("overwrite").partitionBy(*by).parquet(at)
    return at


def update_index(entities: DataFrame, path: str, gone: DataFrame | None = None, batch: str | None = None, shards: int | None = None, body_chars: int | None = None, beside: dict[str, DataFrame] | None = None) -> bool:
    """Add the entities to the index as a segment of its own; the entities whose ids are in `gone` count no more.

    Without `gone` the segment replaces all earlier ones. A batch that was committed before is not written again (False); one that
    was cut off is written anew in its place. Entities are tokenised once, and those that go once more for their counts.
    Tables in `beside` are written with the segment, to be read by Index.table(). `body_chars` cuts bodies before they are tokenised, as a tool for one machine does; by default they are whole.
    """
    spark = entities.sparkSession
    before = open_index(spark, path) if _commits(spark, path) else None
    if batch is not None and before is not None and batch in before.batches:
        return False
    segment = 1 + max(c["segment"] for c in _commits(spark, path)) if before else 0
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    capped = entities if body_chars is None else entities.withColumn("body", cap_body(F.col("body"), body_chars))
    edges = shard_bounds(capped, shards)
    rows = postings(capped, carry=("project_root",), bounds=edges).repartitionById(len(edges) + 1, "shard")
    at = _write(rows.sortWithinPartitions("shard", "token", F.desc("level"), "id"), path, "postings", segment, "shard")
    for name, table in ({"entities": entities} | (beside or {})).items():
        _write(table, path, name, segment)
    stored = spark.read.schema(rows.schema).parquet(at)
    corpus = stored.where("token = ''").groupBy("project_root").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    replaces = gone is None or before is None
    ids = None
    if not replaces:
        ids = gone.select("id").distinct()
        _write(ids, path, "dead", segment)
        ids = spark.read.parquet(f"{path}/dead/segment={segment}")
        left = before.living(before.table("entities")).join(ids, "id", "left_semi")
        left = left if body_chars is None else left.withColumn("body", cap_body(F.col("body"), body_chars))
        taken = postings(left, carry=("project_root",), bounds=edges)
        less = taken.where("token = ''").groupBy("project_root").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("tokens"))
        corpus = corpus.unionByName(less)
    else:
        _write(entities.select("id").where("false"), path, "dead", segment)
    _write(corpus, path, "corpus", segment)
    known = spark.read.parquet(f"{path}/corpus/segment={segment}").agg(F.sum("n"), F.sum("tokens")).first()
    if not replaces:
        have = before.table("corpus").agg(F.sum("n"), F.sum("tokens")).first()
        known = tuple((a or 0) + (b or 0) for a, b in zip(known, have, strict=True))
    avgdl = float(known[1]) / known[0] if known[0] and known[1] else 1.0
    terms = _statistics(stored, avgdl)
    if not replaces:
        terms = terms.unionByName(_statistics(taken, avgdl).withColumns({"n": -F.col("n"), "cf": -F.col("cf")}))
    terms = terms.repartitionById(len(edges) + 1, "shard").sortWithinPartitions("shard", "token")
    _write(terms, path, "terms", segment, "shard")
    commit = json.dumps({"segment": segment, "batch": batch or f"segment {segment}", "replaces": replaces, "bounds": edges})
    spark.createDataFrame([(commit,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/commits/segment={segment}")
    return True


def write_index(entities: DataFrame, path: str, **how) -> None:
    """Index the entities; those that an index at `path` has of the same projects go, those of other projects stay."""
    spark = entities.sparkSession
    if not _commits(spark, path):
        update_index(entities, path, **how)
        return
    own = entities.select("project_root").distinct()
    gone = open_index(spark, path).entities().join(own, "project_root", "left_semi").select("id")
    update_index(entities, path, gone, **how)


def compact(spark: SparkSession, path: str, **how) -> None:
    """Write all living entities as one segment that replaces the others."""
    update_index(open_index(spark, path).entities(), path, **how)


def has_index(spark: SparkSession, path: str) -> bool:
    return bool(_commits(spark, path))
