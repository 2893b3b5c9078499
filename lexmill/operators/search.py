"""Full-text search: a query builder, matching over postings, BM25 ranking and top-k.

A search reads the postings of its tokens, from a stored index (index.open_index: only the shards of its tokens are
opened) or made from an entity table on the way. They are grouped once by entity into one position array a
token (index.FIELD_STEP keeps fields apart). Phrases, prefixes, field filters, `^` and NEAR are array expressions on
these arrays, so one shuffle on the entity serves any query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import age_penalty
from lexmill.functions.tokens import index_tokens
from lexmill.operators.files import apply_ignore_rules
from lexmill.operators.index import B, FIELD_STEP, FIELDS, K1, Index, tokenised
from lexmill.operators.symbols import checkpointed

Source = DataFrame | Index

#: Scores are compared when rounded to so many places; bounds leave this margin.
PLACES, MARGIN = 6, 1e-5
#: Terms of a batch of queries that are broadcast; more are joined by a shuffle.
MAX_TERMS = 1_000_000


class Query:
    def __and__(self, other: Query) -> Query:
        return And(self, other)

    def __or__(self, other: Query) -> Query:
        return Or(self, other)

    def __sub__(self, other: Query) -> Query:
        return Minus(self, other)


@dataclass(frozen=True, eq=False)
class Phrase(Query):
    """Consecutive tokens in one field; the last may be a prefix."""

    tokens: tuple[str, ...]
    is_prefix: bool = False
    fields: tuple[str, ...] = FIELDS
    is_initial: bool = False

    def in_fields(self, *fields: str) -> Phrase:
        return replace(self, fields=tuple(f for f in self.fields if f in fields))

    def not_in_fields(self, *fields: str) -> Phrase:
        return replace(self, fields=tuple(f for f in self.fields if f not in fields))

    def initial(self) -> Phrase:
        return replace(self, is_initial=True)


@dataclass(frozen=True, eq=False)
class And(Query):
    left: Query
    right: Query


@dataclass(frozen=True, eq=False)
class Or(Query):
    left: Query
    right: Query


@dataclass(frozen=True, eq=False)
class Minus(Query):
    left: Query
    right: Query


@dataclass(frozen=True, eq=False)
class Near(Query):
    phrases: tuple[Phrase, ...]
    distance: int = 10


def phrase(spark, text: str) -> Phrase:
    """The text's tokens as a phrase; the same column functions as for the index make them."""
    return Phrase(tuple(spark.range(1).select(index_tokens(F.lit(text))).first()[0]))


def term(spark, text: str) -> Phrase:
    return phrase(spark, text)


def prefix(spark, text: str) -> Phrase:
    return replace(phrase(spark, text), is_prefix=True)


def _phrases(q: Query) -> list[Phrase]:
    if isinstance(q, Phrase):
        return [q]
    return list(q.phrases) if isinstance(q, Near) else _phrases(q.left) + _phrases(q.right)


class _Plan:
    """Columns of a query over grouped position arrays."""

    def __init__(self, q: Query):
        self.q = q
        self.leaves = _phrases(q)
        self.keys: dict[tuple[str, bool], str] = {}
        for p in self.leaves:
            for i, t in enumerate(p.tokens):
                self.keys.setdefault((t, p.is_prefix and i == len(p.tokens) - 1), f"t{len(self.keys)}")

    def wanted(self, token: Column, key: tuple[str, bool]) -> Column:
        return token.startswith(key[0]) if key[1] else token == key[0]

    def token_rows(self, source: Source, fields: tuple[str, ...]) -> DataFrame:
        """id, dl, token, positions of the query's tokens."""
        if isinstance(source, Index):
            if fields != FIELDS:
                raise ValueError("an index holds all fields; use in_fields()")
            return placed(source.rows(_any([self.wanted(F.col("token"), k) for k in self.keys]), source.places(list(self.keys))))
        asked = lambda x: _any([self.wanted(x["token"], k) for k in self.keys])
        rows = tokenised(source, fields).select("id", F.size("tokens").cast("long").alias("dl"), F.inline(F.filter("tokens", asked)))
        return rows.select("id", "dl", "token", F.array("position").alias("positions"))

    def grouped(self, source: Source, fields: tuple[str, ...]) -> DataFrame:
        """id, dl and the instances of each phrase, for entities with a query token. Only rows of query tokens are
        dealt out by entity."""
        # The rows of one entity for one query: their number is bounded by the entity's length.
        lists = [F.flatten(F.collect_list(F.when(self.wanted(F.col("token"), k), F.col("positions")))).alias(n) for k, n in self.keys.items()]
        rows = self.token_rows(source, fields).groupBy("id").agg(F.first("dl").alias("dl"), *lists)
        rows = rows.select("id", "dl", *[self.instances(p).alias(f"p{i}") for i, p in enumerate(self.leaves)])
        return rows.select("*", *[self.held(q, at).alias(f"near{at}") for q, at in self.nears()])

    def instances(self, p: Phrase) -> Column:
        """First positions of the phrase's instances under its own filters."""
        last = len(p.tokens) - 1
        names = [self.keys[(t, p.is_prefix and i == last)] for i, t in enumerate(p.tokens)]
        out = F.col(names[0])
        for i, name in enumerate(names[1:], 1):
            out = F.array_intersect(out, F.transform(name, _plus(-i)))
        if p.fields != FIELDS:
            numbers = [FIELDS.index(f) for f in p.fields]
            out = F.filter(out, lambda x: F.floor(x / FIELD_STEP).isin(*numbers)) if numbers else F.filter(out, lambda x: F.lit(False))
        return F.filter(out, lambda x: x % FIELD_STEP == 0) if p.is_initial else out

    def nears(self, q: Query | None = None, at: int = 0) -> list[tuple[Near, int]]:
        """NEAR groups and the number of their first leaf."""
        q = q or self.q
        if isinstance(q, Near):
            return [(q, at)]
        return [] if isinstance(q, Phrase) else self.nears(q.left, at) + self.nears(q.right, at + len(_phrases(q.left)))

    def held(self, q: Near, at: int) -> Column:
        """An array a phrase: its instances that stand in a group."""
        parts = [F.struct(F.col(f"p{at + i}").alias("starts"), F.lit(len(p.tokens)).alias("size")) for i, p in enumerate(q.phrases)]
        return near_instances(F.array(*parts), F.lit(q.distance))

    def near(self, q: Near, at: int) -> list[Column]:
        """Instances of each phrase that stand in a group."""
        return [F.get(f"near{at}", F.lit(i)) for i in range(len(q.phrases))]

    def evaluate(self, q: Query | None = None, at: int = 0) -> tuple[Column, dict[int, Column], int]:
        """Whether the entity matches, the instance count of each phrase that scores, and the next leaf's number."""
        q = q or self.q
        if isinstance(q, Phrase):
            n = F.size(f"p{at}")
            return n > 0, {at: n}, at + 1
        if isinstance(q, Near):
            found = self.near(q, at)
            return _all([F.size(x) > 0 for x in found]), {at + i: F.size(x) for i, x in enumerate(found)}, at + len(found)
        left, left_counts, at = self.evaluate(q.left, at)
        right, right_counts, at = self.evaluate(q.right, at)
        if isinstance(q, Minus):
            return left & ~right, left_counts, at
        gate = lambda counts, ok: {k: F.when(ok, c).otherwise(0) for k, c in counts.items()}
        if isinstance(q, Or):
            return left | right, gate(left_counts, left) | gate(right_counts, right), at
        return left & right, left_counts | right_counts, at


def placed(rows: DataFrame) -> DataFrame:
    """id, dl, token, positions (told apart by field) of stored postings."""
    step = F.lit(FIELD_STEP) * (F.array_position(F.array(*[F.lit(f) for f in FIELDS]), F.col("field")) - 1)
    return rows.select("id", "dl", "token", step.alias("step"), "positions").select("id", "dl", "token", F.transform("positions", lambda p: p + F.col("step")).alias("positions"))


def _plus(n: int):
    return lambda x: x + F.lit(n)


#: Room that a row's positions have where the rows of a batch are numbered through.
_ROOM = 4 * len(FIELDS) * FIELD_STEP


def near_instances(parts: Column, distance: Column) -> Column:
    """Of each part (starts, size) of a NEAR group its starts from or to an end at which all parts occur within `distance` tokens.

    An end holds if each part has a start x with x + size >= end and x <= end + distance: the first start that is not too early
    tells, so the work grows with the positions and their logarithm, however often a token occurs in one entity.
    """
    return F.arrow_udf(lambda p, d: pa.array(_near_instances(p, d), pa.list_(pa.list_(pa.int64()))), "array<array<long>>")(parts, distance)


def _near_instances(parts: pa.Array, distance: pa.Array) -> list[list[np.ndarray]]:
    n, count = len(parts), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    starts, size = flat.field("starts"), flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, first = np.repeat(np.arange(n), count), np.concatenate([[0], np.cumsum(count)])[:-1]
    slot = np.arange(len(row)) - first[row]
    reach = np.minimum(distance.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), len(FIELDS) * FIELD_STEP)
    part = np.repeat(np.arange(len(row)), lengths)
    x = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + row[part] * _ROOM
    order = np.lexsort((x, part))
    x, part = x[order], part[order]
    ends = np.sort(x + size[part])
    of = ends // _ROOM
    good = distance.is_valid().to_numpy(zero_copy_only=False)[of]
    for k in range(int(count.max(initial=0))):
        mine = x[slot[part] == k]  # by row, then by place
        whose = first[of] + k
        has = count[of] > k
        whose = np.where(has, whose, 0)
        at = np.searchsorted(mine, ends - size[whose])
        found = np.append(mine, np.iinfo(np.int64).max)[at]
        good &= ~has | (found <= ends + reach[of])
    ends = np.append(ends[good], np.iinfo(np.int64).max)
    owner = row[part]
    held = ends[np.searchsorted(ends, x - reach[owner])] <= x + size[part]
    kept = x - owner * _ROOM
    edges = np.concatenate([[0], np.cumsum(lengths)])
    lists = [kept[a:b][held[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [lists[a : a + c] for a, c in zip(first, count, strict=True)]


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def matches(entities: Source, q: Query, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id of the entities that match."""
    plan = _Plan(q)
    return plan.grouped(entities, fields).where(plan.evaluate()[0]).select("id")


def rank_bm25(entities: Source, q: Query, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, score (smaller is better) of the matches."""
    plan = _Plan(q)
    rows = plan.grouped(entities, fields)
    match, counts, _ = plan.evaluate()
    corpus = corpus_stats(entities, fields)
    found = rows.agg(*[F.count_if(F.size(f"p{i}") > 0).alias(f"n{i}") for i in range(len(plan.leaves))])
    hits = rows.where(match)
    # Two rows of scalars; broadcasts of fixed size.
    scored = hits.join(F.broadcast(corpus)).join(F.broadcast(found))
    score = F.lit(0.0)
    for i, n in counts.items():
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        score = score - idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select("id", score.alias("score"))


def corpus_stats(source: Source, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row: n entities and their average length; read from the counts of an index, counted otherwise."""
    if isinstance(source, Index):
        return source.corpus.agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
    return tokenised(source, fields).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def adjusted_rank(hits: DataFrame, entities: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Hits with their entity, file and the score plus the file's age penalty."""
    meta = entities.select("id", "signature", "type", "filename", "line_start", "line_end").join(files.select("filename", "filetime"), "filename")
    return hits.join(meta, "id").withColumn("adjusted_rank", F.col("score") + age_penalty(F.col("filetime"), now))


def top_k(ranked: DataFrame, k: int = 20, by: str = "adjusted_rank") -> DataFrame:
    """The k best; the entity id breaks ties."""
    return ranked.orderBy(F.round(by, PLACES), "id").limit(k)


def inverse_frequency(n: float, df: float) -> float:
    found = math.log((n - df + 0.5) / (df + 0.5))
    return found if found > 0 else 1e-6


def top_terms(index: Index, tokens: list[str], k: int = 20, penalties: DataFrame | None = None) -> DataFrame:
    """id, score, adjusted_rank of the k best entities with any of the tokens: the order of rank_bm25() of their Or, with a penalty
    (id, penalty: not negative) added.

    Bounds first: the index knows how many entities a token has on each level and what an occurrence list adds at most and at
    least there. The best levels with at least k entities give a score that the k best reach; a level of a token on
    which no entity can reach it, even with the most that all other tokens add, is not read. An entity among the k best has
    all its tokens on levels that are read, so its score is exact.
    """
    if index.project is not None:
        raise ValueError("term statistics are those of the whole index")
    tokens = sorted(set(tokens))
    n, avgdl = corpus_stats(index).first()
    stats = {t: {} for t in tokens}
    for r in index.terms(tokens).groupBy("token", "level", "avgdl").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).collect():  # tokens x levels x segments
        count, most, least = stats[r["token"]].get(r["level"], (0, 0.0, math.inf))
        ratio = avgdl / r["avgdl"]
        stats[r["token"]][r["level"]] = (count + r["n"], max(most, r["most"] * max(1, ratio)), min(least, r["least"] * min(1, ratio)))
    weight = {t: inverse_frequency(n, sum(c for c, _, _ in x.values())) for t, x in stats.items()}
    most = {t: weight[t] * max((m for c, m, _ in x.values() if c > 0), default=0) for t, x in stats.items()}

    def scored(levels: dict[str, list[int]]) -> DataFrame:
        wanted = _any([(F.col("token") == t) & F.col("level").isin(x) for t, x in levels.items() if x])
        part = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        idf = F.coalesce(*[F.when(F.col("token") == t, F.lit(weight[t])) for t in tokens])
        rows = index.rows(wanted & F.col("is_first"), index.places([(t, False) for t in tokens])).groupBy("id").agg((-F.sum(idf * part)).alias("score"))
        return rows.withColumn("adjusted_rank", F.col("score")) if penalties is None else rows.join(penalties.select("id", "penalty"), "id").withColumn("adjusted_rank", F.col("score") + F.col("penalty"))

    first: dict[str, list[int]] = {}
    for t, x in stats.items():
        have = 0
        for level in sorted(x, reverse=True):
            if have < k:
                first.setdefault(t, []).append(level)
                have += x[level][0]
    kth = [r[0] for r in scored(first).orderBy("adjusted_rank").limit(k).select("adjusted_rank").collect()] if any(first.values()) else []
    reach = -kth[-1] - MARGIN if len(kth) == k else -math.inf
    others = sum(most.values())
    chosen = {t: [level for level, (_, m, _) in x.items() if weight[t] * m + others - most[t] >= reach] for t, x in stats.items()}
    return top_k(scored(chosen), k)


def under(entities: DataFrame, directory: str) -> DataFrame:
    return entities.where(F.col("filename").startswith(directory + "/"))


def format_hits(hits: DataFrame) -> DataFrame:
    """Adds `path:start-end` and the snippet where it says more than the signature."""
    place = F.concat(F.col("filename"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end"))
    return hits.withColumn("place", place).withColumn("shown", F.when(F.length("snippet") > F.length("signature"), F.col("snippet")))


def search_many(source: Source, queries: DataFrame, k: int = 10, fields: tuple[str, ...] = FIELDS, percent: int = 100) -> DataFrame:
    """The k best entities of each query (query_id, tokens: at least `percent` of them must occur), scored in one job.

    Postings of the queries' tokens are dealt out by entity once; there they meet the queries, whose terms (with their
    document frequencies, from counts that need no shuffle of postings) are broadcast up to MAX_TERMS.
    """
    terms = queries.select("query_id", F.size("tokens").alias("wanted"), F.posexplode("tokens").alias("nth", "token"))
    asked = terms.select("token").distinct()
    if isinstance(source, Index):
        found = source.of_tokens(asked)
        df = found.groupBy("token").agg(F.count_if("is_first").alias("df"))
        rows = found.select("id", "token", "dl", F.col("tf").alias("f"))
    else:
        of = lambda tokens: tokenised(source, fields).select("id", F.size("tokens").cast("long").alias("dl"), F.explode(tokens).alias("token")).join(asked, "token", "left_semi")
        each = F.expr("transform(tokens, x -> x.token)")
        df = of(F.array_distinct(each)).groupBy("token").agg(F.count("*").alias("df"))
        rows = of(each).select("id", "token", "dl", F.lit(1).cast("long").alias("f"))
    tf = rows.repartition("id").groupBy("id", "token").agg(F.sum("f").alias("f"), F.first("dl").alias("dl"))
    weights = checkpointed(terms.join(df, "token").select("query_id", "wanted", "token", "df"))
    scored = tf.join(F.broadcast(weights) if weights.count() <= MAX_TERMS else weights, "token").join(F.broadcast(corpus_stats(source, fields)))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = scored.groupBy("query_id", "id", "wanted").agg(F.count("*").alias("have"), (-F.sum(part)).alias("score")).where(F.col("have") * 100 >= F.col("wanted") * percent)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6), "id")
    return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("query_id", "nth", "id", "score")


def visible(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits whose file no ignore rule hides now; to be used before top_k, so that k visible ones are found."""
    names = hits.select("filename").distinct()
    return hits.join(apply_ignore_rules(names, rules), "filename", "left_semi")
