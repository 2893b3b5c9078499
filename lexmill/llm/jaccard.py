"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct word shingles. Equal sets are one class from the start. The join then:

1. cuts each set by token hash into blocks, more of them than tokens in which similar sets can differ; so similar
   sets agree in many whole blocks;
2. lets sets that look alike meet in small groups around hubs and verifies links there, which joins most components
   and is linear in the sets, however large a group of near copies is;
3. partitions the sets of what is still in two components into groups around hubs. The matrix of block signatures
   and groups says how many of a query's blocks occur in the union of a group; that bounds its similarity with
   every member;
4. opens only the groups that reach the count a similar set must give (of a pair, the smaller component asks):
   exact overlaps are counted with a sorted token matrix of runs of GROUP sets, again behind a bound by the union of
   each run's tokens;
5. keeps a link only where it joins two components so far (copies are never expanded into all pairs), and joins
   the links of all tasks to components.

Defined cases: without words or with a null text a set is empty and links with nothing; a text of fewer words
than a shingle is one shingle; rows with a null doc_id have a null component and link nothing; rows with words and
one doc_id are one node: whatever one of them links with, all are joined with (a row without words stays alone under
its own doc_id); a repeated row has the row's result; a text of any length is read whole, alone if it is longer than a
chunk; an empty table gives an empty result; other columns are ignored.

Equal sets are found by two hashes from the two halves of the words' hashes; overlaps count shingles by the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import words as w
from lexmill.llm.components import components
from lexmill.llm.tables import checkpointed, frequent, join_counted, n_rows, per_batch, salted, typed

SHINGLE = 5
PERCENT = 80
GROUP = 16
#: Sets that a group has about, and tokens: whatever is reached first.
GROUP_SETS = 512
GROUP_TOKENS = 1 << 20
#: Guests that one part of an asked group has about, within the same bound of tokens.
GUESTS = 512
#: Blocks beyond those that the pigeonhole needs, so that so many may be empty: 2 and an eighth of these.
SPARE = 2
#: Orders in which signatures name hubs.
HUBS = 2
#: Classes of which only one copy signs, and the share of the documents that shows which signatures are frequent.
MAX_COPIED = 4096
SAMPLE_SHARE = 1 / 128
#: Visits (a few numbers each) that are sent to every task at most; more are joined by a shuffle of the texts.
MAX_SHARED = 1_000_000

_U = np.uint64


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, their n+1 offsets and second hashes."""
    words = w.find_words(texts, fold=w.LOWER_AZ)
    counts, doc = words.counts, words.doc
    at, value = w.windows(words, shingle)
    second = w.runs_at(words, at, shingle, True)
    owner = doc[at]
    for size in range(1, shingle):
        if (counts == size).any():
            at = words.first[:-1][counts == size]
            owner, value, second = np.concatenate([owner, doc[at]]), np.concatenate([value, w.runs_at(words, at, size)]), np.concatenate([second, w.runs_at(words, at, size, True)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(texts) + 1)), second[order[new]]


def _sums(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(value, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def set_keys(value: np.ndarray, offsets: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, from the first and the second hashes of its shingles."""
    with np.errstate(over="ignore"):
        return tuple(w.mix(_sums(w.mix(x + _U(salt)), offsets) + _U(salt)) for x, salt in ((value, 0x2545F4914F6CDD1D), (second, 0x9E6C63D0876A9A47)))


def bands(largest: int) -> np.ndarray:
    """Lower bounds of the size bands, up to one beyond `largest`."""
    out = [1]
    while out[-1] <= largest * 2:
        out.append(max(out[-1] + 1, (3 * out[-1] + 1) // 2))
    return np.array(out, np.int64)


def block_signatures(value: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the blocks of each set: (set number, signature), and by set and band parity how many of them
    a similar set must share. The lowest bit of a signature is the parity of its band.

    Sets of sizes a and b with similarity p/100 differ in at most (a + b)(100 - p)/(100 + p) tokens. Both are in
    one band, or the smaller one also signs for the next band if a similar set may lie there.
    """
    n = np.diff(offsets)
    lower = bands(int(n.max(initial=1)))
    band = np.searchsorted(lower, n, side="right") - 1
    out, needs = [], np.ones((len(n), 2), np.int32)
    parity = lambda signature, band: (signature & ~_U(1)) | band.astype(_U) & _U(1)
    for step in (0, 1):
        chosen = n > 0 if step == 0 else (n > 0) & (100 * n // percent >= lower[np.minimum(band + 1, len(lower) - 1)])
        sets = np.flatnonzero(chosen)
        if not len(sets):
            continue
        own = band[sets] + step
        needed = 2 * (lower[own + 1] - 1) * (100 - percent) // (100 + percent) + 1
        spare = SPARE + needed // 8
        blocks = needed + spare
        lengths = n[sets]
        ends = np.cumsum(lengths)
        index = np.repeat(offsets[sets], lengths) + np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        tokens, which = value[index], np.repeat(np.arange(len(sets)), lengths)
        with np.errstate(over="ignore"):
            block = ((tokens >> _U(32)) * blocks[which].astype(_U)) >> _U(32)
            new = np.ones(len(tokens), bool)
            new[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            total = _sums(w.mix(tokens ^ _U(0x6A09E667F3BCC909)), np.append(first, len(tokens)))
            place = w.mix(own[which[first]].astype(_U) * _U(1 << 40) + block[first])
            out.append((sets[which[first]], parity(w.mix(total + place), own[which[first]])))
            # A set with more empty blocks than the spare ones signs these too.
            filled = np.bincount(which[first], minlength=len(sets))
            partner = np.minimum(lower[own + 1] - 1, 100 * lengths // percent)
            needs[sets, own & 1] = np.maximum(1, filled - (lengths + partner) * (100 - percent) // (100 + percent))
            for s in np.flatnonzero(blocks - filled > spare):
                mine = block[first[which[first] == s]].astype(np.int64)
                empty = np.setdiff1d(np.arange(blocks[s]), mine)
                out.append((np.full(len(empty), sets[s]), parity(w.mix(w.mix(_U(int(own[s]) << 40) + empty.astype(_U)) ^ _U(0xBB67AE8584CAA73B)), np.full(len(empty), own[s]))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), needs
    return (*(np.concatenate(x) for x in zip(*out, strict=True)), needs)


def signed_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key, check (of the set), the shared blocks that a similar set needs (by band parity) and block
    signatures."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            value, offsets, second = shingle_sets(batch.column("text").slice(a, b - a), shingle)
            key, check = set_keys(value, offsets, second)
            owner, signature, needs = block_signatures(value, offsets, percent)
            order = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(b - a + 1)), pa.int32()), pa.array(signature[order].view(np.int64)))
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "n_shingles": np.diff(offsets), "key": key.view(np.int64), "check": check.view(np.int64), "need0": needs[:, 0], "need1": needs[:, 1], "signatures": lists}

    return per_batch(docs, make, "doc_id long, n_shingles long, key long, check long, need0 int, need1 int, signatures array<long>")


def _expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    reps = last - first
    return np.repeat(first - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())


class TokenGroups:
    """The token-group matrix over sets, and exact overlaps in the groups that are opened."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        by_size = np.argsort(self.sizes, kind="stable")
        self.group = np.empty(len(sets), np.int64)
        self.group[by_size] = np.arange(len(sets)) // GROUP
        self.n_groups = int(self.group.max(initial=-1)) + 1
        self.least = np.array([self.sizes[self.group == g].min() for g in range(self.n_groups)], np.int64)
        tokens, member = np.concatenate([*sets, np.zeros(0, _U)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((self.group[member], tokens))
        self.tokens, self.member = tokens[order], member[order]
        of = self.group[self.member]
        new = np.ones(len(order), bool)
        new[1:] = (self.tokens[1:] != self.tokens[:-1]) | (of[1:] != of[:-1])
        self.union_tokens, self.union_groups = self.tokens[new], of[new]

    def similar(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets whose similarity with `query` is at least percent/100."""
        rows = _expand(np.searchsorted(self.union_tokens, query), np.searchsorted(self.union_tokens, query, side="right"))
        bound = np.bincount(self.union_groups[rows], minlength=self.n_groups)
        # |q & s| >= p |q or s| / 100, and |q or s| is at least either size.
        opened = 100 * bound >= percent * np.maximum(len(query), self.least)
        if not opened.any():
            return np.zeros(0, np.int64)
        rows = _expand(np.searchsorted(self.tokens, query), np.searchsorted(self.tokens, query, side="right"))
        member = self.member[rows]
        common = np.bincount(member[opened[self.group[member]]], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (len(query) + self.sizes - common))


class _Joined:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def links_between(sets: list[np.ndarray], is_member: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of all sets with the members among them, as far as they join components: (set, first set of its component)."""
    joined, members = _Joined(len(sets)), np.flatnonzero(is_member)
    matrix = TokenGroups([sets[i] for i in members])
    for q, query in enumerate(sets):
        for s in members[matrix.similar(query, percent)]:
            joined.join(q, int(s))
    return [(i, joined.find(i)) for i in range(len(sets)) if joined.find(i) != i]


def _find_links(sets: DataFrame, percent: int) -> DataFrame:
    """sets: group, member, doc_id, tokens -> links (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, member = table.column("doc_id").to_numpy(), table.column("member").to_numpy()
        lists = table.column("tokens").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat, offsets = lists.flatten().to_numpy().view(_U), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        pairs = links_between([flat[offsets[i] : offsets[i + 1]] for i in range(len(ids))], member, percent) if member.any() else []
        a, b = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return sets.groupBy("group").applyInArrow(run, "a long, b long")


def supported(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of sets with as many shared blocks, whoever shares them, as a similar set must share."""
    odd = F.col("signature").bitwiseAND(F.lit(1)).alias("odd")
    counts = shared.groupBy("key", odd).agg(F.count("*").alias("n")).join(classes.select("key", "need0", "need1"), "key")
    enough = counts.where("n >= IF(odd = 0, need0, need1)").select("key", "odd").distinct()
    return shared.withColumn("odd", odd).join(enough, ["key", "odd"], "left_semi").select("signature", "key")


def hubs(shared: DataFrame, orders: range) -> DataFrame:
    """(key, order, hub): each signature names the set that is first in an order; most of a set's signatures name its hub."""
    first = shared.groupBy("signature").agg(*[F.min_by("key", F.xxhash64(F.lit(i), "key")).alias(f"hub{i}") for i in orders])
    named = shared.join(first, "signature").select("key", F.posexplode(F.array(*[f"hub{i}" for i in orders])).alias("order", "hub"))
    votes = named.groupBy("key", "order", "hub").agg(F.count("*").alias("n"))
    return votes.groupBy("key", "order").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))


def _parts(sets: int) -> Column:
    """In how many parts the grouped sets go, so that each has about so many sets or GROUP_TOKENS tokens."""
    return F.ceil(F.greatest(F.count("*") / F.lit(sets), F.sum("n_shingles") / F.lit(GROUP_TOKENS))).cast("long").alias("parts")


def meetings(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, group): small groups in which sets that look alike meet at first; no promise that all similar sets do.

    A set meets its hub of each of HUBS orders. A hub with many guests, or long ones, meets them in several groups.
    """
    chosen = hubs(shared, range(HUBS)).where("key <> hub").select("key", "hub").distinct().join(classes.select("key", "n_shingles"), "key")
    sizes = chosen.groupBy("hub").agg(_parts(GROUP_SETS))
    group = F.xxhash64("hub", "part").alias("group")
    guests = chosen.join(sizes, "hub").withColumn("part", F.pmod(F.xxhash64("hub", "key"), F.col("parts"))).select("key", group)
    hosts = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.col("hub").alias("key"), group)
    return guests.unionByName(hosts).distinct()


def grouped(live: DataFrame) -> DataFrame:
    """(key, group): sets with one hub are a group, split by key where it is large."""
    chosen = hubs(live, range(HUBS, HUBS + 1)).select("key", "hub").join(live.select("key", "n_shingles").distinct(), "key")
    sizes = chosen.groupBy("hub").agg(_parts(GROUP_SETS))
    return chosen.join(sizes, "hub").select("key", F.xxhash64("hub", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("group"))


def ranks(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, n_shingles, need0, need1, rank): a rank orders the components of `links`, larger ones are higher."""
    found = components(links)
    rooted = classes.drop("n", "check").join(found.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    rooted = checkpointed(rooted.select("key", "n_shingles", "need0", "need1", F.coalesce("root", "doc_id").alias("root")))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    return join_counted(rooted, sizes, ["root"]).select("key", "n_shingles", "need0", "need1", F.struct("n", "root").alias("rank"))


def undecided(shared: DataFrame, ranked: DataFrame) -> DataFrame:
    """The (signature, key, n_shingles, need0, need1, rank) rows of signatures that sets of several ranks share."""
    tagged = shared.join(ranked, "key")
    spread = tagged.groupBy("signature").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("signature")
    return tagged.join(spread, "signature", "left_semi")


def opened_groups(live: DataFrame) -> DataFrame:
    """(key, group): groups whose union has as many of the set's blocks as a similar set must have.

    live: rows of undecided() with groups. A set counts the blocks that sets of a higher component have in the group: of a similar
    pair in two components, the lower one thus asks the group of the other.
    """
    unions = live.groupBy("signature", F.col("group").alias("asked")).agg(F.max("rank").alias("top"))
    count = live.join(unions, "signature").where("top > rank").groupBy("key", "asked", F.col("signature").bitwiseAND(F.lit(1)).alias("odd"))
    enough = count.agg(F.count("*").alias("n"), F.first("need0").alias("need0"), F.first("need1").alias("need1")).where("n >= IF(odd = 0, need0, need1)")
    return enough.select("key", F.col("asked").alias("group")).distinct()


def visits(asking: DataFrame, live: DataFrame) -> DataFrame:
    """(key, group, member): the members of the groups that are asked, and their guests in parts."""
    homes = live.select("key", F.col("group").alias("home"), "n_shingles").distinct()
    asking = asking.join(homes, "key")
    sizes = asking.groupBy("group").agg(_parts(GUESTS))
    group = F.xxhash64("group", "part").alias("group")
    members = homes.join(sizes, F.col("home") == F.col("group")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("key", group, F.lit(True).alias("member"))
    guests = asking.where("group <> home").join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).select("key", group, F.lit(False).alias("member"))
    return members.unionByName(guests)


def each_set(docs: DataFrame, wanted: DataFrame, shingle: int, small: bool, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """What `make` gives for the rows (doc_id, key, check and others) of `wanted` and the sets of their texts; `small`: rows fit a broadcast."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            value, offsets, second = shingle_sets(batch.column("text").slice(a, b - a), shingle)
            key, check = set_keys(value, offsets, second)
            rows = batch.slice(a, b - a)
            # Other texts of one doc_id are not meant.
            same = pa.array((rows.column("key").to_numpy() == key.view(np.int64)) & (rows.column("check").to_numpy() == check.view(np.int64)))
            yield {c: x.filter(same) for c, x in make(rows, value, offsets).items()}

    texts = docs.join(wanted.hint("broadcast" if small else "shuffle_hash"), "doc_id").select(*wanted.columns, "text")
    return per_batch(texts, run, schema)


def _token_sets(docs: DataFrame, meets: DataFrame, shingle: int, small: bool) -> DataFrame:
    """group, member, doc_id, tokens: the sets of `meets` (doc_id, key, check, meets) in each of their groups."""

    def tokens(rows: pa.RecordBatch, value: np.ndarray, offsets: np.ndarray) -> dict:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))
        return {"doc_id": rows.column("doc_id"), "meets": rows.column("meets"), "tokens": lists}

    sets = each_set(docs, meets, shingle, small, tokens, "doc_id long, meets array<struct<group:bigint,member:boolean>>, tokens array<long>")
    return sets.select("doc_id", F.explode("meets").alias("meet"), "tokens").select("doc_id", "meet.group", "meet.member", "tokens")


def _meet(docs: DataFrame, classes: DataFrame, places: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) found where the sets meet. places: key, group, member; kept already."""
    named = places.join(classes.select("key", "check", "doc_id"), "key")
    meets = named.groupBy("doc_id", "key", "check").agg(F.collect_list(F.struct("group", "member")).alias("meets"))
    return _find_links(_token_sets(docs, meets, shingle, n_rows(places) <= MAX_SHARED), percent)


def jaccard(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = typed(docs, doc_id="bigint", text="string")
    # The signatures are made again where they are dealt out: kept, they would take as much disk as the texts.
    full = signed_sets(docs, shingle, percent)
    signed = checkpointed(full.drop("signatures"))
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    values = {"doc_id": F.min("doc_id"), "n": F.count("*")} | {c: F.first(c) for c in ("n_shingles", "need0", "need1")}
    classes = checkpointed(known.groupBy("key", "check").agg(*[v.alias(c) for c, v in values.items()]))
    # Of the classes with most copies (a fixed number) only the smallest doc_id signs.
    copied = classes.orderBy(F.desc("n")).limit(MAX_COPIED).select("key", "check", F.col("doc_id").alias("first"))
    fresh = full.where("doc_id IS NOT NULL AND n_shingles > 0").join(F.broadcast(copied), ["key", "check"], "left").where("first IS NULL OR doc_id = first")

    often = frequent(signed_sets(docs.where("doc_id IS NOT NULL").sample(SAMPLE_SHARE, 7), shingle, percent).select(F.explode("signatures").alias("signature"), "key").distinct(), "signature")  # of several sets each: shared
    near = Window.partitionBy("signature", "salt").orderBy("key")
    alike = salted(fresh.select(F.explode("signatures").alias("signature"), "key"), often, "signature", "key").select("signature", "key", "frequent", F.lag("key").over(near).alias("before"), F.lead("key").over(near).alias("after"))
    shared = checkpointed(supported(checkpointed(alike.where("frequent OR before < key OR after > key").select("signature", "key").distinct()), classes))

    return linked(docs, signed, classes, shared, shingle, percent)


def linked(docs: DataFrame, signed: DataFrame, classes: DataFrame, shared: DataFrame, shingle: int, percent: int, sharper: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, from candidates that are all verified on full sets.

    signed: doc_id, n_shingles, key, check of each row. classes: key, check, doc_id (the smallest), n (rows), n_shingles, need0, need1
    of each set. shared: signature, key; of two similar sets in one signature's rows neither may be missing, and they share as
    many signatures as both need (by the lowest bit of the signature). sharper: makes other rows that keep this promise for some of the
    classes, with fewer signatures in common to sets that are not similar; what is undecided after the hubs asks by these.
    """
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = checkpointed(meetings(shared, classes).withColumn("member", F.lit(True)))
    links = checkpointed(_meet(docs, classes, first, shingle, percent))
    ranked = checkpointed(ranks(classes, links))
    live = checkpointed(undecided(shared, ranked))
    homes = checkpointed(grouped(live))
    if sharper is not None:
        live = checkpointed(undecided(sharper(classes.join(homes, "key", "left_semi")), ranked))
    live = checkpointed(live.join(homes, "key"))
    places = checkpointed(visits(checkpointed(opened_groups(live)), live))
    if not places.isEmpty():
        links = links.unionByName(_meet(docs, classes, places, shingle, percent))
    named = classes.select("key", "check", F.col("doc_id").alias("first"), "n")
    rows = checkpointed(join_counted(known, named, ["key", "check"]).select("doc_id", "n_shingles", "first"))
    # Different sets of one doc_id are joined through it.
    several = rows.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
    if not several.isEmpty():
        links = links.unionByName(rows.join(several, "doc_id").select("a", F.col("first").alias("b")).distinct())
    links = components(links).select(F.col("node").alias("first"), "root")
    rows = rows.join(links, "first", "left").select("doc_id", "n_shingles", F.coalesce("root", "first").alias("component_id"))
    return rows.unionByName(signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
