"""Mix sources to target weights with a low-discrepancy source schedule.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating; they share all words, a source's
target stops at MAX_PASSES times its size and the excess is shared again by weight (water filling).

Schedule: there are S block slots, N(s) of them for source s. Slot i has the golden-ratio point
(i * g mod S) / S, with g the number next to S / golden ratio that has no factor in common with S. The points map through the
cumulative N(s) to a source, so every prefix of the schedule is close to the targets and all of it meets them
exactly. Slots are ranked per source; the source's r-th slot takes the r-th block of BLOCK_WORDS words of its
tape: its documents in hash order, over and over. The last block of a source is cut where its target ends.
The slots say when the words of a document come: pieces() is the mix itself, mix() sums it up for each document.

Ranks and running sums are made in two levels (source and bucket, then offsets of buckets; ranges, then offsets of
ranges), with more buckets for more rows, so no task gets a whole source or all sources. Targets take one small
aggregation for each time that sources reach their stop.

Defined cases: a null or empty text has size 0, takes 0 and has no slot; a null source is a source of its own; sources
without words have target 0; equal rows each have their own place on the tape; a text may be of any length (only its
size is kept); an empty table gives an empty result; other columns are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from math import gcd, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.tables import checkpointed, free_name, n_rows, running_sums

BLOCK_WORDS = 1024
MAX_PASSES = 3
#: Rows that a bucket of the two-level ranks and sums has about, and the bounds of their number.
BUCKET_ROWS = 4096
BUCKET_BITS = (8, 24)
CHUNK_SLOTS = 1 << 14


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bits(rows: int) -> int:
    return min(max(BUCKET_BITS[0], (rows // BUCKET_ROWS).bit_length()), BUCKET_BITS[1])


def sized_columns(seed: int) -> dict[str, Column]:
    text = F.col("text").cast("string")
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    columns = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "key": key, "size": word_count(text), "order": order}
    return {name: c.alias(name) for name, c in columns.items()}


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, key (of the source), size, and the place of each row in its source's hash order."""
    return docs.select(*sized_columns(seed).values())


def numbered(rows: DataFrame, bucket_bits: int) -> DataFrame:
    """Rows of sized() with their bucket and number in it; only equal texts of one doc_id may change places."""
    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 64 - bucket_bits))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size")))


def targets(sizes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """key, source, source_size -> weight, target. The table has one row a source."""
    ranked = running_sums(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source")], ["one"])
    named = checkpointed(ranked.select("key", "source", "source_size", (F.col("before_one") % 3 + 1).alias("weight"), (F.lit(float(max_passes)) * F.col("source_size")).alias("cap")))
    total = float(named.agg(F.sum("source_size")).first()[0] or 0)
    used, free = 0.0, None
    while True:
        stops = F.col("cap") <= 0 if free is None else F.col("cap") <= F.lit((total - used) / free if free else 0.0) * F.col("weight")
        row = named.agg(F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0))).first()
        if (row[0], row[1]) == (used, free):
            break
        used, free = row
    target = F.when(stops, F.col("cap")).otherwise(F.lit(total - used) * F.col("weight") / F.lit(float(free or 1)))
    return named.select("key", "source", "source_size", "weight", target.alias("target"))


def _step(slots: int) -> tuple[int, int]:
    """The golden-ratio step of a cycle of `slots`, and its inverse."""
    step = max(1, round(slots * 2 / (1 + sqrt(5))))
    while gcd(step, slots) != 1:
        step += 1
    return step, pow(step, -1, slots) if slots > 1 else 0


def _times_mod(a: Column, b: int, m: int) -> Column:
    """a * b mod m in 64-bit integers, for m below 2**40."""
    high, low = F.shiftright(a, 20), a.bitwiseAND(F.lit((1 << 20) - 1))
    return ((high * F.lit(b) % F.lit(m)) * F.lit(1 << 20) % F.lit(m) + low * F.lit(b) % F.lit(m)) % F.lit(m)


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, key, rank (the source's r-th slot), from the targets of the sources."""
    quota = goals.withColumn("words", F.round("target").cast("long")).where("words > 0").withColumn("n", F.ceil(F.col("words") / F.lit(block_words)).cast("long"))
    quota = checkpointed(running_sums(quota.select("key", "n"), [F.col("key")], ["n"]).withColumnRenamed("before_n", "from"))
    slots = quota.agg(F.sum("n")).first()[0] or 0
    if slots >= 1 << 40:
        raise ValueError("over 2**40 slots: raise block_words")
    _, back = _step(max(1, slots))
    parts = quota.select("key", "n", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK_SLOTS}"))).alias("part")).repartition("key", "part")
    own = F.sequence(F.col("from") + F.col("part") * CHUNK_SLOTS, F.col("from") + F.least(F.col("n"), (F.col("part") + 1) * CHUNK_SLOTS) - 1)
    rows = parts.select("key", F.explode(own).alias("place"))
    rows = rows.select("key", _times_mod(F.col("place"), back, max(1, slots)).alias("slot"))
    rows = rows.withColumn("bucket", F.expr(f"slot div {max(1, slots >> bits(slots))}"))
    before = rows.groupBy("key", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n")).drop("n")
    local = rows.withColumn("local", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("slot")))
    return local.join(before, ["key", "bucket"]).select("slot", "key", (F.col("before") + F.col("local") - 1).alias("rank"))


def _tape(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows of sized() with bucket, nth, the source's numbers and the place of their first word on the tape."""
    rows = numbered(rows, bits(n_rows(rows)))
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.withColumn("offset", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")).drop("words")
    inside = Window.partitionBy("key", "bucket").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(buckets, ["key", "bucket"])
    rows = rows.withColumn("start", F.col("start") + F.col("offset")).drop("source", "offset")
    return rows.join(goals.drop("weight"), "key").withColumn("words", F.round("target").cast("long"))


def _pieces(tape: DataFrame, goals: DataFrame, block_words: int, max_passes: int) -> DataFrame:
    # Each pass over the tape gives a document another run of words; a run crosses one block or several.
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), lambda p: F.col("start") + p * F.col("source_size"))
    runs = tape.where("size > 0").select("*", F.explode(F.filter(passes, lambda at: at < F.col("words"))).alias("at"))
    runs = runs.withColumn("to", F.least(F.col("at") + F.col("size"), F.col("words")))
    cut = runs.select("*", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(to - 1) div {block_words}"))).alias("rank"))
    first = F.greatest(F.col("at"), F.col("rank") * block_words)
    n = F.least(F.col("to"), (F.col("rank") + 1) * block_words) - first
    # Blocks of a source are spread over its ranks, so the join has no hot key.
    slots = schedule(goals, block_words).select("key", "rank", "slot").hint("merge")
    return cut.withColumns({"place": first - F.col("rank") * block_words, "from_word": first - F.col("at"), "n": n}).join(slots, ["key", "rank"])


def _goals(rows: DataFrame, max_passes: int) -> DataFrame:
    return checkpointed(targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), max_passes))


def pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, seed: int = 42) -> DataFrame:
    """The mix, ordered by (slot, place): slot, place (first word's in the block), doc_id, source, from_word, n words."""
    rows = checkpointed(sized(docs, seed))
    goals = _goals(rows, max_passes)
    return _pieces(_tape(rows, goals), goals, block_words, max_passes).select("slot", "place", "doc_id", "source", "from_word", "n")


def _shares(rows: DataFrame, block_words: int, max_passes: int) -> DataFrame:
    goals = _goals(rows, max_passes)
    tape = _tape(rows, goals)
    found = _pieces(tape, goals, block_words, max_passes).groupBy("key", "bucket", "nth").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    none = F.lit(0).cast("long")
    return tape.join(found, ["key", "bucket", "nth"], "left").withColumns({"taken": F.coalesce("taken", none), "n_slots": F.coalesce("n_slots", none)})


MIXED = ("size", "source_size", "target", "taken", "first_slot", "n_slots")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, seed: int = 42) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target (of its source), taken (words the mix takes), the first slot
    that takes some and the number of slots that do."""
    rows = checkpointed(sized(docs, seed))  # a few numbers a document: the texts are read once
    return _shares(rows, block_words, max_passes).select("doc_id", "source", *MIXED)


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, seed: int = 42) -> DataFrame:
    """All rows with all columns and those of mix(): `taken` words of the text, over and over from its first word, come
    in `n_slots` slots from `first_slot` on; rows of which the mix takes nothing are told by `taken` = 0. Columns of these names are replaced."""
    rows = checkpointed(sized(docs, seed))
    # Rows are found again by what tells their place; equal ones among them may change places.
    same = ("key", "order", "size", "is_null", "id")
    named = lambda row: {"is_null": row["doc_id"].isNull(), "id": F.coalesce(row["doc_id"], F.lit(0).cast("long"))} | {c: row[c] for c in same[:3]}
    keys = {c: free_name(docs, f"mix_{c}") for c in (*same, "row", "nth", "n", "shares")}
    copies = Window.partitionBy(*[keys[c] for c in same])
    shares = _shares(rows, block_words, max_passes)
    shares = shares.select(F.struct(*MIXED).alias(keys["shares"]), *[c.alias(keys[name]) for name, c in named(shares).items()], F.col("nth").alias(keys["nth"]))
    shares = shares.withColumns({keys["n"]: F.count("*").over(copies), keys["nth"]: F.row_number().over(copies.orderBy(keys["nth"]))})
    shares = checkpointed(shares)
    placed = docs.select(*docs.columns, F.struct(*sized_columns(seed).values()).alias(keys["row"]))
    placed = placed.withColumns({keys[name]: c for name, c in named(F.col(keys["row"])).items()})
    on = [keys[c] for c in same]
    once, more = shares.where(F.col(keys["n"]) == 1), shares.where(F.col(keys["n"]) > 1)
    final = [*[c for c in docs.columns if c.lower() not in MIXED], *[F.col(keys["shares"])[c].alias(c) for c in MIXED]]
    out = placed.join(once, on).select(*final)
    if not more.isEmpty():
        again = placed.join(more.select(*on).distinct(), on, "left_semi").withColumn(keys["nth"], F.row_number().over(copies.orderBy(keys["size"])))
        out = out.unionByName(again.join(more, [*on, keys["nth"]]).select(*final))
    return out
