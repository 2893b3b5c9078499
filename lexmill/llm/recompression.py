"""Substring dedup by recompression.

Rounds shrink each text's word sequence: the first names maximal runs of one word, each later one names pairs.
A symbol's name is a hash of what it stands for, so a run or pair has one name in all texts without a naming
table or a shuffle a round. Each round puts every symbol to the left or right half by a bit of its name and
joins a left symbol with a right one behind it. A symbol thus depends on its own words and a few beside it:
its footprint. Equal substrings have equal symbols wherever the footprint lies inside.

Each window of WINDOW words is filed under one symbol: the leftmost with its footprint inside, of the highest
round that has one (or under the window's own name where no symbol of MIN_WEIGHT words is settled, as in long
runs). That choice depends on the window's words alone, so equal windows are filed alike, and far fewer
symbols than windows have to meet:

1. symbols: (symbol, doc_id), each once a text; a symbol of one document alone hides no repeat;
2. reveal: shared symbols go back to their documents, and only the windows filed under them are hashed, in
   one row for all equal occurrences in a document;
3. verify: equal windows meet, by their symbol (named from the second halves of the words' hashes, words.py) and
   by the hash of all their words (from the first halves); all but those in the smallest doc_id count;
4. remove: the covered words leave the texts.

Symbols that a sample shows to be very frequent are dealt out by symbol and a salt of the doc_id: a window that
is not the smallest of its salt is repeated for certain, and only the smallest ones of each salt meet again. The
sample decides how rows are dealt, never what is found.

Texts that are copies of a whole text of a smaller doc_id need no windows: all their windows are repeats. The
text itself is dealt out by doc_id once; steps 2 and 4 read the same exchange.

Defined cases: a null or empty text has no words; texts of fewer than WINDOW words lose nothing; rows with equal
doc_id never remove each other's words; rows with a null doc_id keep all words and count as no one's original;
repeated rows each get their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import words as w
from lexmill.llm.tables import checkpointed, frequent, join_counted, per_batch, salted, typed

WINDOW = 13
PAIR_ROUNDS = 3
MIN_WEIGHT = 3
#: Share of the documents that shows which symbols are frequent, and the parts into which those are dealt.
SAMPLE_SHARE = 1 / 32
SALTS = 16

_U = np.uint64
_FAR = 1 << 60


def _rounds(words: w.Words, pair_rounds: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Symbols of each round: name, first and past-the-last word, footprint (low, high)."""
    hash_ = words.hash2
    n = len(hash_)
    doc = words.doc
    fresh = np.ones(n, bool)
    fresh[1:] = (hash_[1:] != hash_[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], n)
    doc = doc[start]
    low, high = start - 1, end + 1
    first, last = words.first[:-1][doc], words.first[1:][doc]
    low[start == first] = -_FAR
    high[end == last] = _FAR
    with np.errstate(over="ignore"):
        name = np.where(end - start == 1, hash_[start], w.mix(hash_[start] + (end - start).astype(_U) * _U(0xA24BAED4963EE407)))
        yield name, start, end, low, high
        for r in range(1, pair_rounds + 1):
            right = (w.mix(name + _U(r * 0x9FB21C651E98DF25 % (1 << 64))) >> _U(63)).astype(bool)
            near = doc[:-1] == doc[1:]
            joins = np.zeros(len(name), bool)
            joins[:-1] = ~right[:-1] & right[1:] & near
            joined = np.zeros(len(name), bool)
            joined[1:] = joins[:-1]
            after = np.full(len(name), _FAR)
            after[:-1] = np.where(near, high[1:], _FAR)
            before = np.full(len(name), -_FAR)
            before[1:] = np.where(near, low[:-1], -_FAR)
            low = np.where(right & ~joined, before, low)
            high = np.where(right, high, after)  # of a left symbol that joins: the right one's
            at = np.flatnonzero(joins)
            high[at] = high[at + 1]
            name = name.copy()
            name[at] = w.mix(name[at] * _U(0xC2B2AE3D27D4EB4F) + w.mix(name[at + 1] + _U(r)) * _U(0x165667B19E3779F9))
            end = end.copy()
            end[at] = end[at + 1]
            keep = ~joined
            name, start, end, low, high, doc = (x[keep] for x in (name, start, end, low, high, doc))
            yield name, start, end, low, high


def filed(words: w.Words, window: int = WINDOW, pair_rounds: int = PAIR_ROUNDS, min_weight: int = MIN_WEIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and hashes of all windows, and the name each is filed under."""
    at, value = w.windows(words, window)
    symbol = np.zeros(len(at), _U)
    if not len(at):
        return at, value, symbol
    open_ = np.arange(len(at))
    for name, start, end, low, high in reversed(list(_rounds(words, pair_rounds))):
        settled = (low > -_FAR) & (high < _FAR) & (end - start >= min_weight)
        name, low, high = name[settled], low[settled], high[settled]
        if not len(name):
            continue
        index = np.searchsorted(low, at[open_])
        fits = index < len(low)
        fits[fits] = high[index[fits]] <= at[open_[fits]] + window
        symbol[open_[fits]] = name[index[fits]]
        open_ = open_[~fits]
    symbol[open_] = w.mix(w.runs_at(words, at[open_], window, second=True) ^ _U(0x5BF0363553E0F2A1))
    return at, value, symbol


def symbols(docs: DataFrame) -> DataFrame:
    """(doc_id, symbol): the names under which a document's windows are filed, each once a row of `docs`."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            words = w.find_words(batch.column("text").slice(a, b - a))
            at, _, symbol = filed(words)
            doc = words.doc[at]
            order = np.lexsort((symbol, doc))
            doc, symbol = doc[order], symbol[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (symbol[1:] != symbol[:-1])
            ids = batch.column("doc_id").slice(a, b - a).to_numpy()
            yield {"doc_id": ids[doc[new]], "symbol": symbol[new].view(np.int64)}

    return per_batch(docs, make, "doc_id long, symbol long")


def shared_symbols(found: DataFrame, often: DataFrame) -> DataFrame:
    """The (doc_id, symbol) rows whose symbol occurs in another document too; one pass over rows sorted by symbol."""
    near = Window.partitionBy("symbol", "salt").orderBy("doc_id")
    found = salted(found, often, "symbol", "doc_id", SALTS).select("symbol", "doc_id", "frequent", F.lag("doc_id").over(near).alias("before"), F.lead("doc_id").over(near).alias("after"))
    return found.where("frequent OR before < doc_id OR after > doc_id").select("symbol", "doc_id")


def _filed_windows(docs: DataFrame) -> DataFrame:
    """Rows with their shared symbols -> one row for equal symbol occurrences in a text: their windows' hashes and places."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            words = w.find_words(batch.column("text").slice(a, b - a))
            at, value, symbol = filed(words)
            doc = words.doc[at]
            lists = batch.column("symbols").slice(a, b - a)
            owner = np.repeat(np.arange(b - a), lists.value_lengths().fill_null(0).to_numpy())
            with np.errstate(over="ignore"):
                wanted = np.sort(lists.flatten().to_numpy().view(_U) + w.mix(owner.astype(_U) + _U(1)))
                asked = symbol + w.mix(doc.astype(_U) + _U(1))
            if not len(wanted):
                continue
            place = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
            chosen = wanted[place] == asked
            at, value, symbol, doc = at[chosen], value[chosen], symbol[chosen], doc[chosen]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            # Runs of at most WINDOW windows: the first and the last one then span all their words, so runs of one
            # document with equal ends are equal, and go out once with all their places.
            run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            first = np.flatnonzero(run % WINDOW == 0)
            length = np.diff(np.append(first, len(at)))
            keys = (value[first + length - 1], value[first], length, symbol[first], doc[first])
            order = np.lexsort(keys)
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            group = np.flatnonzero(fresh)
            one, sizes = first[order[group]], length[order[group]]
            inner = np.repeat(one - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            yield {
                "symbol": symbol[one].view(np.int64),
                "doc_id": batch.column("doc_id").slice(a, b - a).to_numpy()[doc[one]],
                "version": batch.column("version").slice(a, b - a).to_numpy()[doc[one]],
                "starts": pa.ListArray.from_arrays(pa.array(np.append(group, len(order)), pa.int32()), pa.array((at - words.first[doc])[first[order]].astype(np.int32))),
                "hashes": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(value[inner].view(np.int64))),
            }

    return per_batch(docs, make, "symbol long, doc_id long, version long, starts array<int>, hashes array<long>")


def repeated_windows(occurrences: DataFrame, often: DataFrame) -> DataFrame:
    """(doc_id, version, starts, mask): windows that also start in a document of a smaller doc_id."""
    dealt = salted(occurrences, often, "symbol", "doc_id", SALTS).repartition("symbol", "salt")
    each = dealt.select("symbol", "salt", "frequent", "doc_id", "version", "starts", F.posexplode("hashes").alias("place", "hash"))
    least = lambda *keys: F.first("doc_id").over(Window.partitionBy(*keys, "hash").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    here = each.withColumn("least", least("symbol", "salt"))
    bit = F.expr("shiftleft(1, place)")
    run = ["symbol", "doc_id", "version", "starts"]
    open_ = F.when(F.col("frequent") & (F.col("least") == F.col("doc_id")), F.struct("place", "hash"))
    seen = here.where("frequent OR least < doc_id").groupBy("salt", *run).agg(F.coalesce(F.bit_or(F.when(F.col("least") < F.col("doc_id"), bit)), F.lit(0)).alias("mask"), F.collect_list(open_).alias("open"))
    # The smallest of each salt meet once more: at most SALTS documents a window. What is settled goes with them.
    part = lambda is_open, mask, at: F.struct(F.lit(is_open).alias("open"), mask.alias("mask"), at.alias("hash"))
    settled = F.filter(F.array(part(False, F.col("mask"), F.col("doc_id"))), lambda x: x["mask"] != 0)
    parts = seen.select(*run, F.inline(F.concat(settled, F.transform("open", lambda x: part(True, F.pow(F.lit(2), x["place"]).cast("int"), x["hash"])))))
    parts = parts.withColumn("least", F.first("doc_id").over(Window.partitionBy("symbol", "hash", "open").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return parts.where("NOT open OR least < doc_id").select("doc_id", "version", "starts", "mask")


def _without(docs: DataFrame, window: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            texts, cuts = batch.column("text").slice(a, b - a), batch.column("cuts").slice(a, b - a)
            versions = batch.column("version").slice(a, b - a).to_pylist()
            total, removed, kept = [], [], []
            for text, own, version in zip(texts.to_pylist(), cuts, versions, strict=True):
                words = (text or "").encode().split()
                marks = np.zeros(len(words), bool)
                if own.is_valid and len(words) >= window:
                    cut = own.values
                    lists, mine = cut.field("starts"), cut.field("version").to_numpy() == version
                    sizes = lists.value_lengths().to_numpy()
                    start, mask = lists.flatten().to_numpy(), np.repeat(cut.field("mask").to_numpy(), sizes)
                    mine = np.repeat(mine, sizes)
                    if (start[mine] < 0).any():
                        marks[:] = True
                    else:
                        row, bit = np.nonzero((mask[mine, None] >> np.arange(WINDOW)) & 1)
                        marks = w.covered(start[mine][row] + bit, window, len(words))
                total.append(len(words))
                removed.append(int(marks.sum()))
                kept.append(b" ".join(words if not marks.any() else [x for x, m in zip(words, marks, strict=True) if not m]).decode())
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "n_words": np.array(total, np.int64), "n_removed": np.array(removed, np.int64), "kept": pa.array(kept, pa.string())}

    return per_batch(docs.select("doc_id", "text", "version", "cuts"), make, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    docs = typed(docs, doc_id="bigint", text="string")
    cut = "array<struct<version:bigint,starts:array<int>,mask:int>>"
    unnamed = docs.where("doc_id IS NULL").withColumns({"version": F.lit(0).cast("long"), "cuts": F.lit(None).cast(cut)})
    named = docs.where("doc_id IS NOT NULL")

    marks = checkpointed(named.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), F.unhex(F.md5("text")).alias("check")))
    originals = marks.groupBy("version", "check").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    copies = checkpointed(join_counted(marks, originals, ["version", "check"]).where("original < doc_id").select("doc_id", "version").distinct())
    only_copies = copies.groupBy("doc_id").agg(F.count("*").alias("n")).join(marks.select("doc_id", "version").distinct().groupBy("doc_id").agg(F.count("*").alias("all")), "doc_id").where("n = all").select("doc_id")

    often = frequent(symbols(named.sample(SAMPLE_SHARE, 7)).distinct(), "symbol")  # of several documents each: shared
    shared = shared_symbols(symbols(named), often).join(only_copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("symbol").alias("symbols"))
    dealt = named.withColumn("version", F.xxhash64("text"))
    occurrences = _filed_windows(dealt.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "version", "symbols"))
    cuts = repeated_windows(occurrences, often).unionByName(copies.select("doc_id", "version", F.array(F.lit(-1)).alias("starts"), F.lit(0).alias("mask")))
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("version", "starts", "mask")).alias("cuts"))
    joined = dealt.join(cuts.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "version", "cuts")
    return _without(joined.unionByName(unnamed), WINDOW)
