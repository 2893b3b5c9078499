"""Near duplicates by MinHash with tensored banding, every link confirmed on full sets.

Plain banding needs as many minhashes as tables have rows in all. Here two small collections of HALVES half keys each
(ROWS minhashes a half key) are made, and a table key is a pair, one half of each collection: HALVES ** 2 tables of 2 * ROWS
minhashes from 2 * HALVES * ROWS of them. With similarity s two sets meet in a table unless they share no half of one
collection, so they miss each other with a chance of about 2 * (1 - s ** ROWS) ** HALVES: 0.00001 at 0.8, 10 ** -9 at 0.9.

1. One pass over the texts gives each its set's keys and half keys (a few numbers); equal sets are one class from there on.
2. Half keys that only one class has are dropped before pairs are formed, which loses no table that two classes share, so
   texts that resemble nothing form no pairs at all. Pairs that only one class has go next.
3. Classes that share table keys are compared on their full sets by the group stages of jaccard.py: around hubs first, then
   what is still apart, group by group. A group of copies is never expanded into all its pairs.
4. What is still apart after the hubs is mostly just not similar, and such sets share many tables of few minhashes. These sets alone
   get plain tables of many minhashes from their texts: they keep similar pairs but for MISSED of them, and share with others hardly any.

Defined cases: without words or with a null text a set is empty and links with nothing; a text of fewer words than a shingle is one
shingle; a row with a null doc_id has a null component, links nothing and is kept; rows with words and one doc_id are one node;
a repeated row has the row's result; a text of any length is read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import jaccard
from lexmill.llm import words as w
from lexmill.llm.tables import checkpointed, n_rows, per_batch, typed

SHINGLE = 5
PERCENT = 80
#: Half keys of each of the two collections, and minhashes of a half key.
HALVES = 12
ROWS = 2

#: Chance that a table of the second kind joins sets of just the wanted similarity (at most), and that all these tables miss them.
SHARP = 0.1
MISSED = 1e-7

_U = np.uint64


def _seeds(n: int) -> np.ndarray:
    return w.mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def band_keys(value: np.ndarray, offsets: np.ndarray, bands: int, rows: int, skip: int = 0) -> np.ndarray:
    """Keys of `rows` minhashes each of each set, `bands` of them (all 0 for an empty one). The first `skip` minhashes are left out."""
    out, some = np.zeros((len(offsets) - 1, bands), _U), np.diff(offsets) > 0
    if not some.any():
        return out
    first, seeds = offsets[:-1][some], _seeds(2 * (skip + bands * rows)).reshape(-1, 2)[skip:]
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(int(some.sum()), band, _U)
            for one, two in seeds[band * rows : (band + 1) * rows]:
                x = (value ^ one) * (two | _U(1))
                x ^= x >> _U(32)
                x *= one | _U(1)
                key = w.mix(key + np.minimum.reduceat(x, first))
            out[some, band] = key
    return out


def half_keys(value: np.ndarray, offsets: np.ndarray, halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """2 * halves keys of each set (all 0 for an empty one); the lowest bit says of which collection a key is."""
    keys = band_keys(value, offsets, 2 * halves, rows)
    return np.where(np.diff(offsets)[:, None] > 0, keys & ~_U(1) | np.arange(2 * halves, dtype=_U) & _U(1), _U(0))


def sharp_bands(percent: int) -> tuple[int, int]:
    """How many tables of how many minhashes miss sets of a similarity of percent/100 with a chance of MISSED at most."""
    if percent >= 100:
        return 1, 1
    rows = max(1, int(np.log(SHARP) / np.log(percent / 100)))
    return int(np.ceil(np.log(MISSED) / np.log1p(-((percent / 100) ** rows)))), rows


def sharp_keys(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(signature, key) of the classes (key, check, doc_id) in tables of many minhashes, as far as several of them share a table key."""
    bands, rows = sharp_bands(percent)

    def make(batch: pa.RecordBatch, value: np.ndarray, offsets: np.ndarray) -> dict:
        # Not the minhashes of the half keys: by these the sets were chosen.
        keys = band_keys(value, offsets, bands, rows, skip=1 << 12)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        return {"key": batch.column("key"), "signatures": lists}

    wanted = checkpointed(classes.select("doc_id", "key", "check"))
    keyed = jaccard.each_set(docs, wanted, shingle, n_rows(wanted) <= jaccard.MAX_SHARED, make, "key long, signatures array<long>")
    once = keyed.groupBy("key").agg(F.first("signatures").alias("signatures"))  # of repeated rows
    return _of_several(checkpointed(once.select(F.explode("signatures").alias("signature"), "key")), "signature")


def sketched(docs: DataFrame, shingle: int, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, key and check (of the set), halves."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            value, offsets, second = jaccard.shingle_sets(batch.column("text").slice(a, b - a), shingle)
            key, check = jaccard.set_keys(value, offsets, second)
            keys = half_keys(value, offsets, halves, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * (2 * halves), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "n_shingles": np.diff(offsets), "key": key.view(np.int64), "check": check.view(np.int64), "halves": lists}

    return per_batch(docs, make, "doc_id long, n_shingles long, key long, check long, halves array<long>")


def _of_several(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose value in `column` several keys have."""
    several = rows.groupBy(column).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select(column)
    return rows.join(several, column, "left_semi")


def table_keys(classes: DataFrame) -> DataFrame:
    """(signature, key): the table keys that several classes (key, halves) share; a table key is a pair of half keys."""
    halves = _of_several(classes.select("key", F.explode("halves").alias("half")), "half")
    mine = halves.groupBy("key").agg(F.collect_list("half").alias("halves"))  # HALVES of each collection at most
    pairs = F.expr("flatten(transform(filter(halves, x -> x & 1 = 0), a -> transform(filter(halves, x -> x & 1 = 1), b -> xxhash64(a, b))))")
    return _of_several(checkpointed(mine.select(F.explode(pairs).alias("signature"), "key")), "signature")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (that is the own doc_id)."""
    docs = typed(docs, doc_id="bigint", text="string")
    signed = checkpointed(sketched(docs, shingle, halves, rows))
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    one = F.lit(1).alias
    classes = checkpointed(known.groupBy("key", "check").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves")).select("*", one("need0"), one("need1")))
    shared = checkpointed(table_keys(classes))
    found = jaccard.linked(docs, signed.drop("halves"), classes.drop("halves"), shared, shingle, percent, lambda some: sharp_keys(docs, some, shingle, percent))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
