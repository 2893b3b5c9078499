"""Benchmark decontamination by winnowing.

Of each run of consecutive words both sides keep the smallest hash of `GRAM`-word grams in every sliding window
of `WINDOW - GRAM + 1` grams. Any shared span of at least WINDOW words then shares a kept fingerprint. A joined
fingerprint is a hit that is extended to a whole item window and compared by two hashes, made of the two independent
halves of the words' hashes (words.py). Items shorter than WINDOW words are one window; those of their own length are
looked up directly, since winnowing guarantees only spans of WINDOW words.

The fingerprint side comes from the benchmark. It is counted first and sent to the tasks as sorted arrays while it
has at most MAX_SHARED rows (40 bytes each and the item names); a larger benchmark is joined by a shuffle on the
fingerprint.

Defined cases: null or empty texts have no words, no hits and are not contaminated; an item without words
matches nothing; the words of an item with a null item_id count as hit, but no item is named for them; several
items may hold the same window and all are named; rows with equal or null doc_id each get their own row; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import words as w
from lexmill.llm.tables import checkpointed, free_name, n_rows, per_batch

WINDOW = 13
GRAM = 5
#: Item windows (fingerprint, place, two hashes) that are sent to every task; beyond it the join shuffles.
MAX_SHARED = 2_000_000


def _words(texts: pa.Array) -> w.Words:
    return w.find_words(texts, w.ALNUM, w.LOWER_AZ)


def winnow(words: w.Words, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest (rightmost of equals) of a window of grams."""
    at, value = w.windows(words, gram)
    span = window - gram + 1
    if len(at) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(value, span)
    inside = at[span - 1 :] - at[: len(at) - span + 1] == span - 1
    doc = words.doc[at]
    inside &= doc[span - 1 :] == doc[: len(at) - span + 1]
    least = np.arange(len(views)) + span - 1 - np.argmin(views[:, ::-1], axis=1)
    kept = np.unique(least[inside])
    return at[kept], value[kept]


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per item, window and fingerprint in the window: key, place of the gram in the window, size, two hashes."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            words = _words(batch.column("text").slice(a, b - a))
            ids = np.array(batch.column("item_id").slice(a, b - a).to_pylist(), dtype=object)
            for size in sorted({min(int(n), window) for n in words.counts if n}):
                chosen = np.minimum(words.counts, window) == size
                at, one = w.windows(words, size)
                _, two = w.windows(words, size, second=True)
                own = chosen[words.doc[at]]
                at, one, two = at[own], one[own], two[own]
                if size == window:
                    kept, key = winnow(words, gram, window)
                    first, last = np.searchsorted(kept, at), np.searchsorted(kept, at + window - gram, side="right")
                    reps = last - first
                    index = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    at, one, two, place, keys = np.repeat(at, reps), np.repeat(one, reps), np.repeat(two, reps), kept[index] - np.repeat(at, reps), key[index]
                else:
                    place, keys = np.zeros(len(at), np.int64), one
                yield {
                    "item_id": pa.array(ids[words.doc[at]].tolist(), pa.string()),
                    "size": np.full(len(at), size, np.int32),
                    "key": keys.view(np.int64),
                    "place": place.astype(np.int32),
                    "one": one.view(np.int64),
                    "two": two.view(np.int64),
                }

    return per_batch(benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")), make, "item_id string, size int, key long, place int, one long, two long").distinct()


def _candidates(words: w.Words, sizes: list[int], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for size in sizes:
        yield (size, *(winnow(words, gram, window) if size == window else w.windows(words, size)))


class Matcher:
    """Item windows in sorted arrays, for use inside tasks."""

    def __init__(self, rows: pa.Table, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        ids = rows.column("item_id").combine_chunks().dictionary_encode()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.items = [*ids.dictionary.to_pylist(), None]
        item = ids.indices.fill_null(len(self.items) - 1).to_numpy().astype(np.int64)
        columns = {c: rows.column(c).to_numpy().astype(np.int64) for c in ("size", "key", "place", "one", "two")}
        self.by_size = {}
        for size in np.unique(columns["size"]).tolist():
            own = np.flatnonzero(columns["size"] == size)
            key = columns["key"][own].view(np.uint64)
            own = own[np.argsort(key, kind="stable")]
            self.by_size[size] = (columns["key"][own].view(np.uint64), *(columns[c][own] for c in ("place", "one", "two")), item[own])

    def hits(self, words: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, sizes and item numbers of all occurrences of item windows."""
        out = [(np.zeros(0, np.int64),) * 3]
        doc = words.doc
        for size, at, value in _candidates(words, list(self.by_size), self.window, self.gram):
            key, place, one, two, item = self.by_size[size]
            first, last = np.searchsorted(key, value), np.searchsorted(key, value, side="right")
            reps = last - first
            if not reps.any():
                continue
            row = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            gram_at = np.repeat(at, reps)
            start = gram_at - place[row]
            fits = (start >= 0) & (start + size <= len(doc))
            fits[fits] = (doc[start[fits]] == doc[gram_at[fits]]) & (doc[start[fits] + size - 1] == doc[gram_at[fits]])
            start, row = start[fits], row[fits]
            same = (w.runs_at(words, start, size).view(np.int64) == one[row]) & (w.runs_at(words, start, size, True).view(np.int64) == two[row])
            out.append((start[same], np.full(same.sum(), size), item[row[same]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _result(ids: pa.Array, words: w.Words, start: np.ndarray, size: np.ndarray, item: np.ndarray, items: list[str]) -> dict:
    marks = w.covered(start, size, len(words.hash))
    n_hit, n = w.per_text(marks, words.first), words.counts
    named: list[list[str]] = [[] for _ in n]
    for d, i in np.unique(np.stack([words.doc[start], item], 1), axis=0) if len(start) else ():
        if items[i] is not None:
            named[d].append(items[i])
    named = [sorted(x) for x in named]
    return {
        "doc_id": ids,
        "n_words": n,
        "n_hit": n_hit,
        "n_items": np.array([len(x) for x in named], np.int64),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]),
        "contaminated": (n_hit > 0) & (20 * n_hit >= n),
        "items": pa.array(named, pa.list_(pa.string())),
    }


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_shared: int = MAX_SHARED) -> DataFrame:
    """Per document: words, words inside occurrences of item windows, the items, and whether a twentieth is hit."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _judged(docs, benchmark, window, gram, max_shared, lambda part, *found: _result(part.column("doc_id"), *found), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_shared: int = MAX_SHARED) -> DataFrame:
    """The rows that are not contaminated, with all columns; each is judged by its own text."""

    def keep(part: pa.RecordBatch, *found) -> dict:
        part = part.filter(pa.array(~_result(part.column("doc_id"), *found)["contaminated"]))
        return dict(zip(part.schema.names, part.columns, strict=True))

    return _judged(docs, benchmark, window, gram, max_shared, keep, docs.schema)


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, max_shared: int, out: Callable[..., dict], schema) -> DataFrame:
    """`out` of each chunk of rows, its words and the hits in them."""
    rows = item_windows(benchmark, window, gram)
    rows = checkpointed(rows)
    if n_rows(rows) > max_shared:
        return _by_shuffle(docs, rows, window, gram, out, schema)
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(rows.toArrow(), window, gram))

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            words = _words(batch.column("text").slice(a, b - a))
            yield out(batch.slice(a, b - a), words, *matcher.value.hits(words), matcher.value.items)

    return per_batch(docs, scan, schema)


def _by_shuffle(docs: DataFrame, rows: DataFrame, window: int, gram: int, out: Callable[..., dict], schema) -> DataFrame:
    """The same result for a benchmark of any size: both sides' fingerprints meet in a shuffle join."""
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect())  # at most `window` values
    columns, row_id, list_name = docs.columns, free_name(docs, "row_id"), free_name(docs, "found")
    # Of the doc_id too: copies of one text and null texts are told apart, so that no task gets them all.
    keyed = docs.withColumn(row_id, F.concat_ws(":", F.xxhash64("text"), F.md5("text"), F.xxhash64("doc_id")))

    def prints(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            words = _words(batch.column("text").slice(a, b - a))
            ids = np.array(batch.column("row_id").slice(a, b - a).to_pylist(), dtype=object)
            for size, at, value in _candidates(words, sizes, window, gram):
                doc = words.doc[at]
                yield {"row_id": pa.array(ids[doc].tolist(), pa.string()), "size": np.full(len(at), size, np.int32), "key": value.view(np.int64), "at": at - words.first[doc]}

    found = per_batch(keyed.select(F.col(row_id).alias("row_id"), "text"), prints, "row_id string, size int, key long, at long").join(rows, ["size", "key"])
    found = found.groupBy("row_id").agg(F.collect_set(F.struct((F.col("at") - F.col("place")).alias("start"), "size", "one", "two", "item_id")).alias("found"))
    joined = keyed.join(found.select(F.col("row_id").alias(row_id), F.col("found").alias(list_name)), row_id, "left").select(*columns, list_name)

    def verify(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            words = _words(batch.column("text").slice(a, b - a))
            lists = batch.column(list_name).slice(a, b - a)
            hits = pa.RecordBatch.from_struct_array(lists.flatten())
            doc = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start, size, one, two = (hits.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size", "one", "two"))
            same = (start >= 0) & (start + size <= words.counts[doc])
            start = words.first[doc] + start
            for n in np.unique(size[same]).tolist():
                these = np.flatnonzero(same & (size == n))
                for value, second in ((one, False), (two, True)):
                    same[these] &= w.runs_at(words, start[these], n, second).view(np.int64) == value[these]
            named = pc.dictionary_encode(hits.column("item_id"), null_encoding="encode")
            yield out(batch.select(columns).slice(a, b - a), words, start[same], size[same], named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[same], named.dictionary.to_pylist())

    return per_batch(joined, verify, schema)
