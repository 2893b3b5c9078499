"""Resampling of documents towards a target text by importance, with an external sort-count.

Features are runs of 1 and 2 words; a feature's bucket is a CRC-32 modulo BUCKETS. The work has three passes:

1. write the buckets of all features as packed 16-bit streams, one a chunk of texts, with the documents' offsets in it,
   to the shared folder;
2. sort each stream and encode its runs by their lengths; Spark adds the counts up (BUCKETS numbers in the end);
3. read the streams again, gather the gain of each entry and add up each document's part with np.add.reduceat.

So a text is read and hashed once, and no counter is ever held by document.

Defined cases: a null or empty text has no features and weighs 0; a null doc_id counts as the empty text where scores are
drawn and comes last in ties; a repeated row is a row like any other (it counts, and is ranked, each time); a text of any
length is read whole, alone if it is longer than a chunk; empty tables count nothing (gains are defined without features);
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import crc
from lexmill.llm import words as w
from lexmill.llm.tables import checkpointed, n_rows, per_batch, running_sums, shuffles_dropped, typed

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7


def bucket_stream(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, one text after the other, and the texts' n+1 offsets in them."""
    data, offsets = w.text_bytes(texts)
    data = w.LOWER_AZ[data]
    start, end, first = crc.found(w.ALNUM[data], offsets)
    out = np.zeros(2 * len(start), np.uint16)
    one = crc.spans(data, start, end)
    out[::2] = one % np.uint32(buckets)
    pair = crc.shifted(crc.with_byte(one[:-1], 0x20), (end - start)[1:]) ^ one[1:]
    out[1:-1:2] = pair % np.uint32(buckets)
    used = np.ones(len(out), bool)
    used[2 * first[1:][first[1:] > first[:-1]] - 1] = False  # behind the last word of a text no pair begins
    return out[used], 2 * first - np.concatenate([[0], np.cumsum(np.diff(first) > 0)])


def streams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_ids, offsets, stream: a row for each chunk of texts, whose features' buckets are packed as 16-bit numbers."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            stream, offsets = bucket_stream(batch.column("text").slice(a, b - a), buckets)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column("doc_id").slice(a, b - a), pa.array(offsets))]
            yield {"doc_ids": lists[0], "offsets": lists[1], "stream": pa.array([stream.astype("<u2").tobytes()], pa.binary())}

    return per_batch(docs, make, "doc_ids array<long>, offsets array<long>, stream binary")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a stream, sorted, and how often each occurs."""
    ordered = np.sort(stream, kind="stable")
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def counted(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all streams fall into each bucket (`buckets` numbers, whatever the input)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                values, n = run_lengths(np.frombuffer(stream.as_buffer(), "<u2"))
                total[values] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})

    with shuffles_dropped(packed.sparkSession):
        rows = packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the logarithm, in thousandths, of how much likelier it is in the target."""
    n = len(source)
    rises = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.floor(1000 * np.log(rises)).astype(np.int64)


def weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight (the floored mean gain of its features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                offsets = batch.column("offsets")[i].values.to_numpy()
                n = np.diff(offsets)
                sums, some = np.zeros(len(n), np.int64), n > 0
                if some.any():
                    sums[some] = np.add.reduceat(gain[np.frombuffer(batch.column("stream")[i].as_buffer(), "<u2")], offsets[:-1][some])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_ids")[i].values, "n_features": n, "weight": sums // np.maximum(n, 1)})

    return packed.mapInArrow(run, "doc_id long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per row of `docs`: doc_id, n_features, weight, score, rank (of the drawn ones, by score).

    Of the rows with `least_words` words `percent` in a hundred are drawn: those of the highest scores, which are weights
    with Gumbel noise, so that the draw follows the weights without replacement. `buckets` is at most 65,536.
    """
    packed = checkpointed(streams(typed(docs, doc_id="bigint", text="string"), buckets))
    gain = gains(counted(packed, buckets), counted(streams(target.select(F.lit(0).cast("bigint").alias("doc_id"), F.col("text").cast("string")), buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # Kept: ranking reads the rows several times, and row numbers must not change.
    rows = checkpointed(weighed(packed, gain).withColumn("score", F.col("weight") + noise))
    long_enough = F.col("n_features") >= 2 * least_words - 1
    able = rows.where(long_enough).withColumns({"one": F.lit(1).cast("bigint"), "row": F.monotonically_increasing_id()})
    draws = n_rows(able) * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    place = F.col("before_one") + 1
    ranked = running_sums(able, order, ["one"]).select("doc_id", "n_features", "weight", "score", F.when(place <= draws, place).alias("rank"))
    return ranked.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id is drawn (rows of one doc_id are drawn together)."""
    chosen = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_drawn"]), "left_semi")


#: DuckDB: CRCs are made byte by byte from a table by rule.
ORACLE = """
WITH RECURSIVE steps(b, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
bytes AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, 0 AS side, row_number() OVER () AS r, text FROM documents UNION ALL SELECT NULL, 1, row_number() OVER (), text FROM benchmark),
w AS (SELECT doc_id, side, r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM d),
f AS (SELECT side, r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w),
names AS (SELECT DISTINCT g FROM f),
hashed AS (SELECT g, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000)::BIGINT AS bucket FROM names, bytes),
e AS (SELECT side, r, bucket FROM f JOIN hashed USING (g)),
s AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM e GROUP BY bucket),
tot AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM e),
g AS (SELECT bucket, floor(1000 * ln(((s.t + 1)::DOUBLE * (tot.s + 10000)) / ((s.s + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain FROM s, tot),
p AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM e JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
o AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) AS nw,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN p USING (r) WHERE side = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY nw >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN nw >= 20 AND place <= 25 * (SELECT count(*) FROM o WHERE nw >= 20) // 100 THEN place END AS rank FROM k
"""
