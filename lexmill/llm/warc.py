"""Merkle fixity audit of WARC replicas.

Pages become WARC response records; FILE_SLOTS page ids share a file and lie there in page_id order. A leaf is
the digest of one slot's records, an inner node the digest of up to FANOUT children together with their ordered
offset range. Trees of two replicas are compared from the root down: only children of differing nodes are
looked at, until the differing leaves locate the records.

Every level is kept before the next one is made of it, so a tree costs one pass over the pages and a sixteenth of
its size more for each level; the descent reads of each level only the children of differing nodes.

Defined cases: a null url or html is an empty string; rows with one page_id make one leaf (a digest over each
distinct record and its count); rows with a null page_id lie in files of their own (NULL_FILE and up) by their digest,
so that no leaf gathers them all; repeated records count as often as they are there; an empty replica reports every
record of the other, two empty ones nothing; equal replicas give no rows; texts of any length are hashed whole; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.tables import checkpointed

#: Powers of two: _up() and the file number shift by their logarithms.
FANOUT = 16
FILE_SLOTS = 256
#: Levels from a leaf to a file's root, as FANOUT ** 2 == FILE_SLOTS.
FILE_LEVELS = 2
#: First file of the records without a page_id; they fill up to NULL_FILES of them.
NULL_FILE, NULL_FILES = -(1 << 40), 1 << 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """One row a page_id: file, slot, digest, start and end offset in the file."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))
    rows = rows.select("page_id", F.sha2("record", 256).alias("sha"), F.octet_length("record").cast("long").alias("bytes"))
    none = F.col("page_id").isNull()
    spread = lambda at, n: F.conv(F.substring("sha", at, n), 16, 10).cast("long")
    file = F.when(none, F.lit(NULL_FILE) + spread(1, 4)).otherwise(F.shiftright("page_id", 8)).cast("long")
    slot = F.when(none, spread(5, 2)).otherwise(F.pmod("page_id", F.lit(FILE_SLOTS))).cast("long")
    copies = rows.groupBy(file.alias("file"), slot.alias("slot"), "page_id", "sha", "bytes").agg(F.count("*").alias("n"))
    # A leaf of one record has its digest; one of several has the sums (without carry) of theirs, in any order.
    own = F.concat_ws(":", "sha", "n")
    lanes = [F.bit_xor(F.xxhash64(F.lit(i), F.sha2(own, 256))).alias(f"lane{i}") for i in range(4)]
    slots = copies.groupBy("file", "slot", "page_id").agg(F.sum(F.col("bytes") * F.col("n")).alias("bytes"), F.count("*").alias("parts"), F.min(own).alias("one"), *lanes)
    several = F.sha2(F.concat_ws(":", "parts", *[f"lane{i}" for i in range(4)]), 256)
    slots = slots.select("file", "slot", "page_id", "bytes", F.when(F.col("parts") == 1, F.col("one")).otherwise(several).alias("digest"))
    end = F.sum("bytes").over(Window.partitionBy("file").orderBy("slot"))
    return slots.select("file", "slot", "page_id", "digest", (end - F.col("bytes")).alias("start"), end.alias("end"))


def _up(column: str) -> Column:
    return F.shiftright(column, 4)


def parents(nodes: DataFrame, inside: bool) -> DataFrame:
    """The next level up: slots meet in a file, then files meet by number. A digest covers the ordered ranges."""
    child = F.struct(F.col("slot" if inside else "file").alias("at"), F.concat_ws(":", "digest", "start", "end").alias("text")).alias("child")
    keys = ["file", _up("slot").alias("slot")] if inside else [_up("file").alias("file"), "slot"]
    up = nodes.select(*keys, child, "start", "end")
    # One group has at most FANOUT children.
    return up.groupBy("file", "slot").agg(F.array_sort(F.collect_list("child")).alias("children"), F.min("start").alias("start"), F.max("end").alias("end")).select("file", "slot", F.sha2(F.array_join(F.transform("children", lambda c: c["text"]), ","), 256).alias("digest"), "start", "end")


def tree(pages: DataFrame, levels: int | None = None) -> list[DataFrame]:
    """Levels from the leaves to the root. `levels` above the file roots default to what the file numbers need."""
    out = [checkpointed(leaves(pages))]
    for _ in range(FILE_LEVELS):
        out.append(checkpointed(parents(out[-1].select("file", "slot", "digest", "start", "end"), True)))
    if levels is None:
        low, high = out[-1].where(f"file >= {NULL_FILE + NULL_FILES}").agg(F.min("file"), F.max("file")).first()
        levels, low, high = 0, low or 0, high or 0
        while low != high:
            low, high, levels = low // FANOUT, high // FANOUT, levels + 1
    for _ in range(levels):
        out.append(checkpointed(parents(out[-1], False)))
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level that differ between the replicas, or that one of them lacks."""
    right = b.select("file", "slot", F.col("digest").alias("other"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    both = a.select("file", "slot", "digest", "start", "end").join(right, ["file", "slot"], "full_outer")
    return both.where(~F.col("digest").eqNullSafe(F.col("other")))


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, start, end (offsets in the first replica, or in the second for an extra record), status."""
    left, right = tree(pages), None
    levels = len(left) - 1 - FILE_LEVELS
    right = tree(replica)
    if len(right) != len(left):
        levels = max(levels, len(right) - 1 - FILE_LEVELS)
        left, right = ([*x, *_more(x, levels - (len(x) - 1 - FILE_LEVELS))] for x in (left, right))
    bad = checkpointed(_differ(left[-1], right[-1]).select("file", "slot"))
    for level in range(len(left) - 2, -1, -1):
        inside = level < FILE_LEVELS
        key = [F.col("file"), _up("slot")] if inside else [_up("file"), F.col("slot")]
        up = bad.select(F.col("file").alias("up_file"), F.col("slot").alias("up_slot"))
        below = [x.withColumn("k1", key[0]).withColumn("k2", key[1]).join(up, (F.col("k1") == F.col("up_file")) & (F.col("k2") == F.col("up_slot")), "left_semi") for x in (left[level], right[level])]
        bad = _differ(*below)
        if level:
            bad = checkpointed(bad.select("file", "slot"))
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("other").isNull(), "missing").otherwise("altered")
    page_id = F.when(F.col("file") < NULL_FILE + NULL_FILES, F.lit(None)).otherwise(F.col("file") * FILE_SLOTS + F.col("slot")).cast("long")
    return bad.select(page_id.alias("page_id"), "file", F.coalesce("start", "other_start").alias("start_offset"), F.coalesce("end", "other_end").alias("end_offset"), status.alias("status"))


def _more(levels: list[DataFrame], n: int) -> list[DataFrame]:
    out = []
    for _ in range(n):
        out.append(checkpointed(parents(out[-1] if out else levels[-1], False)))
    return out


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted faults, by page_id: one in 64 is altered, one in 64 cut, one in 64 lacks."""
    part, html = F.pmod(F.col("page_id").cast("long"), F.lit(64)), F.col("html").cast("string")
    html = F.when(part == 3, F.concat(html, F.lit("!"))).when(part == 5, F.expr("left(CAST(html AS STRING), CAST(floor(length(CAST(html AS STRING)) / 2) AS INT))")).otherwise(html)
    return pages.where(~F.coalesce(part == 7, F.lit(False))).select("page_id", "url", html.alias("html"))


#: The audit's rows for `damaged`, in DuckDB SQL: records compared one by one.
ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN page_id % 64 = 3 THEN html || '!' WHEN page_id % 64 = 5 THEN left(html, CAST(floor(length(html) / 2) AS INT)) ELSE html END AS bad, html, url FROM pages),
s AS (SELECT page_id, page_id // {FILE_SLOTS} AS file, bad IS DISTINCT FROM html AS altered,
 strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS n FROM r),
t AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY page_id) AS e FROM s)
SELECT page_id, CAST(file AS BIGINT) AS file, CAST(e - n AS BIGINT) AS start_offset, CAST(e AS BIGINT) AS end_offset, CASE WHEN page_id % 64 = 7 THEN 'missing' ELSE 'altered' END AS status FROM t WHERE page_id % 64 = 7 OR (page_id % 64 IN (3, 5) AND altered)
"""
