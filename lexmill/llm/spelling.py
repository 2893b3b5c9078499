"""Spelling variants of words: near words by two-dimensional range reporting over wavelet trees.

Two words are near if they differ by one inserted, deleted or replaced code point. If that happens at position i, they share
what stands before it and what stands behind it. In forward order the words with one prefix are an interval; in the order of
the reversed words those with one suffix are one. A wavelet tree over the reversed ranks in forward order reports the words
in both intervals.

1. Words are counted over all texts (by chunk first, so a frequent word is one row a chunk).
2. Of two near words with a shorter length L one half of the word is the same in both: the first L // 2 code points, or as many
   last ones. Words with one such half are a block; blocks are dealt out by hash into groups of about GROUP_CHARS. Larger
   blocks are cut into parts of that size, and each part meets each other one in a group of its own.
3. In a group the words of each L (of lengths L and L + 1) get one wavelet tree. Prefix blocks are asked for the edit positions
   from L // 2 on, suffix blocks for those before it, so no pair is found twice.
4. A word's form is its near word of largest count, if that is FACTOR times its own; forms are followed by doubling.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty text where runs are damaged; rows count each
time they occur; of near words with equal counts the smaller one (by code points) is the form; texts and words of any length are
read whole; an empty table has no words; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import crc
from lexmill.llm import words as w
from lexmill.llm.tables import checkpointed, n_rows, per_batch, shuffles_dropped, typed

LEAST_LENGTH = 5
LEAST_COUNT = 3
FACTOR = 2
#: One run in so many loses a code point, as if it had been typed wrongly.
DAMAGE = 97
#: Code points that a group has about.
GROUP_CHARS = 1 << 20
#: Cut blocks (two numbers each) that are sent to every task at most; more are joined by a shuffle.
MAX_SENT = 100_000
#: Text of a chunk, and range queries that a tree answers at once.
CHUNK_BYTES = 4 << 20
QUERIES = 1 << 17

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: First byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, starts and ends of the maximal runs of letters, and how many lie before each text."""
    data, offsets = w.text_bytes(texts)
    data = w.LOWER_AZ[data]
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return data, *crc.found(inside, offsets)


def counted_runs(texts: pa.Array, ids: list, least_length: int, damage: int) -> tuple[list[str], list[int]]:
    """Distinct words of the texts with their counts; a damaged run counts as what is left of it."""
    data, start, end, first = letter_runs(texts)
    leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
    length = end - start - (leads[end] - leads[start])
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    keep = length >= least_length
    start, end, length, doc = start[keep], end[keep], length[keep], doc[keep]
    hit = np.zeros(len(start), bool)
    counts: Counter = Counter()
    if damage:
        own = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        h = crc.shifted(own[doc], end - start) ^ crc.spans(data, start, end)
        hit = h % np.uint32(damage) == 0
        for s, e, at in zip(start[hit], end[hit], (h[hit] % length[hit]).tolist(), strict=True):
            word = data[s:e].tobytes().decode()
            if len(word) > least_length:
                counts[word[:at] + word[at + 1 :]] += 1
    start, end = start[~hit], end[~hit]
    one, two = w.word_hashes(data, start, end)
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(new)
    some = order[at]
    names = [data[s:e].tobytes().decode() for s, e in zip(start[some].tolist(), end[some].tolist(), strict=True)]
    return names + list(counts), np.diff(np.append(at, len(order))).tolist() + list(counts.values())


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = 0) -> DataFrame:
    """word, n: the words of at least `least_length` code points with at least `least_count` occurrences in all texts.

    With `damage`, a run whose CRC-32 behind its doc_id is divisible by it loses one code point.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id").to_pylist()
        for a, b in w.chunks(batch.column("text"), CHUNK_BYTES):
            names, n = counted_runs(batch.column("text").slice(a, b - a), ids[a:b], least_length, damage)
            if names:
                yield {"word": pa.array(names, pa.string()), "n": pa.array(n, pa.int64())}

    found = per_batch(typed(docs, doc_id="bigint", text="string"), make, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A permutation of 0..n-1, stored bit by bit from the highest: at each level the entries are parted by one bit, those with
    a zero first, and what is kept is how many zeros stand before each place."""

    def __init__(self, values: np.ndarray):
        self.height = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for level in range(self.height - 1, -1, -1):
            zero = values >> level & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all entries at left <= place < right with low <= value < high, for many queries at once."""
        query, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in zip(range(self.height - 1, -1, -1), self.zeros, strict=True):
            half, n_zero = 1 << level, zeros[-1]
            l0, r0 = zeros[left], zeros[right]
            go0 = (l0 < r0) & (base < high[query]) & (base + half > low[query])
            l1, r1, base1 = n_zero + left - l0, n_zero + right - r0, base + half
            go1 = (l1 < r1) & (base1 < high[query]) & (base1 + half > low[query])
            query = np.concatenate([query[go0], query[go1]])
            left, right = np.concatenate([l0[go0], l1[go1]]), np.concatenate([r0[go0], r1[go1]])
            base = np.concatenate([base[go0], base1[go1]])
        return query, base


class _Order:
    """Rows of letters in order; the rows that share their first k letters are an interval."""

    def __init__(self, letters: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
        ordered = letters[self.order]
        differ = ordered[1:] != ordered[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])
        self.place = np.empty(len(letters), np.int64)
        self.place[self.order] = np.arange(len(letters))

    def intervals(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.append(0, np.flatnonzero(self.common < k) + 1)
        which = np.searchsorted(starts, self.place[rows], side="right") - 1
        return starts[which], np.append(starts, len(self.order))[which + 1]


def letter_rows(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points (none is above 255), one after the other, and their n+1 offsets."""
    data, offsets = w.text_bytes(words)
    lead = data == _LEAD
    letters = data + np.uint8(0x40) * np.concatenate([[False], lead[:-1]]).astype(np.uint8)
    return letters[~lead], offsets - np.concatenate([[0], np.cumsum(lead)])[offsets]


def _padded(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, back: bool) -> np.ndarray:
    out, column = np.zeros((len(starts), width), np.uint8), np.arange(width)
    inside = column < lengths[:, None]
    at = (starts + lengths - 1)[:, None] - column if back else starts[:, None] + column
    out[inside] = letters[at[inside]]
    return out


def near_in(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, member: np.ndarray, asking: np.ndarray, short: int, positions: range) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word), both as numbers, of the words that ask (of length `short`) and members (of length short or short + 1) with the
    edit at one of `positions`. Each pair of an asking word and a member is given once."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.flatnonzero(asking)
    if not len(rows) or not member.any() or len(starts) < 2:
        return none
    ahead = _padded(letters, starts, lengths, short + 1, False)
    forward, reverse = _Order(ahead), _Order(_padded(letters, starts, lengths, short + 1, True))
    # In the tree: members in forward order; their values are ranks in reverse order, first those of length `short`.
    before = np.concatenate([[0], np.cumsum(member[forward.order])])
    longer = lengths[reverse.order] > short
    n_short = int((member & (lengths == short)).sum())
    rank = [offset + np.concatenate([[0], np.cumsum(member[reverse.order] & side)]) for offset, side in ((0, ~longer), (n_short, longer))]
    by_value = np.concatenate([reverse.order[member[reverse.order] & ~longer], reverse.order[member[reverse.order] & longer]])
    value = np.empty(len(starts), np.int64)
    value[by_value] = np.arange(len(by_value))
    tree = WaveletTree(value[forward.order[member[forward.order]]])

    asked, waiting, out = [], 0, []

    def answer() -> None:
        who, added, at, *ranges = (np.concatenate(x) for x in zip(*asked, strict=True))
        query, found = tree.report(*ranges)
        near, who, added, at = by_value[found], who[query], added[query], at[query]
        # A letter that is added to a run of itself counts at the run's first place only.
        good = np.where(added, (at == 0) | (ahead[near, at] != ahead[near, np.maximum(at - 1, 0)]), near != who)
        out.append((who[good], near[good]))

    for i in positions:
        left, right = (before[x] for x in forward.intervals(rows, i))
        for added in (False, True):
            behind = short - i - (not added)
            if behind < 0:
                continue
            low, high = (rank[added][x] for x in reverse.intervals(rows, behind))
            least = np.where(member[rows] & (not added), 1, 0)
            some = np.flatnonzero((right - left > least) & (high - low > least))
            if len(some):
                asked.append((rows[some], np.full(len(some), added), np.full(len(some), i), left[some], right[some], low[some], high[some]))
                waiting += len(some)
                if waiting >= QUERIES:
                    answer()
                    asked, waiting = [], 0
    if asked:
        answer()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def near_in_group(table: pa.Table) -> pa.Table:
    """Per word of one group: how many of its near words were found here, and the one of largest count."""
    words = table.column("word").combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks)
    n, short, suffix, cut = (table.column(c).to_numpy() for c in ("n", "short", "suffix", "cut"))
    member, asking = (table.column(c).to_numpy() for c in ("member", "asking"))
    letters, offsets = letter_rows(words)
    lengths = np.diff(offsets)
    pairs = []
    order = np.lexsort((cut, suffix, short))
    edges = np.flatnonzero(np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (short, suffix, cut)], axis=0)))
    for mine in np.split(order, edges[1:]):
        size, half = int(short[mine[0]]), int(short[mine[0]]) // 2
        positions = range(half) if suffix[mine[0]] else range(half, size + 1)
        a, b = near_in(letters, offsets[mine], lengths[mine], member[mine], asking[mine], size, positions)
        a, b = mine[a], mine[b]
        longer = lengths[b] > size  # these do not ask for shorter words
        pairs.append((np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])))
    word, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
    name = words.dictionary_encode()
    by_name = np.argsort(np.argsort(np.array(name.dictionary.to_pylist(), object), kind="stable"), kind="stable") if len(name.dictionary) else np.zeros(0, np.int64)
    place = by_name[name.indices.to_numpy()]
    order = np.lexsort((place[near], -n[near], place[word]))
    word, near = word[order], near[order]
    new = np.flatnonzero(np.append(True, place[word[1:]] != place[word[:-1]])) if len(word) else np.zeros(0, np.int64)
    return pa.table({"word": words.take(pa.array(word[new])), "n_near": np.diff(np.append(new, len(word))), "form_n": n[near[new]], "form": words.take(pa.array(near[new]))})


def blocks(counts: DataFrame, least_length: int = 1) -> DataFrame:
    """word, n, short, suffix, block: each word in the blocks of its halves, for near words as long or longer and for shorter ones."""
    size = F.length("word").alias("size")
    short = F.explode(F.expr(f"filter(array(size, size - 1), x -> x >= {least_length})")).alias("short")
    rows = counts.select("word", "n", size).select("word", "n", "size", short).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"))
    half = F.expr("IF(suffix, right(word, short div 2), left(word, short div 2))")
    return rows.withColumn("block", F.xxhash64("short", "suffix", half))


def grouped(counts: DataFrame, least_length: int = 1, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The rows of blocks() with group, cut (tells the parts of a cut block apart, 0 for whole ones), member (can be found) and asking."""
    rows = blocks(counts, least_length)
    with shuffles_dropped(counts.sparkSession):
        total = rows.agg(F.sum("size")).first()[0] or 0
    n_groups = total // group_chars + 1
    large = checkpointed(rows.groupBy("block").agg(F.ceil(F.sum("size") / F.lit(group_chars)).cast("int").alias("parts")).where("parts > 1"))
    rows = rows.join(F.broadcast(large) if n_rows(large) <= MAX_SENT else large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # Part p asks part m in the group (m, p).
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    role = F.explode(F.expr("IF(other = part, array(0), IF(size = short, array(1, 2), array(1)))")).alias("role")
    rows = rows.select("*", role)
    member, asking = F.col("role") < 2, (F.col("role") != 1) & (F.col("size") == F.col("short"))
    pair = F.expr("IF(role = 1, struct(part AS m, other AS p), struct(other AS m, part AS p))")
    place = F.xxhash64("block", pair)
    cut = F.when(F.col("parts") > 1, place).otherwise(F.lit(0).cast("long")).alias("cut")
    return rows.select(F.pmod(place, F.lit(n_groups)).alias("group"), "word", "n", F.col("short").cast("long").alias("short"), "suffix", cut, member.alias("member"), asking.alias("asking"))


def near_words(counts: DataFrame, least_length: int = 1, group_chars: int = GROUP_CHARS) -> DataFrame:
    """word, n_near, form, form_n for words (of `word`, `n`) with near words: the near word of largest count and its count."""
    found = grouped(counts, least_length, group_chars).groupBy("group").applyInArrow(near_in_group, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form; no circles) lead in the end. Rounds grow with the logarithm of the longest way."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, damage: int = 0, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Per word of word_counts(): word, n, n_near (its near words), form (the near word of largest count n, if that is `factor` times
    its own; else null), form_n, root (where forms lead)."""
    counts = checkpointed(word_counts(docs, least_length, least_count, damage))
    near = checkpointed(counts.join(near_words(counts, least_length, group_chars), "word", "left"))
    formed = F.col("form_n") >= F.lit(factor) * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB: near words share what is left when one code point is deleted.
ORACLE = """
WITH RECURSIVE steps(b, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
bytes AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS x FROM documents),
u AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, count(*) AS n FROM r WHERE length(x) >= 5 GROUP BY ALL),
h AS (SELECT x, n, coalesce(doc_id::VARCHAR, '') || ':' || x AS g FROM u),
c AS (SELECT x, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM h, bytes),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, n FROM c),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM del),
near AS (
  SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, k.word, k.n FROM v JOIN k ON k.rest = v.word
  UNION SELECT k.word, v.word, v.n FROM v JOIN k ON k.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
way(word, root) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f z ON z.word = way.root WHERE z.form IS NULL
"""
