"""Quality rules as a short-circuit cascade: cheap and selective rules first.

A text that fails a rule is rejected and the later rules skip it. On a sample of about SAMPLE_ROWS rows each rule's
cost (processor time, as a power of two) and the texts it rejects are measured; the next rule is always the one that
rejects most of the sampled texts still left for its cost. Words are found once; what a rule counts is kept for
the later ones. The order changes the time only: the verdict is the conjunction of all rules.

Defined cases: a null or empty text has no words, zero counts and fails the base rule; repeated rows each get
their own row; a null doc_id stays null; very long texts are judged whole, alone if longer than a chunk; an empty table
gives an empty result; other columns are ignored by quality() and kept by passing().
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import words as w
from lexmill.llm.tables import per_batch

#: Rows, about, of the sample on which costs and selectivities are estimated; it sets the order of the rules only.
SAMPLE_ROWS = 512
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = w._table(b"#*$%&|<>")
SENTENCE_SHOUT = w._table(b"!")
UPPER = w._table(bytes(range(65, 91)))
LETTER = w._table(bytes(range(65, 91)) + bytes(range(97, 123)))


class Texts:
    """A chunk of texts with the counts that rules ask for, made on first use and kept."""

    def __init__(self, texts: pa.Array, words: w.Words | None = None, known: dict[str, np.ndarray] | None = None):
        self.texts, self.words, self.known = texts, words or w.find_words(texts), known or {}

    def take(self, keep: np.ndarray) -> Texts:
        return Texts(self.texts.filter(pa.array(keep)), self.words.take(keep), {k: v[keep] for k, v in self.known.items()})

    def count(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = COUNTS[name](self)
        return self.known[name]

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        return w.per_text(table[self.words.data], self.words.offsets)


def _word_chars(t: Texts) -> np.ndarray:
    data = t.words.data
    return w.per_text(w.NON_SPACE[data] & ((data & 0xC0) != 0x80), t.words.offsets)


def _lines(t: Texts) -> list[list[str]]:
    """The lines with a word of each text."""
    return [[x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")] for text in t.texts.to_pylist()]


def _repeat_words(t: Texts) -> np.ndarray:
    """Words that lie in a run of three words found twice or more in the text; runs are compared by both hashes."""
    at, one = w.windows(t.words, 3)
    two, doc = w.runs_at(t.words, at, 3, True), t.words.doc[at]
    order = np.lexsort((one, doc))
    same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (one, two, doc)]) if len(at) else np.zeros(0, bool)
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return w.per_text(w.covered(at[twice], 3, len(t.words.hash)), t.words.first)


COUNTS: dict[str, Callable[[Texts], np.ndarray]] = {
    "words": lambda t: t.words.counts,
    "word_chars": _word_chars,
    "symbols": lambda t: t.bytes_in(SYMBOLS),
    "shouts": lambda t: t.bytes_in(SENTENCE_SHOUT),
    "upper": lambda t: t.bytes_in(UPPER),
    "letters": lambda t: t.bytes_in(LETTER),
    "lines": lambda t: np.array([len(x) for x in _lines(t)], np.int64),
    "dup_lines": lambda t: np.array([len(x) - len(set(x)) for x in _lines(t)], np.int64),
    "repeat_words": _repeat_words,
}

#: name -> marks of the texts that the rule rejects. Thresholds are per word, letter or line of the text.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "few_words": lambda t: t.count("words") < MIN_WORDS,
    "repeated_runs": lambda t: 100 * t.count("repeat_words") > MAX_REPEAT_PERCENT * t.count("words"),
    "symbols": lambda t: 10 * t.count("symbols") > t.count("words"),
    "exclamations": lambda t: 3 * t.count("shouts") > t.count("words"),
    "capitals": lambda t: 10 * t.count("upper") > 4 * t.count("letters"),
    "word_length": lambda t: (t.count("word_chars") < 2 * t.count("words")) | (t.count("word_chars") > 20 * t.count("words")),
    "same_lines": lambda t: 2 * t.count("dup_lines") > t.count("lines"),
}
BASE = ("few_words", "repeated_runs")


def cascade(t: Texts, order: list[str]) -> np.ndarray:
    """Marks of the texts that pass all rules; each rule sees only what the earlier ones left."""
    left, alive = np.arange(len(t.texts)), t
    for name in order:
        if not len(left):
            break
        ok = ~RULES[name](alive)
        if not ok.all():
            left = left[ok]
            alive = alive.take(ok)
    kept = np.zeros(len(t.texts), bool)
    kept[left] = True
    return kept


def plan_cascade(docs: DataFrame, judged: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, best first, for texts that pass the rules of `judged`; as listed where the sample is empty."""
    names = [x for x in RULES if x not in judged]

    def measure(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column(0)):
            texts = batch.column(0).slice(a, b - a)
            passed = cascade(Texts(texts), list(judged))
            texts, costs, verdicts = texts.filter(pa.array(passed)), [], []
            if not len(texts):
                continue
            for name in names:
                spent = []
                for _ in range(2):
                    fresh = Texts(texts)
                    began = time.process_time()
                    verdict = RULES[name](fresh)
                    spent.append(time.process_time() - began)
                costs.append(min(spent))
                verdicts.append(verdict)
            rejects = (np.array(verdicts).T << np.arange(len(names))).sum(1)
            yield {"rejects": rejects.astype(np.int64), "costs": pa.array([(np.array(costs) / len(texts)).tolist()] * len(texts), pa.list_(pa.float64()))}

    n = docs.count()
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(min(1.0, sample_rows / max(n, 1)), 5)
    rows = per_batch(sample, measure, "rejects long, costs array<double>").collect()  # a few numbers for each sampled row
    return _greedy(names, np.array([r["rejects"] for r in rows], np.int64), np.array([r["costs"] for r in rows], float).reshape(-1, len(names)))


def _greedy(names: list[str], rejects: np.ndarray, costs: np.ndarray) -> list[str]:
    """Each next rule rejects most of the texts that are left for its cost; equal ones stay as listed."""
    if not len(rejects):
        return names
    cost = 2.0 ** np.round(np.log2(np.maximum(costs.mean(0), 1e-9)))
    order, left = [], list(range(len(names)))
    while left:
        worth = [float(((rejects >> k) & 1).sum()) / cost[k] for k in left]
        best = left.pop(int(np.argmax(worth)))
        order.append(names[best])
        rejects = rejects[((rejects >> best) & 1) == 0]
    return order


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, the four base counts, base_failed, kept.

    `base_failed` fails texts of fewer than 50 words or with over half of the words in repeated three-word runs;
    `kept` also needs the further rules of RULES, run as a cascade over the texts that passed the base rule. The base
    counts are part of the result, so every text has them; rules that ask for the same counts get them for nothing.
    """
    order = plan_cascade(docs, BASE, sample_rows)

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            t = Texts(batch.column("text").slice(a, b - a))
            base = {f"n_{x}" if x != "word_chars" else x: t.count(x) for x in ("words", "word_chars", "symbols", "dup_lines", "repeat_words")}
            failed = RULES["few_words"](t) | RULES["repeated_runs"](t)
            kept = np.zeros(b - a, bool)
            if not failed.all():
                kept[~failed] = cascade(t.take(~failed), order)
            yield {"doc_id": batch.column("doc_id").slice(a, b - a)} | base | {"base_failed": failed, "kept": kept}

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def passing(docs: DataFrame) -> DataFrame:
    """The rows that quality() keeps, with all columns; each is judged by its own text."""
    order = plan_cascade(docs)

    def keep(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            part = batch.slice(a, b - a)
            part = part.filter(pa.array(cascade(Texts(part.column("text")), order)))
            yield dict(zip(part.schema.names, part.columns, strict=True))

    return per_batch(docs, keep, docs.schema)


#: The same in DuckDB SQL; runs of three words are compared as words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, a, lead(a, 1) OVER (PARTITION BY rid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM t),
h AS (SELECT rid, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM h, range(3) s(k) GROUP BY rid),
n AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts,
 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (10 * n_symbols > n_words OR 3 * shouts > n_words OR 10 * upper_letters > 4 * letters OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines) AS kept FROM f
"""
