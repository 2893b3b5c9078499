"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. Every chunk of texts gets an index of its own
(posting bitmaps of the trigrams that the queries name), so no text crosses the network: postings are
intersected where the texts are and only the candidates are verified by the expression. Rules without a
mandatory trigram scan every text.

Defined cases: a null or empty text has no spans; matches are leftmost and non-overlapping per kind; equal starts
are ordered by the kinds' order; a private key without an END line runs to the end of the text; rows with
equal or null doc_id each get their own row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import trigrams
from lexmill.llm import words as w
from lexmill.llm.tables import per_batch


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that the checked group needs
    group: int = 0


#: The contract's three kinds first, then widely documented token formats. A token begins where none of its
#: characters precedes, so that no rule starts again inside a long run of them.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)"),
    Rule("login_url", r"://[^\s/:@]+:[^\s/:@]{3,}@"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigrams.query_of(r.pattern) for r in rules]
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.postings = trigrams.Postings(set().union(*map(trigrams.trigrams_of, self.queries)))

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, kind number, end) of every text, in order; places are code points."""
        bits = self.postings.index(*w.text_bytes(texts))
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        values = texts.to_pylist()
        for kind, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for d in np.flatnonzero(self.postings.answer(query, bits)):
                if values[d]:
                    found[d] += [(m.start(), kind, m.end()) for m in pattern.finditer(values[d]) if len(m[rule.group]) >= rule.least]
        return [sorted(x) for x in found]


def _scanner(rules: tuple[Rule, ...], kept: dict = {}) -> Scanner:  # noqa: B006  one per Python worker
    if rules not in kept:
        kept[rules] = Scanner(rules)
    return kept[rules]


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, counts and digest of the base kinds, and all spans as `kind:start:end`."""
    base = [i for i, r in enumerate(rules) if r.kind in BASE]

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        scanner = _scanner(rules)
        for a, b in w.chunks(batch.column("text")):
            found = scanner.scan(batch.column("text").slice(a, b - a))
            own = [[s for s in x if s[1] in base] for x in found]
            yield {
                "doc_id": batch.column("doc_id").slice(a, b - a),
                **{f"n_{kind}": np.array([sum(rules[s[1]].kind == kind for s in x) for x in own], np.int64) for kind in BASE},
                "base_sha256": pa.array([hashlib.sha256(_joined(x, rules).encode()).hexdigest() for x in own]),
                "spans": pa.array([_joined(x, rules) for x in found]),
            }

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; in `text`, each secret (overlapping ones as one) is replaced by `mark`."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        scanner, place = _scanner(rules), batch.schema.get_field_index("text")
        for a, b in w.chunks(batch.column(place)):
            texts, out = batch.column(place).slice(a, b - a), []
            for text, spans in zip(texts.to_pylist(), scanner.scan(texts), strict=True):
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append(text if not spans else "".join(parts) + text[at:])
            yield {name: pa.array(out, pa.string()) if i == place else batch.column(i).slice(a, b - a) for i, name in enumerate(batch.schema.names)}

    return per_batch(docs, make, docs.schema)
