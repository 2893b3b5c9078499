"""Boolean trigram queries derived from regular expressions, and in-task posting bitmaps to answer them.

A query is None (no mandatory trigram: scan everything), a trigram, or ("and" | "or", parts). Trigrams are of the
text with A-Z lower-cased, so one index serves rules of either case.
"""

from __future__ import annotations

import re
from re import _parser as parser

import numpy as np

from lexmill.llm import words as w

#: A set of exact strings grows to this many before it is turned into a query.
MAX_STRINGS = 64
MAX_CLASS = 8


def _and(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """Holds for every text that contains one of the strings; None if one of them is too short."""
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            found.add(chr(value))
        elif str(op) == "RANGE" and value[1] - value[0] < MAX_CLASS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    found = {c.lower() if c.isascii() else c for c in found}
    return found if len(found) <= MAX_CLASS else None


def _walk(items) -> tuple[set[str] | None, object]:
    """The exact strings of the items where they are few, and the query they imply."""
    runs: list[object] = []
    exact: set[str] = {""}
    whole = True

    def flush():
        nonlocal exact, whole
        runs.append(_of_strings(exact))
        exact, whole = {""}, False

    for op, value in items:
        name, strings, query = str(op), None, None
        if name == "LITERAL":
            strings = {chr(value).lower() if value < 128 else chr(value)}
        elif name == "IN":
            strings = _class(value)
        elif name == "SUBPATTERN":
            strings, query = _walk(value[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in value[1]]
            query = _or([q if s is None else _and([q, _of_strings(s)]) for s, q in parts])
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
                query = None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            own, inner_query = _walk(inner)
            if own is not None and low == high and int(low) <= 4:
                strings = {""}
                for _ in range(int(low)):
                    strings = {a + b for a in strings for b in own}
            elif own is not None and (int(low), high) == (0, 1):
                strings = own | {""}
            elif int(low) >= 1:
                query = inner_query if own is None else _of_strings(own)
        elif name == "AT":
            continue
        if strings is not None and len(exact) * len(strings) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            flush()
            runs.append(query if strings is None else _of_strings(strings))
    if whole:
        return exact, None
    runs.append(_of_strings(exact))
    return None, _and(runs)


def query_of(pattern: str):
    strings, query = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams_of(query) -> set[str]:
    if query is None or isinstance(query, str):
        return {query} - {None}
    return set().union(*(trigrams_of(x) for x in query[1]))


class Postings:
    """Posting bitmaps over a chunk of texts, for the trigrams that the queries ask for."""

    def __init__(self, trigrams: set[str]):
        self.codes = {t: int.from_bytes(t.encode("latin-1"), "big") for t in trigrams if t.isascii()}
        self.number = np.full(1 << 24, -1, np.int16)
        for i, code in enumerate(sorted(self.codes.values())):
            self.number[code] = i
        self.rank = {t: int(self.number[c]) for t, c in self.codes.items()}

    def index(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """bitmap[trigram, text]"""
        bits = np.zeros((len(self.rank), len(offsets) - 1), bool)
        if len(data) >= 3 and self.rank:
            low = w.LOWER_AZ[data].astype(np.int32)
            number = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(number >= 0)
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 3 <= offsets[doc + 1]
            bits[number[at[inside]], doc[inside]] = True
        return bits

    def answer(self, query, bits: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(bits.shape[1], bool)
        if isinstance(query, str):
            return bits[self.rank[query]] if query in self.rank else np.ones(bits.shape[1], bool)
        parts = [self.answer(x, bits) for x in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)
