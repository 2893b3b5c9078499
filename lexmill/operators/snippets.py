"""The best fragment of a hit: a window of index tokens in one field, shown as the field's own text with the hits marked."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.tokens import index_tokens
from lexmill.operators.index import FIELD_STEP, FIELDS
from lexmill.operators.search import Query, Source, _Plan

WIDTH = 45
_TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}_ \t\n\r\f\x0B\p{Z}]")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")


def hit_places(source: Source, q: Query) -> DataFrame:
    """id and places (field and token number in one number, as in the index) of all tokens of the query's phrases, in entities that
    match. Phrases behind a NOT have none, those of a NEAR only where they stand close enough."""
    plan = _Plan(q)
    match, counts, _ = plan.evaluate()
    near = {at + i: found for group, at in plan.nears() for i, found in enumerate(plan.near(group, at))}
    spread = lambda n: lambda x: F.sequence(x, x + F.lit(n - 1))
    parts = [F.flatten(F.transform(near.get(i, F.col(f"p{i}")), spread(len(plan.leaves[i].tokens)))) for i in counts]
    return plan.grouped(source, FIELDS).where(match).select("id", F.array_sort(F.array_distinct(F.flatten(F.array(*parts)))).alias("places"))


def token_spans(text: str, end: int) -> list[tuple[int, int]]:
    """Places in the text of its first `end` index tokens."""
    out: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        if len(out) >= end:
            break
        cuts = [m.start(), *(c.start() for c in _CAMEL.finditer(text, m.start() + 1, m.end())), m.end()]
        out += list(zip(cuts, cuts[1:], strict=False))
    return out[:end]


def best_window(places: np.ndarray, sizes: list[int], width: int) -> tuple[int, int, int]:
    """Field number, first token and number of hit tokens of the window of `width` tokens with most hits; of several the one
    in the first field, and there the first. A window begins at a hit, or so that it ends with the field."""
    best = (0, 0, 0)
    for f in np.unique(places // FIELD_STEP).tolist():
        own = places[places // FIELD_STEP == f] % FIELD_STEP
        starts = np.minimum(own, max(sizes[f] - width, 0))
        hits = np.searchsorted(own, starts + width) - np.searchsorted(own, starts)
        at = int(hits.argmax())
        if hits[at] > best[2]:
            best = (f, int(starts[at]), int(hits[at]))
    return best


def snippets(hits: DataFrame, entities: DataFrame, places: DataFrame, width: int = WIDTH, before: str = "[", after: str = "]") -> DataFrame:
    """`hits` (id, ...; the few rows of a top-k) with field, first (token of the window), n_hits and snippet.

    places: of hit_places(). A hit without any has an empty snippet.
    """

    @F.pandas_udf("struct<field:string,first:long,n_hits:long,snippet:string>")
    def cut(texts: pd.Series, sizes: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for fields, size, mine in zip(texts, sizes, found, strict=True):
            if mine is None or not len(mine):
                rows.append((None, None, 0, ""))
                continue
            own = np.sort(np.asarray(mine))
            f, first, n = best_window(own, list(size), width)
            text, marked = fields[f], set((own[own // FIELD_STEP == f] % FIELD_STEP).tolist())
            spans = token_spans(text, first + width)
            shown, at = [], spans[first][0]
            for i, (a, b) in enumerate(spans[first:], first):
                word = text[a:b]
                shown += [text[at:a], f"{before}{word}{after}" if i in marked else word]
                at = b
            rows.append((FIELDS[f], first, n, ("..." if first else "") + "".join(shown) + ("..." if first + width < size[f] else "")))
        return pd.DataFrame(rows, columns=["field", "first", "n_hits", "snippet"])

    text = [F.coalesce(F.col(f), F.lit("")) for f in FIELDS]
    wide = entities.select("id", F.array(*text).alias("_texts"), F.array(*[F.size(index_tokens(t)) for t in text]).alias("_sizes"))
    rows = hits.join(wide, "id").join(places, "id", "left")
    return rows.withColumn("_s", cut("_texts", "_sizes", "places")).select(*hits.columns, "_s.*")
