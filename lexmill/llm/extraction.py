"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

Each leaf block gets features of its open elements (tags, class and id words, the innermost telling element) and
of its text (length, link share, end mark). A two-label chain field (main text or not) weighs them together with
the label of the block before. It is trained by gradient ascent on labelled pages (html_training, a fixed number)
and decoded by Viterbi for each page inside the tasks.

Defined cases: a null or empty html has an empty text; a page without main text too; text outside any tag is a block;
unclosed comments and scripts end with the page; an unclosed tag is dropped up to the next tag or the page's end; rows with equal or null page_id each get their own row;
very long pages are read whole, and elements at any depth have their own features; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Container, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm import dom
from lexmill.llm import words as w
from lexmill.llm.html_training import LAYOUTS, labelled_pages
from lexmill.llm.tables import per_batch, typed

STEPS = 150
RATE = 0.15
DECAY = 1e-3

#: Elements that say nothing by themselves about what their text is.
PLAIN = frozenset("html body div p span ul ol li table tbody thead tr td th dl dt dd pre blockquote section h1 h2 h3 h4 h5 h6 figure figcaption".split())


def path_features(paths: dom.Paths, path: int, known: Container[str] | None = None) -> set[str]:
    """Features of a block's open elements. An element of whose names and tag none is `known` (None: all are) is not telling."""
    own, out, near = True, set(), None
    while path > 0:
        path, tag, names = paths.nodes[path]
        out.add(f"{'block' if own else 'in'}={tag}")
        if own and tag not in ("div", "body"):
            out.add(f"in={tag}")
        own = False
        out.update(f"name={x}" for x in names)
        if not near:
            near = [f for f in telling(tag, names) if known is None or f in known]
    return out | set(near or ["near="])


def telling(tag: str, names: tuple[str, ...]) -> list[str]:
    return [f"near={x}" for x in dict.fromkeys((*names, *([] if tag in PLAIN else [tag])))]


class PathScores:
    """The sum of the weights of path_features(), for each path from that of the path above it: one step a path at any depth.

    A path hands down which known features it has (a bit each), their sum, and the sum of its innermost telling element.
    """

    def __init__(self, weights: dict[str, float], paths: dom.Paths):
        self.weights, self.paths = weights, paths
        self.bits = {f: 1 << i for i, f in enumerate(x for x in weights if x.startswith(("in=", "name=")))}
        self.reset()

    def reset(self):
        self.scores, self.handed = [self.weights.get("near=", 0.0)], [(0, 0.0, self.weights.get("near=", 0.0))]

    def of(self, path: int) -> float:
        for above, tag, names in self.paths.nodes[len(self.scores) : path + 1]:
            has, total, near = self.handed[above]
            if mine := [self.weights[f] for f in telling(tag, names) if f in self.weights]:
                near = sum(mine)
            for f in names:
                has, total = self._with(f"name={f}", has, total)
            inside = self._with(f"in={tag}", has, total)
            self.handed.append((*inside, near))
            self.scores.append((total if tag in ("div", "body") else inside[1]) + self.weights.get(f"block={tag}", 0.0) + near)
        return self.scores[path]

    def _with(self, feature: str, has: int, total: float) -> tuple[int, float]:
        bit = self.bits.get(feature, 0)
        return (has, total) if not bit or has & bit else (has | bit, total + self.weights[feature])


def text_features(text: str, linked: float) -> list[str]:
    n = text.count(" ") + 1
    return [
        f"words={'1' if n < 3 else '3' if n < 6 else '6' if n < 12 else '12' if n < 30 else '30'}",
        f"linked={'0' if not linked else '1' if linked < 0.3 else '2' if linked < 0.75 else '3'}",
        f"end={'.' if text[-1] in '.!?…:;"”' else ' '}",
        *(["sign=©"] if "©" in text else []),
    ]


class ChainField:
    """Weights by feature (score of main text over other text), the start score and transitions."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, move: np.ndarray):
        self.weights, self.start, self.move = weights, start, move

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi over the blocks' scores for main text."""
        if not scores:
            return []
        (a, b), (c, d) = self.move.tolist()
        no, yes = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for s in scores[1:]:
            back.append((no + a < yes + c, no + b < yes + d))
            no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
        label = yes > no
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[bool]]], steps: int = STEPS) -> ChainField:
    """Maximise the conditional log-likelihood of the labels, all pages at once, with Adam steps."""
    paths, rows, number = dom.Paths(), [], {}
    for html, labels in pages:
        blocks = dom.leaf_blocks(html, paths)
        if len(blocks) != len(labels):
            raise ValueError("labels do not match the page's blocks")
        if blocks:
            rows.append(([[number.setdefault(f, len(number)) for f in sorted({*path_features(paths, p), *text_features(t, k)})] for p, t, k in blocks], labels))
    longest, n = max(len(y) for _, y in rows), len(rows)
    page, place, feature = (np.array(x) for x in zip(*[(i, j, f) for i, (x, _) in enumerate(rows) for j, fs in enumerate(x) for f in fs], strict=True))
    gold, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (_, y) in enumerate(rows):
        gold[i, : len(y)], live[i, : len(y)] = y, True
    pairs = live[:, 1:]
    counted = np.zeros((2, 2))
    np.add.at(counted, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    weights = np.zeros(len(number) + 6)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        score = np.zeros((n, longest, 2))
        np.add.at(score[:, :, 1], (page, place), weights[feature])
        start, move = weights[-6:-4], weights[-4:].reshape(2, 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0] + start
        for j in range(1, longest):
            ahead[:, j] = np.where(live[:, j, None], np.logaddexp(ahead[:, j - 1, 0, None] + move[0], ahead[:, j - 1, 1, None] + move[1]) + score[:, j], ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            later = behind[:, j + 1] + score[:, j + 1]
            behind[:, j] = np.where(live[:, j + 1, None], np.logaddexp(later[:, :1] + move[:, 0], later[:, 1:] + move[:, 1]), 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        chance = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        gradient = np.zeros_like(weights)
        np.add.at(gradient, feature, (gold - chance[:, :, 1])[page, place])
        gradient[-6:-4] = np.bincount(gold[:, 0], minlength=2) - chance[:, 0].sum(0)
        both = ahead[:, :-1, :, None] + move + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        gradient[-4:] = (counted - (np.exp(both) * pairs[:, :, None, None]).sum((0, 1))).ravel()
        gradient = gradient / n - DECAY * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights = weights + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return ChainField({f: float(weights[i]) for f, i in number.items()}, weights[-6:-4].copy(), weights[-4:].reshape(2, 2).copy())


@cache
def default_field(layouts: int = LAYOUTS) -> ChainField:
    return train(labelled_pages(layouts))


class Extractor:
    """Scores blocks with a field and keeps path scores between pages."""

    def __init__(self, field: ChainField):
        self.field, self.paths = field, dom.Paths()
        self.known = PathScores(field.weights, self.paths)

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        if len(self.paths.nodes) > dom.Paths.LIMIT:
            self.paths.reset()
            self.known.reset()
        blocks = dom.leaf_blocks(html, self.paths)
        weights, scores = self.field.weights, []
        for path, text, linked in blocks:
            scores.append(self.known.of(path) + sum(weights.get(f, 0.0) for f in text_features(text, linked)))
        return "\n".join(b[1] for b, main in zip(blocks, self.field.decode(scores), strict=True) if main)


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    kept: list[Extractor] = []

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        if not kept:
            kept.append(Extractor(shared.value))
        for a, b in w.chunks(batch.column("html")):
            texts = [kept[0].text(x) for x in batch.column("html").slice(a, b - a).to_pylist()]
            yield {"page_id": batch.column("page_id").slice(a, b - a), "url": batch.column("url").slice(a, b - a), "text": pa.array(texts, pa.string()), "n_chars": np.array([len(x) for x in texts], np.int64)}

    return per_batch(typed(pages, page_id="bigint", url="string", html="string"), make, "page_id long, url string, text string, n_chars long")
