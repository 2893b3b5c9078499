"""Leaf blocks of an HTML page: runs of text between block-level tags, with their open elements.

A small tolerant reader, run inside Spark tasks, one page at a time. Comments, scripts, styles and the like are
dropped; character references are decoded; white space in a block becomes one space. `<br>` is white space.

The reader goes forward only, so its time follows the page's length whatever the markup. A tag ends at the next `>`
outside quotes; one that a new tag interrupts is dropped up to there, one that the page's end interrupts is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

RAW = ("script", "style", "template", "iframe", "svg", "object", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video audio".split()
)
#: What an opening tag closes, and up to which open element it looks for it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_HOLDS_P = frozenset("article aside blockquote body button dd div fieldset figure footer form header li main nav section table td th".split())

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_IN_TAG = re.compile("[<>\"']")
_NEW_TAG = re.compile("[a-zA-Z/!]")
_RAW_END = {x: re.compile(rf"</{x}\b[^<>]*>", re.I) for x in RAW}
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile("[a-z]{2,}")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")


class Paths:
    """Open-element paths as numbers: path -> (path above, tag, name parts). Reset when it grows."""

    LIMIT = 20_000

    def __init__(self):
        self.reset()

    def reset(self):
        self.nodes: list[tuple[int, str, tuple[str, ...]]] = [(-1, "", ())]
        self.number: dict[tuple[int, str, tuple[str, ...]], int] = {}
        self.names: dict[str, tuple[str, ...]] = {}

    def below(self, path: int, tag: str, attributes: str) -> int:
        parts: tuple[str, ...] = ()
        if "=" in attributes:
            if attributes not in self.names:
                found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
                self.names[attributes] = tuple(dict.fromkeys(_LETTERS.findall(_CAMEL.sub(" ", found).lower())))
            parts = self.names[attributes]
        key = (path, tag, parts)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
        return self.number[key]


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), ("open" or "close", tag, attributes) of a page, in order."""
    at, n, no_more = 0, len(html), set()

    def tag_end(place: int) -> tuple[int, int]:
        """Where the tag's attributes and the tag itself end."""
        while m := _IN_TAG.search(html, place):
            place = m.end()
            sign = m[0]
            if sign == ">":
                return m.start(), place
            if sign == "<":
                if _NEW_TAG.match(html, place):
                    return m.start(), m.start()
            elif sign not in no_more:
                end = html.find(sign, place)
                if end < 0:
                    no_more.add(sign)
                else:
                    place = end + 1
        return n, n

    while at < n:
        place = html.find("<", at)
        if place < 0:
            yield "", "", html[at:]
            return
        if place > at:
            yield "", "", html[at:place]
        if html.startswith("<!--", place):
            end = html.find("-->", place + 4)
            at = n if end < 0 else end + 3
        elif html[place + 1 : place + 2] in ("!", "?"):
            end = html.find(">", place)
            at = n if end < 0 else end + 1
        elif m := _TAG.match(html, place + 1):
            tag = m[2].lower()
            inner, at = tag_end(m.end())
            if at == inner:
                continue
            attributes = html[m.end() : inner]
            if tag in _RAW_END and not m[1]:
                if not attributes.endswith("/"):
                    end = _RAW_END[tag].search(html, at)
                    at = end.end() if end else n
            else:
                yield "close" if m[1] else "open", tag, attributes
        else:
            yield "", "", "<"
            at = place + 1


def leaf_blocks(html: str, paths: Paths) -> list[tuple[int, str, float]]:
    """(path, text, share of the text inside links) of each non-empty leaf block, in page order."""
    out: list[tuple[int, str, float]] = []
    pieces: list[str] = []
    opened: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    linked, in_link, at = 0, 0, 0

    def flush():
        nonlocal linked
        if pieces:
            raw = " ".join("".join(pieces).split())
            if raw:
                out.append((opened[-1][1] if opened else 0, raw, min(1.0, linked / len(raw))))
            pieces.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        text = unescape(text) if "&" in text else text
        pieces.append(text)
        if in_link:
            linked += len(text)

    def close(which, bars=()):
        if not any(count.get(x) for x in which):
            return
        for i in range(len(opened) - 1, -1, -1):
            if opened[i][0] in which:
                for x, _ in opened[i:]:
                    count[x] -= 1
                del opened[i:]
                return
            if opened[i][0] in bars:
                return

    for kind, tag, rest in tokens(html):
        if not kind:
            add(rest)
        elif tag == "a":
            in_link = 1 if kind == "open" else 0
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            flush()
            if kind == "close":
                close({tag})
                if tag in _HOLDS_P:
                    in_link = 0
            elif tag not in VOID:
                close({"p"}, _HOLDS_P)
                if tag in _ENDS:
                    close(*_ENDS[tag])
                if not rest.endswith("/"):
                    above = opened[-1][1] if opened else 0
                    opened.append((tag, paths.below(above, tag, rest)))
                    count[tag] = count.get(tag, 0) + 1
    flush()
    return out
