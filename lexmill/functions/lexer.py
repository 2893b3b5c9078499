"""One forward pass over source text: what is code, and which brackets belong together.

Comments, quoted text, regular expressions, template text and heredocs are blanked, place by place, so that later steps see
code only. Every pattern here is tried at one place and never gives back what it took, so time grows with the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*+"
_NEXT = {
    "javascript": re.compile(rf"//|/\*|[\"'`/{{}}]|{_WORD}|\d[\w.]*+|[^\s\w]"),
    "php": re.compile(r"//|/\*|\#(?!\[)|<<<|\?>|[\"'`]"),
    "css": re.compile(r"/\*|[\"']"),
}
#: Quoted text from behind its first quote. In JavaScript and CSS a line end ends it, unless a backslash stands before.
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]++|\\.)*+{q}?", re.S) for q in "\"'"}
_QUOTED_LINES = {q: re.compile(rf"(?:[^{q}\\]++|\\.)*+{q}?", re.S) for q in "\"'`"}
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+(`|\$\{)?", re.S)
_REGEX = re.compile(r"(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/\w*+")
_HEREDOC = re.compile(r"<<<[ \t]*([\"']?)([A-Za-z_]\w*+)\1[ \t]*\r?\n")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())


@dataclass(frozen=True)
class Source:
    text: str
    code: str
    comments: list[tuple[int, int]]


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def read(text: str, language: str) -> Source:
    """The text, its code (all else is blank, line ends stay) and the places of its comments."""
    hidden: list[tuple[int, int]] = []
    comments: list[tuple[int, int]] = []
    scan, at, n = _NEXT[language], 0, len(text)
    depth, templates, before, flat = 0, [], "", 0
    lines = language == "php"
    if lines and "<?" in text:
        at = _past_html(text, 0, hidden)
    while at < n and (m := scan.search(text, at)):
        token, start, at = m[0], m.start(), m.end()
        if token in ("//", "/*") or lines and token == "#":
            if token == "/*":
                end = text.find("*/", at)
                at = n if end < 0 else end + 2
            else:
                at = _line_end(text, at)
                if lines and (tag := text.find("?>", start, at)) >= 0:
                    at = tag
            comments.append((start, at))
            hidden.append((start, at))
        elif token in _QUOTED and not lines:
            at = _QUOTED[token].match(text, at).end()
            hidden.append((start, at))
            before = "x"
        elif lines and token in _QUOTED_LINES:
            at = _QUOTED_LINES[token].match(text, at).end()
            hidden.append((start, at))
        elif token == "`" or token == "}" and templates and templates[-1] == depth:
            if token == "}":
                templates.pop()
            inside = _TEMPLATE.match(text, at)
            at = inside.end()
            hidden.append((start, at))
            if inside[1] == "${":
                templates.append(depth)
            before = "{" if inside[1] == "${" else "x"
        elif token == "/":
            ends_value = start < flat or before and (before in ")]" or before[-1].isalnum() or before[-1] in "_$") and before not in _BEFORE_REGEX
            body = None if ends_value else _REGEX.match(text, at)
            if body:
                at = body.end()
                hidden.append((start, at))
            elif not ends_value:
                flat = _line_end(text, at)  # one that its line does not end: the line's other slashes divide
            before = "x" if body else "/"
        elif token == "<<<":
            if head := _HEREDOC.match(text, start):
                close = re.compile(rf"^[ \t]*{head[2]}\b", re.M).search(text, head.end())
                at = close.end() if close else n
                hidden.append((start, at))
        elif token == "?>":
            hidden.append((start, at))
            at = _past_html(text, at, hidden)
        else:
            depth += (token == "{") - (token == "}")
            before = token
    parts, done = [], 0
    for start, end in hidden:
        parts += [text[done:start], re.sub(r"[^\n]", " ", text[start:end])]
        done = end
    return Source(text, "".join(parts) + text[done:], comments)


def _past_html(text: str, at: int, hidden: list[tuple[int, int]]) -> int:
    """Hide the page around PHP code; the place behind the next opening tag."""
    m = re.compile(r"<\?(?:php\b|=)?", re.I).search(text, at)
    end = m.end() if m else len(text)
    hidden.append((at, end))
    return end


_TOKEN = re.compile(rf"#?{_WORD}|\d[\w.]*+|=>|->|::|[^\s\w]")


def tokens(code: str) -> tuple[list[str], list[int], dict[int, int]]:
    """Tokens of code, their places, and for each opening bracket the number of the one that closes it."""
    words, places, partner, opened = [], [], {}, []
    for m in _TOKEN.finditer(code):
        t = m[0]
        if t in "([{":
            opened.append((t, len(words)))
        elif t in ")]}":
            want = {")": "(", "]": "[", "}": "{"}[t]
            # A closing brace ends what was left open inside it; other brackets never end a block.
            if t == "}":
                while opened and opened[-1][0] != "{":
                    opened.pop()
            if opened and opened[-1][0] == want:
                partner[opened.pop()[1]] = len(words)
        words.append(t)
        places.append(m.start())
    return words, places, partner


def blocks(text: str, code: str) -> list[tuple[int, int, int]]:
    """(start of the head, place of the opening brace, place of the closing one) of all closed blocks, in order of their opening
    braces. A head begins behind the last brace before it."""
    found, opened, last = [], [], 0
    for m in re.finditer(r"[{}]", code):
        at = m.start()
        if m[0] == "{":
            opened.append((last, at))
        elif opened:
            found.append((*opened.pop(), at))
        last = at + 1
    return sorted(found, key=lambda b: b[1])
