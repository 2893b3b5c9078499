"""Labelled pages for the extractor's random field, made from layouts.

A page is a sequence of parts; each part is a container with marked blocks of text. The containers, their class
names and the nesting vary with a seed. LAYOUTS bounds the number of pages (with a quarter more without names), so training has a fixed size.
"""

from __future__ import annotations

import random

LAYOUTS = 600

#: Usual containers (tag, class or id words) of main text and of what surrounds it.
CONTENT = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"), ("div", "post"), ("div", "article"), ("div", "entry"), ("div", "page-content"), ("section", "body"), ("div", "entry-content"), ("div", "article-body"), ("section", "story"), ("div", "main-content"), ("td", "content"), ("div", "text"), ("section", ""), ("div", "")]
AROUND = {
    "menu": [("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "navbar"), ("div", "nav"), ("div", "navigation"), ("div", "breadcrumb"), ("div", "breadcrumbs"), ("div", "pagination"), ("div", "topbar"), ("menu", "")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "page-header"), ("div", "logo")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "legal")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "related-posts"), ("div", "recommended"), ("div", "trending"), ("div", "share"), ("div", "social"), ("div", "tags"), ("div", "author-bio"), ("div", "read-more"), ("div", "teaser")],
    "notice": [("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("dialog", ""), ("div", "modal"), ("div", "popup"), ("div", "gdpr"), ("section", "notice"), ("div", "paywall"), ("noscript", ""), ("div", "disclaimer"), ("div", "warning")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "banner"), ("aside", "ad"), ("div", "sponsored"), ("div", "promo"), ("section", "promotion"), ("div", "adsense"), ("div", "sponsor")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "newsletter"), ("div", "subscribe"), ("div", "signup"), ("div", "login"), ("div", "search"), ("fieldset", "")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "responses"), ("section", "reader-comments"), ("div", "discussion"), ("div", "disqus"), ("div", "replies"), ("div", "comment")],
}


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice("bcdfghlmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice("....!?")


def _name(rng: random.Random, words: str) -> str:
    if not words:
        return ""
    words += rng.choice(["", "", "", " box", " inner", " wrap", " container", " slot", " unit", " block", " x"])
    return f' {rng.choice(["class", "class", "id"])}="{words}"'


def _around(rng: random.Random, kind: str) -> tuple[str, list[bool]]:
    tag, words = rng.choice(AROUND[kind])
    out, labels = [f"<{tag}{_name(rng, words)}>"], []
    for _ in range(rng.randint(1, 4)):
        labels.append(False)
        link = kind in ("menu", "header") or (kind in ("footer", "side") and rng.random() < 0.6)
        if link:
            text = f'<a href="/x">{_sentence(rng, 1, 4)[:-1]}</a>'
        elif kind in ("comments", "ad", "notice", "side", "footer"):
            text = ("&copy; " if kind == "footer" and rng.random() < 0.6 else "") + _sentence(rng, 3, 40)
        else:
            text = _sentence(rng, 1, 12)
        inner = rng.choice({"menu": ["li", "li", "div"], "form": ["label", "button", "p", "div"], "header": ["div", "h1", "p", "h2"]}.get(kind, ["p", "div", "li", "p", "h3"]))
        out.append(f"<{inner}>{text}</{inner}>")
    return "".join(out) + f"</{tag}>", labels


def labelled_page(seed: int) -> tuple[str, list[bool]]:
    """A page and for each of its leaf blocks whether it belongs to the main text."""
    rng = random.Random(seed)
    parts = [_around(rng, k) for k in rng.sample(["menu", "header", "ad", "notice", "form", "side"], rng.randint(0, 5))]
    tag, words = rng.choice(CONTENT)
    body, labels = [f"<{tag}{_name(rng, words)}>"], []
    if rng.random() < 0.8:
        head = f"<h1>{_sentence(rng, 3, 12)[:-1]}</h1>"
        body.append(f"<header>{head}</header>" if tag == "article" and rng.random() < 0.15 else head)
        labels.append(True)
    for _ in range(rng.randint(1, 10)):
        if rng.random() < 0.25:
            html, own = _around(rng, rng.choice(["ad", "side", "form", "notice", "comments"]))
            body.append(html)
            labels += own
            continue
        inner = rng.choice(["p"] * 8 + ["h2", "li", "blockquote", "pre", "div", "h3", "td", "figcaption", "dd"])
        text = _sentence(rng, 1, 6) if inner in ("h2", "h3") or rng.random() < 0.3 else _sentence(rng, 5, 80)
        if rng.random() < 0.15:
            text += f' <a href="/y">{_sentence(rng, 1, 5)}</a>'
        wrap = {"li": ("<ul><li>", "</li></ul>"), "td": ("<table><tr><td>", "</td></tr></table>"), "figcaption": ("<figure><figcaption>", "</figcaption></figure>"), "dd": ("<dl><dd>", "</dd></dl>")}.get(inner, (f"<{inner}>", f"</{inner}>"))
        body.append(wrap[0] + text + wrap[1])
        labels.append(True)
    if rng.random() < 0.3:
        html, own = _around(rng, "comments")
        body.append(html)
        labels += own
    parts.append(("".join(body) + f"</{tag}>", labels))
    parts += [_around(rng, k) for k in rng.sample(["comments", "footer", "side", "ad", "menu", "form", "notice"], rng.randint(0, 4))]
    if rng.random() < 0.3:
        parts = [(f'<div class="{rng.choice(["wrapper", "page", "container", "site", "row"])}">' + "".join(p[0] for p in parts) + "</div>", sum((p[1] for p in parts), []))]
    title = _sentence(rng, 2, 9)
    return f"<html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>" + "".join(p[0] for p in parts) + "</body></html>", [False, *sum((p[1] for p in parts), [])]


def nameless_page(seed: int) -> tuple[str, list[bool]]:
    """A page whose containers are plain and tell nothing: only its texts, links and their order do."""
    rng = random.Random(f"nameless {seed}")
    box = lambda inner: f'<div id="{rng.randint(1, 99)}">{inner}</div>' if rng.random() < 0.7 else f"<div>{inner}</div>"
    links = lambda: "".join(f'<a href="/{i}">{_sentence(rng, 1, 3)[:-1]}</a> ' for i in range(rng.randint(2, 6)))
    short = lambda: ("&copy; " if rng.random() < 0.4 else "") + _sentence(rng, 1, 5)[:-1]
    before, after = ([rng.choice([links, links, short])() for _ in range(rng.randint(0, 3))] for _ in range(2))
    body, labels = [], []
    for _ in range(rng.randint(1, 6)):
        if not body and rng.random() < 0.8 or body and rng.random() < 0.15:
            body.append(f"<h{min(len(body) + 1, 3)}>{_sentence(rng, 2, 9)[:-1]}</h{min(len(body) + 1, 3)}>")
            labels.append(True)
        body.append(f"<p>{_sentence(rng, 12, 80)}</p>")
        labels.append(True)
    parts = "".join(map(box, before)) + box("".join(body)) + "".join(map(box, after))
    page = f"<html><head><title>{_sentence(rng, 2, 9)}</title></head><body>{parts}</body></html>"
    return page, [False, *[False] * len(before), *labels, *[False] * len(after)]


def labelled_pages(n: int = LAYOUTS) -> list[tuple[str, list[bool]]]:
    """`n` pages of named containers and a quarter as many without names."""
    return [labelled_page(seed) for seed in range(n)] + [nameless_page(seed) for seed in range(n // 4)]
