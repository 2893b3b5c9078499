"""The extractor at any depth, its path scores against the features themselves, and decoding against all labellings."""

import itertools
import random
import time

import numpy as np
import pytest

from lexmill.llm import dom, extraction
from lexmill.llm.html_training import labelled_page, nameless_page

ARTICLE = "<article><h1>The mill</h1><p>The water rose over the old bank and carried a boat down to the mill.</p></article>"
COMMENTS = '<div class="comments"><p>I was there too and it was a very wet day for all of us.</p></div>'


@pytest.fixture(scope="module")
def field():
    return extraction.default_field()


@pytest.mark.parametrize("depth", [1, 300, 3000])
def test_depth_does_not_change_what_a_block_is(field, depth):
    page = "<body>" + ARTICLE + "<div>" * depth + COMMENTS + "</div>" * depth + "</body>"
    assert extraction.Extractor(field).text(page).split("\n") == ["The mill", "The water rose over the old bank and carried a boat down to the mill."]


@pytest.mark.parametrize("names", [["", "", ""], [" id=x1", " id=x2", " id=x3"], [' class="qk-1"', ' class="qk-2"', ' class="zzt"']])
def test_pages_without_telling_names_keep_their_article(field, names):
    a, b, c = names
    texts = ["The day of the river", "The water rose over the old bank and carried a boat down to the mill again today.", "Nobody in the village had seen such a flood before, and many people came to look at it."]
    menu = f'<div{a}><a href="/">Home</a> <a href="/b">About</a> <a href="/c">Contact</a></div>'
    page = f"<body>{menu}<div{b}><h1>{texts[0]}</h1><p>{texts[1]}</p><p>{texts[2]}</p></div><div{c}>&copy; The mill</div></body>"
    assert extraction.Extractor(field).text(page).split("\n") == texts


def test_held_out_pages_without_names(field):
    right = 0
    for seed in range(10**6, 10**6 + 100):
        html, labels = nameless_page(seed)
        texts = [b[1] for b in dom.leaf_blocks(html, dom.Paths())]
        right += extraction.Extractor(field).text(html) == "\n".join(b for b, y in zip(texts, labels, strict=True) if y)
    assert right >= 95


@pytest.mark.parametrize("piece", ["<div>x", '<div class="a b">x', "<section><p>x"])
def test_deep_pages_take_linear_time(field, piece):
    began = time.process_time()
    extraction.Extractor(field).text(piece * ((1 << 20) // len(piece)))
    assert time.process_time() - began < 20


def test_path_scores_are_the_sums_of_path_features(field):
    paths = dom.Paths()
    scores = extraction.PathScores(field.weights, paths)
    for seed in range(2 * 10**6, 2 * 10**6 + 40):
        for path, _, _ in dom.leaf_blocks("<div><ul class='zq'><li>" * (seed % 4) + labelled_page(seed)[0], paths):
            assert scores.of(path) == pytest.approx(sum(field.weights.get(f, 0.0) for f in extraction.path_features(paths, path, field.weights)))


def test_viterbi_finds_the_best_of_all_labellings():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.gauss(0, 2) for _ in range(rng.randint(1, 8))]
        field = extraction.ChainField({}, np.array([rng.gauss(0, 1), rng.gauss(0, 1)]), np.array([[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]))

        def value(y, field=field, scores=scores):
            return field.start[y[0]] + sum(s for s, one in zip(scores, y, strict=True) if one) + sum(field.move[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert field.decode(scores) == [bool(x) for x in best]
