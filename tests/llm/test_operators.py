import hashlib
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import contamination, dom, extraction, jaccard, language, licenses, mixing, quality, recompression, secrets, trigrams, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule0 string"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    out = [None, "", " \n", "a", "x " * 40, "x " * 37 + "y", "\u00c9t\u00c9 A b\u00a0c " * 9, "same same " * 30]
    for i in range(60):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t) + ("\n" if i % 3 else " ") + rng.choice(base))
    return out + base + base[:9] + ["long " + " ".join(word() for _ in range(30_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", None if i % 7 == 0 else f"s{i % 3}", 0, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "null id " * 9, "en", "s1", 0, "")], SCHEMA).repartition(5).cache()


def split(t):
    return (t or "").encode().split()


def test_recompression(docs):
    rows = sorted((r.doc_id, split(r.text)) for r in docs.where("doc_id IS NOT NULL").collect())
    first, want = {}, {None: 0}
    for i, ws in rows:
        marks = [False] * len(ws)
        for j in range(len(ws) - 12):
            if first.setdefault(tuple(ws[j : j + 13]), i) < i:
                marks[j : j + 13] = [True] * 13
        want[i] = b" ".join(x for x, m in zip(ws, marks) if not m).decode()
    got = {r.doc_id: r.kept for r in recompression.dedup_substrings(docs).collect()}
    got[None] = 0
    assert got == want


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, shingle, percent):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        ws = split(low(r.text))
        sets[r.doc_id] = {tuple(ws[j : j + shingle]) for j in range(len(ws) - shingle + 1)} if len(ws) >= shingle else {tuple(ws)} if ws else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard(docs, shingle, percent).where("doc_id IS NOT NULL").collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("bound", [0, 10**6])
def test_jaccard_in_many_small_groups(spark, monkeypatch, bound):
    for name, value in (("GROUP_SETS", 3), ("GUESTS", 2), ("HUBS", 1), ("MAX_SHARED", bound)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(7)
    text = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        t = list(text)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(t)))
    sets = [{tuple(x.split()[j : j + 3]) for j in range(58)} for _, x in rows]
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 3


def test_jaccard_with_repeated_doc_ids(spark):
    """Rows with words and one doc_id are one node; those without words stay alone."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for _ in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((rng.randrange(60), " ".join(t)))
    rows += [*rows[:5], (3, ""), (3, None), (71, "a b"), (71, "c d"), (72, "a b"), (None, rows[0][1]), (80, None)]
    sets = [{tuple(ws[j : j + 3]) for j in range(max(1, len(ws) - 2))} if (ws := (x or "").split()) else set() for _, x in rows]
    root = {i: i for i, _ in rows}
    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if None not in (i, j) and a and b and (i == j or 100 * len(a & b) >= 90 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    want = sorted((str(i), len(s), str(root[i] if s else i)) for (i, _), s in zip(rows, sets, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard(docs, 3, 90).collect()) == want
    assert len(set(root.values())) > 3


def test_contamination_by_both_ways(spark, docs):
    some = [" ".join(split(t)[3].decode() for _ in range(1)) for t in texts()[20:22]] + [b" ".join(split(t)[2:20]).decode() for t in texts()[10:30]] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(some)), "item_id long, text string")
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    grams = {}
    for i, t in enumerate(some):
        ws = word(t)
        k = min(13, len(ws))
        for j in range(len(ws) - k + 1 if ws else 0):
            grams.setdefault(tuple(ws[j : j + k]), set()).add(str(i))
    want = set()
    for r in docs.collect():
        ws, hit, items = word(r.text), set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(ws) - k + 1):
                if found := grams.get(tuple(ws[j : j + k])):
                    hit |= set(range(j, j + k))
                    items |= found
        want.add((r.doc_id, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    for bound in (10**6, 1):
        assert {tuple(r)[:6] for r in contamination.contamination(docs, bench, max_shared=bound).collect()} == want


def test_contamination_by_items_without_id(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "x " + passage[: passage.index(" w15")]), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), ("q", passage[: passage.index(" w15")])], "item_id string, text string")
    for some, names in ((bench, ["q"]), (bench.where("item_id IS NULL"), [])):
        for bound in (10**6, 1):
            got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in contamination.contamination(docs, some, max_shared=bound).collect()}
            assert got == {1: (20, len(names), names, True), 2: (15, len(names), names, True), 3: (0, 0, [], False)}


def test_quality(docs):
    for r in quality.quality(docs).join(docs, "doc_id").collect():
        text = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        often = Counter(runs)
        repeat = {k for i, g in enumerate(runs) if often[g] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.split()]
        chars, count = sum(map(len, ws)), lambda marks: len(re.findall(marks, text))
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars, r.n_symbols) == (len(ws), len(repeat), len(lines) - len(set(lines)), chars, count("[#*$%&|<>]"))
        failed = len(ws) < 50 or 2 * len(repeat) > len(ws)
        others = 10 * count("[#*$%&|<>]") > len(ws) or 3 * count("!") > len(ws) or 10 * count("[A-Z]") > 4 * count("[A-Za-z]") or not 2 * len(ws) <= chars <= 20 * len(ws) or 2 * (len(lines) - len(set(lines))) > len(lines)
        assert (r.base_failed, r.kept) == (failed, not failed and not others)


def test_cascade_order_is_greedy():
    rejects, costs = np.array([0b001, 0b011, 0b011, 0b100, 0]), np.array([[8.0, 4.0, 1.0]] * 5)
    assert quality._greedy(["a", "b", "c"], rejects, costs) == ["c", "b", "a"]
    assert quality._greedy(["a", "b"], np.zeros(0, np.int64), np.zeros((0, 2))) == ["a", "b"]


def test_secrets_and_queries(spark):
    assert trigrams.query_of("[0-9a-f]{24,}") is None
    rows = [(1, "é token = 'abcdef1' AKIA" + "A" * 16), (2, None), (3, ""), (4, "secret=token:abcdefg"), (5, "PASSWORD:" + "0" * 30)]
    got = {r.doc_id: r.spans for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "assign:2:18,access:20:40", 2: "", 3: "", 4: "", 5: "assign:0:39,hex:9:39"}


def test_secret_spans_reach_the_end(spark):
    key = "\n".join(["MIIEvQIBADANBgkq/+" * 3] * 9)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    url = lambda user, password: f"go https://{user}:{password}@host/x"
    long = "Aa0" * 120
    texts = [f"a\n{begin}\n{key}\n{end}\nb", f"a {begin}\n{key}", f"{begin}\n{key}\n{end} c {begin}\n{key}\n{end}", url("me", "p" * 93), url("u" * 70, long), f"x ghp_{long} y", "no key: -----END RSA PRIVATE KEY-----"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secrets.redact(docs).orderBy("doc_id").collect()]
    assert got == ["a\n[SECRET]\nb", "a [SECRET]", "[SECRET] c [SECRET]", "go https[SECRET]host/x", "go https[SECRET]host/x", "x [SECRET] y", texts[6]]
    queries = {r.kind: trigrams.query_of(r.pattern) for r in secrets.RULES}
    assert queries["pem"] is not None and queries["github"] is not None


def test_extraction(spark):
    html = "<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One   two<br>three four five six.<script>var t='</p>'</script><p>More of the text is here.</article><footer>&copy; x</footer>"
    got = [tuple(r) for r in extraction.extract(spark.createDataFrame([(1, "u", html), (2, None, None), (3, "", "")], "page_id long, url string, html string")).collect()]
    text = "T & U\nOne two three four five six.\nMore of the text is here."
    assert sorted(got) == sorted([(1, "u", text, len(text)), (2, None, "", 0), (3, "", "", 0)], key=lambda x: x[0])
    assert unescape("&amp;") == "&"


def test_all_names_of_an_element_count():
    names = " ".join(f"utility{chr(97 + i)}" for i in range(14))
    paths = dom.Paths()
    node = paths.nodes[paths.below(0, "div", f'class="{names}" id="pageSidebar"')]
    assert node[2][-2:] == ("page", "sidebar") and len(node[2]) == 16


def test_language(spark):
    rows = [(i, t, x, "lang") for i in range(80) for t, x in [("the cat and the dog are in the house" if i % 2 else "der hund und die katze sind im haus", "en" if i % 2 else "de")]]
    got = language.identify(spark.createDataFrame([*rows, (900, None, "en", ""), (901, "12 !!", "en", "")], "doc_id long, text string, lang string, slot string")).collect()
    assert all(r.lang_pred == ("und" if r.doc_id >= 900 else "en" if r.doc_id % 2 else "de") for r in got)


def test_every_language_is_learned(spark):
    assert language.shares({"a": 1000, "b": 10, "c": 1000}, 110) == {"a": 0.05, "b": 1.0, "c": 0.05}
    said = {"en": "the cat and the dog are in the house", "de": "der hund und die katze sind im haus", "xx": "zyqqu wovvu jikku pyzzu"}
    rows = [(i, said[x], x) for i in range(4000) for x in ["xx" if i in (3000, 3001, 3002, 3003, 3004, 3005, 3006) else "en" if i % 10 else "de"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound in (2, 60, 100_000):
        model = language.fit(docs, max_rows=bound)
        assert model.languages == ["de", "en", "xx"] and model.commonest == "en"
        assert {(r.lang_pred, r.lang) for r in language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select("lang_pred", "lang").distinct().collect()} == {(x, x) for x in said}


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].target <= 3 * own[0].source_size
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_licenses_and_warc(spark):
    rows = spark.createDataFrame([(1, "Foo. Released under the MIT License.\nAll rights reserved."), (2, None)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in licenses.licenses(rows).orderBy("doc_id").collect()] == [(2, "mit_ref all_rights", "MIT,Proprietary", 0), (0, "", "", 0)]
    assert all(any(k in s for k in licenses.KEYWORDS) for s in licenses.SENTENCES)
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(600)] + [(None, None, None)], "page_id long, url string, html string")
    assert warc.audit(pages, pages).count() == 0
    bad = warc.audit(pages, pages.where("page_id <> 7 OR page_id IS NULL").withColumn("html", F.when(F.col("page_id") == 300, "?").otherwise(F.col("html")))).collect()
    assert sorted((r.page_id, r.status) for r in bad) == [(7, "missing"), (300, "altered")]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""
BSD = """Copyright (c) 2020, Foo
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
{} Redistributions of source code must retain the above copyright notice, this list of conditions and the
   following disclaimer.
{} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
   following disclaimer in the documentation and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
APACHE = """Copyright 2020 Foo

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_wrapped_licences(spark):
    bsd = "all_rights bsd_grant bsd_source bsd_binary"
    want = [
        (MIT, "mit_grant mit_notice", "MIT"),
        *[(BSD.format(*marks), bsd, "BSD-2-Clause,Proprietary") for marks in (("1.", "2."), ("*", "*"), ("(1)", "(2)"), ("a)", "b)"))],
        (GPL, "gpl3_grant gpl_no_warranty", "GPL-3.0-or-later"),
        (APACHE, "apache2_ref apache2_compliance apache2_url", "Apache-2.0"),
        (MPL, "mpl2_ref", "MPL-2.0"),
        ("A line\nReleased under the MIT License\nand more", "mit_ref", "MIT"),
        ("All rights.\nReserved", "", ""),
        ("All rights\n\nreserved", "", ""),
    ]
    lead = lambda mark: lambda t: "\n".join(mark + x for x in t.split("\n"))
    forms = [str, lead("# "), lead("// "), lambda t: "/*\n" + lead(" * ")(t) + "\n */", lambda t: t.replace("\n", "\r\n"), lead("dnl ")]
    rows = [(i, form(text), *rest) for i, (form, (text, *rest)) in enumerate((f, x) for f in forms for x in want)]
    one_line = ((MIT, *want[0][1:]), (GPL, *want[5][1:]), (MPL, *want[7][1:]), (APACHE[20:].replace("2.0\n\nUnless", "2.0. Unless"), *want[6][1:]))
    rows += [(900 + i, " ".join(text.split()), *rest) for i, (text, *rest) in enumerate(one_line)]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.licenses(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    assert got == {i: (ids, names) for i, _, ids, names in rows}


def test_licence_gate_is_lossless(spark):
    texts = ["All rights reserved", "All Rights-Reserved", "All rights\treserved", "All rights\u00a0reserved.", "Foo.\nAll  rights\n# reserved", "This work is dedicated to the public-domain."]
    got = [r.licences for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["Proprietary"] * 5 + ["Public-Domain"]
    assert all(any(h in word for h in licenses.HINTS for word in s.split()) for s in licenses.SENTENCES)
