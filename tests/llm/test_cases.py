"""Defined cases of all operators: words of one weak hash, repeated rows, clashing columns, empty tables, long texts."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexmill.llm import contamination, dom, extraction, jaccard, language, licenses, mixing, quality, recompression, secrets, warc
from lexmill.llm import words as w
from lexmill.llm.html_training import labelled_page

CLASHES = ("version", "cuts", "key", "symbols", "symbol", "signatures", "signature", "frequent", "salt", "row_id", "found", "items", "size", "bucket", "nth", "order", "target", "row", "check", "mix_key", "component_id", "held_out", "rule0", "left", "n")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, repeated and null doc_ids, copies, null and empty texts."""
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(10, 120)) for _ in range(12)]
    rows = [(i % 9, t) for i, t in enumerate(texts)] + [(i + 20, texts[i % 4]) for i in range(6)] + [(3, texts[7]), (3, texts[7]), (None, texts[1]), (None, None), (5, ""), (5, None), (40, " \n ")]
    rows += [(41, f"{texts[2]} token=abcdef123"), (42, "All rights reserved."), *[(43, texts[0])] * 3]
    full = [(i, t, ("en", "de", None)[k % 3], (None, "s1", "s0")[k % 3], 0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark, docs):
    return spark.createDataFrame([("a", docs.where("doc_id = 2").first().text), ("b", None), (None, "z")], "item_id string, text string")


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_one_polynomial_hash_differ(spark):
    one, rest = thue_morse(1024), " ".join(f"w{i}" for i in range(12))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in recompression.dedup_substrings(docs).collect()] == [0, 0]
    assert {r.component_id for r in jaccard.jaccard(docs, 3, 90).collect()} == {1, 2}
    item = spark.createDataFrame([("q", f"{one} {rest}")], "item_id string, text string")
    for bound in (10**6, 0):
        assert {r.doc_id: r.n_hit for r in contamination.contamination(docs, item, max_shared=bound).collect()} == {1: 13, 2: 0}
    assert quality.quality(spark.createDataFrame([(1, f"{one} a b {two} a b")], "doc_id long, text string")).first().n_repeat_words == 0


def test_word_hashes():
    rng = random.Random(1)
    words = {"".join(rng.choice("ab\u00e9\u4e2d\x00") for _ in range(n)) for n in (*range(1, 20), 40, 300) for _ in range(40)}
    found = w.find_words(pa.array([" ".join(sorted(words)), None, "x " * 3]))
    pairs = set(zip(found.hash.tolist(), found.hash2.tolist(), strict=True))
    assert len(pairs) == len(words | {"x"}) == len(set(found.hash.tolist())) and found.counts.tolist() == [len(words), 0, 3]
    kept = found.take(np.array([False, True, True]))
    again = w.find_words(pa.array([None, "x " * 3]))
    assert all(np.array_equal(getattr(kept, c), getattr(again, c)) for c in ("data", "offsets", "start", "end", "hash", "hash2", "first"))


def test_clashing_columns_change_nothing(spark, docs, bench):
    clashing = docs.withColumns({c: F.lit("clash") for c in CLASHES})
    makes = [recompression.dedup_substrings, jaccard.jaccard, secrets.secrets, lambda d: contamination.contamination(d, bench), quality.quality, language.identify, licenses.licenses, mixing.mix]
    for make in makes:
        want, got = (Counter(map(str, make(d).collect())) for d in (docs, clashing))
        assert want == got and sum(want.values()) == docs.count()
    # Which of several rows of one doc_id stays may follow all columns.
    one_of_each = [pipeline.near_duplicates(spark, d, "").select("doc_id").collect() for d in (docs, clashing)]
    assert Counter(one_of_each[0]) == Counter(one_of_each[1])
    keeping = [lambda d: contamination.clean(d, bench), lambda d: contamination.clean(d, bench, max_shared=0), quality.passing, secrets.redact, mixing.mixed_documents]
    for make in keeping:
        plain, out = make(docs), make(clashing)
        assert set(clashing.columns) <= set(out.columns)
        assert Counter(map(str, plain.select(docs.columns).collect())) == Counter(map(str, out.select(docs.columns).collect()))
        assert {r[0] for r in out.select("row").collect()} <= {"clash"}


def test_mixed_documents_have_the_numbers_of_the_mix(spark, docs):
    few = docs.unionByName(docs.where("doc_id IN (1, 3, 43)")).unionByName(docs.where("doc_id = 43"))
    want, got = (Counter(tuple(r) for r in make(few).select("doc_id", "source", *mixing.MIXED).collect()) for make in (mixing.mix, mixing.mixed_documents))
    assert want == got and sum(want.values()) == few.count()
    texts = [Counter((r.doc_id, r.source, r.text) for r in d.collect()) for d in (few, mixing.mixed_documents(few))]
    assert texts[0] == texts[1]


def test_empty_tables(spark, docs, bench, tmp_path):
    none = docs.limit(0)
    for make in (recompression.dedup_substrings, jaccard.jaccard, quality.quality, secrets.secrets, licenses.licenses, mixing.mix, language.identify, mixing.pieces, lambda d: contamination.contamination(d, bench)):
        assert make(none).count() == 0
    clean = contamination.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r.contaminated for r in clean)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract(pages).count() == 0 and warc.audit(pages, pages).count() == 0
    for name, df in (("documents", none), ("benchmark", bench.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_audit_of_odd_records(spark):
    schema = "page_id long, url string, html string"
    left = [(1, "u", "a"), (2, "u", "b"), (2, "u", "b"), (3, "u", None), (None, "u", "x"), (None, "u", "y"), (None, None, None), (70_000, "u", "z")]
    right = [(1, "u", "a"), (2, "u", "b"), (3, "u", ""), (None, "u", "x"), (None, None, None), (9, "u", "new"), (70_000, "u", "z")]
    found = lambda a, b: sorted((str(r.page_id), r.status) for r in warc.audit(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    assert found(left, right) == [("2", "altered"), ("9", "extra"), ("None", "missing")]
    assert found(left, list(reversed(left))) == []
    assert found(left[:3], []) == [("1", "missing"), ("2", "missing")] and found([], right[:2]) == [("1", "extra"), ("2", "extra")]


def test_secrets_equal_a_full_scan(spark):
    rng = random.Random(4)
    planted = ["token=abcdef1", "API_KEY: 'x/y+z=12345'", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "ghp_" + "a1" * 20, "xoxb-1234567890-a", "AIza" + "b" * 35, "sk_live_" + "c" * 20, "npm_" + "d" * 36, "eyJabcdefgh.eyJabcdefgh.abcdefgh", "-----BEGIN PRIVATE KEY-----\nxx\n-----END PRIVATE KEY-----", "https://u:pass@h/", "password", "secret=abc", "AKIA12"]
    texts = [" ".join(rng.choice([prose(rng, 3), rng.choice(planted)]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    want = {}
    for i, text in enumerate(texts):
        spans = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least]
        want[i] = ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans))
    got = {r.doc_id: r.spans for r in secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want and len({x.split(":")[0] for v in want.values() for x in v.split(",")} - {""}) == len(secrets.RULES)


def test_held_out_languages(spark):
    rng = random.Random(6)
    letters = {"aa": "aeiouklmn", "bb": "aeounrst", "cc": "\u0430\u0435\u0438\u043e\u0443\u043a\u043b\u043c", "dd": "aeioubcdfg"}
    made = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(150)] for x, a in letters.items()}
    rows = [(i, " ".join(rng.choice(made[x]) for _ in range(rng.randint(5, 40))), x) for i in range(1200) for x in [rng.choice(list(made))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    # The answer does not depend on the labels of held-out rows.
    blind = docs.withColumn("lang", F.when(~language.held_out("doc_id"), F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in language.identify(blind).where("held_out").collect()} == {(r.doc_id, r.lang_pred) for r in got}


def test_filter_has_no_false_negatives_and_corrects_false_positives():
    grams = np.arange(5000, dtype=np.uint64)
    planes = np.zeros((1, language.SLOTS), np.uint64)
    for s in language._slots(grams[:2500]):
        planes[0, s] |= np.uint64(1)
    mask = planes[0][language._slots(grams)[0]] & planes[0][language._slots(grams)[1]]
    model = language.LanguageFilter(["x"], planes, "x")
    assert mask[:2500].all() and abs(mask[2500:].mean() - model.false_rate[0]) < 0.01


def test_extraction_of_held_out_pages():
    extractor, right, total = extraction.Extractor(extraction.default_field()), 0, 0
    for seed in range(10**6, 10**6 + 150):
        html, labels = labelled_page(seed)
        blocks = [b[1] for b in dom.leaf_blocks(html, dom.Paths())]
        want = "\n".join(b for b, y in zip(blocks, labels, strict=True) if y)
        right, total = right + (extractor.text(html) == want), total + 1
    assert right >= 0.93 * total


@pytest.mark.parametrize("bad", ["<a ", '<p class="', "<!-- ", "<script>", "<div><p>x", '<a "', "<ul><li>", "</p", "&"])
def test_broken_pages_take_linear_time(bad):
    began = time.process_time()
    blocks = dom.leaf_blocks(bad * (1_000_000 // len(bad)), dom.Paths())
    assert time.process_time() - began < 20 and not any("<" in b[1] for b in blocks)


def test_unclosed_tags_are_dropped():
    text = lambda html: [b[1] for b in dom.leaf_blocks(html, dom.Paths())]
    assert text('a<p class="x') == ["a"] and text("a <p class=q <b>d</b> 1 < 2") == ["a d 1 < 2"] and text('<p title="1>2">c') == ["c"]


def golden(slots):
    """Slot -> place of its point among all, in order: i * g mod S."""
    step, _ = mixing._step(slots)
    return [i * step % slots for i in range(slots)]


def test_schedule_and_pieces(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 300])), rng.choice([None, "a", "a", "a", "b", "c", "d"])) for i in range(150)] + [(7, "q r s", "tiny")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values())
    stopped = set()
    while True:  # water filling
        level = (total - sum(3 * size[s] for s in stopped)) / sum(weight[s] for s in names if s not in stopped)
        more = {s for s in names if s not in stopped and 3 * size[s] <= level * weight[s]}
        if not more:
            break
        stopped |= more
    goal = {s: 3.0 * size[s] if s in stopped else level * weight[s] for s in names}
    block = 50
    mixed = mixing.mix(docs, block).collect()
    for s in names:
        own = [r for r in mixed if r.source == s]
        assert all(abs(r.target - goal[s]) < 1e-6 and r.source_size == size[s] and r.taken <= 3 * r.size for r in own)
        assert sum(r.taken for r in own) == round(goal[s])
    # Slots: golden-ratio points through the cumulative numbers of blocks, sources in the order of their keys.
    quota = {s: -(-round(goal[s]) // block) for s in sorted(names, key=lambda s: "-" if s is None else "+" + s)}
    owner = [s for s, n in quota.items() for _ in range(n)]
    want = [owner[p] for p in golden(len(owner))]
    parts = sorted(mixing.pieces(docs, block).collect(), key=lambda r: (r.slot, r.place))
    assert all(want[r.slot] == r.source for r in parts) and {r.slot for r in parts} == set(range(len(want)))
    seen = Counter()
    for i, s in enumerate(want, 1):
        seen[s] += 1
        assert all(abs(seen[x] - i * quota[x] / len(want)) < 4 for x in quota)
    # The pieces of a source, in order, are its whole documents over and over, cut at the target.
    for s in names:
        own = [r for r in parts if r.source == s]
        assert sum(r.n for r in own) == round(goal[s])
        filled = Counter()
        for r in own:
            assert r.place == filled[r.slot]
            filled[r.slot] += r.n
        assert sorted(filled.values())[1:] == [block] * (len(filled) - 1)
        at = 0
        for r, after in zip(own, own[1:], strict=False):
            assert r.from_word == at
            at = at + r.n if r.doc_id == after.doc_id and after.from_word else 0
    first = {}
    for r in parts:
        first.setdefault(r.doc_id, r.slot)
    assert all(r.first_slot == first[r.doc_id] for r in mixed if r.taken and r.doc_id != 7)


def test_one_source_and_many_sources(spark):
    docs = spark.createDataFrame([(i, "a b c", f"host{i}") for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, 2).collect()
    assert {r.source: r.target for r in rows} == {s: 300 * 3 * (k % 3 + 1) / 600 for k, s in enumerate(sorted(f"host{i}" for i in range(300)))}
    one = mixing.mix(docs.withColumn("source", F.lit("s"))).collect()
    assert all(r.taken == r.size == 3 and r.target == 900 for r in one)


def test_a_very_long_text(spark):
    text = "word " * 600_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in recompression.dedup_substrings(docs).collect()} == {1: (600_001, 0), 2: (600_002, 600_001), 3: (1, 0)}
    assert {r.doc_id: r.n_repeat_words for r in quality.quality(docs).collect()} == {1: 600_000, 2: 600_000, 3: 0}
    assert all(r.spans == "" for r in secrets.secrets(docs).collect())
