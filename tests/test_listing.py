"""Listing trees: the same files as rules over paths give, and no step into what is hidden."""

import os

from lexmill.operators import files as FI
from lexmill.sources import listing as L

RULES = [("", 1, "build.d/"), ("", 2, "*.log"), ("", 3, "!keep.log"), ("a", 1, "/x*"), ("a", 2, "b/**/z?.txt"), ("a/b", 1, "!zz.txt"), ("", 4, "# no rule"), ("", 5, "c[0-9]")]
FILES = ["a/x1", "a/y1", "a/b/z1.txt", "a/b/q/z2.txt", "a/b/q/zz.txt", "a/b/q/t.py", "build.d/f.py", "vendor/g.py", ".git/h", "k.log", "keep.log", "c1/i", "cx/i", "d/e/f/g/h.txt", "node_modules/m/n.js", ".env", "d/build.d/x.py"]


def tree(root):
    for f in FILES:
        os.makedirs(os.path.dirname(f"{root}/{f}"), exist_ok=True)
        with open(f"{root}/{f}", "w") as out:
            out.write(f)
    return [(f"{root}/{d}".rstrip("/"), n, p) for d, n, p in RULES]


def test_listing_equals_rules_over_paths(spark, tmp_path):
    root = str(tmp_path)
    rules = tree(root)
    paths = spark.createDataFrame([(f"{root}/{f}",) for f in FILES], "filename string")
    table = spark.createDataFrame(rules, "dir string, rule_no int, pattern string")
    for mode in ("reference", "git"):
        want = {r[0] for r in FI.apply_ignore_rules(paths, table, mode, skip_dirs=True).collect()}
        for partitions in (1, 4, 100):
            got = [r[0] for r in L.list_tree(spark, root, rules, mode=mode, partitions=partitions).collect()]
            assert sorted(got) == sorted(want), (mode, partitions)
    rows = {r["filename"]: bytes(r["content"]) for r in L.list_tree(spark, root, rules, content=True).collect()}
    assert rows == {f: f[len(root) + 1 :].encode() for f in {r[0] for r in FI.apply_ignore_rules(paths, table, skip_dirs=True).collect()}}


def test_hidden_directories_are_not_entered(tmp_path, monkeypatch):
    root = str(tmp_path)
    tree(root)
    (tmp_path / ".ignored").write_text("big/\n!big/in.py\n")
    for i in range(200):
        (tmp_path / "big" / f"s{i}").mkdir(parents=True)
    entered, kept = [], L.TreeReader.listed
    monkeypatch.setattr(L.TreeReader, "listed", lambda self, fs, path, rules: entered.append(path[len(root) :]) or kept(self, fs, path, rules))
    reader = L.TreeReader({"path": root, "mode": "git", "ignorename": ".ignored", "partitions": "3"})
    found = [r[0][len(root) :] for p in reader.partitions() for r in reader.read(p)]
    assert "/d/e/f/g/h.txt" in found and "/vendor/g.py" not in found and not any(f.startswith("/big") for f in found)
    assert not any(e.startswith(("/big", "/vendor", "/.git", "/node_modules")) for e in entered)


def test_missing_and_empty_roots(spark, tmp_path):
    assert L.list_tree(spark, f"{tmp_path}/none").collect() == [] and L.list_tree(spark, str(tmp_path)).collect() == []
