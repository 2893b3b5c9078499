from lexmill.operators import lines as L
from lexmill.operators import symbols as R

LINES = "kind string, line string"


def test_trigrams_are_listed_by_block(spark, tmp_path):
    """A trigram that all lines have is a few rows, not a row a line."""
    rows = [("class", f"class App\\C{i}") for i in range(6000)] + [("trait", f"trait T{i}x") for i in range(500)] + [("x", None), ("x", "ab")]
    lines = spark.createDataFrame(rows, LINES)
    L.write_lines(lines, str(tmp_path))
    grams = spark.read.parquet(f"{tmp_path}/grams")
    assert grams.where("gram = 'cla'").count() < 100 and grams.count() < 6000 * 8
    for pattern in ("(class|trait) .*[ct][0-9]*1x?$", "class.*App.*C59", "trait T49.x", "zzz|class"):
        want = sorted(map(tuple, R.find_symbols(lines, pattern, True).collect()))
        assert sorted(map(tuple, L.find_lines(spark, str(tmp_path), pattern, True).collect())) == want


def test_lines_of_several_blocks(spark):
    """Places are those in the line's own block, also where one batch has lines of two."""
    rows = [(L.BLOCK - 1, "abcd"), (L.BLOCK, "abc"), (5 * L.BLOCK + 7, "xabcd")]
    got = L.block_grams(spark.createDataFrame(rows, "line_id long, line string").coalesce(1))
    found = {(r["gram"], r["block"] * L.BLOCK + p) for r in got.collect() for p in r["held"]}
    assert found == {(t[i : i + 3], n) for n, t in rows for i in range(len(t) - 2)}
