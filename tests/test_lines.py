"""Regex search over stored trigrams against a scan."""

import pytest

from lexmill.operators import lines as L
from lexmill.operators import symbols as R

ROWS = [("class", f"class App\\Model\\C{i}") for i in range(300)] + [("method", f"C{i}::getPriceById{i % 7}") for i in range(300)] + [("function", "ab"), ("function", ""), ("function", "Größe İstanbul"), ("x", "aaa")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    L.write_lines(spark.createDataFrame(ROWS, "kind string, line string"), path)
    return path


@pytest.mark.parametrize("pattern", ["C17$", "getprice", "GETPRICE.*3$", "(Model|Price)[A-Z]", r"Model\\C1(2|3)$", "^ab$", "(abc)?C29", "(?:PriceById[35]){1,2}", "a{3}", "größe", "x*", "(get|set)PriceById", "[C]lass", "(PriceBy(Id|No)6|zzz)", "stanbul", ".*"])
def test_equals_scan(spark, stored, pattern):
    lines = spark.createDataFrame(ROWS, "kind string, line string")
    for ignore_case in (False, True):
        want = sorted(map(tuple, R.find_symbols(lines, pattern, ignore_case).collect()))
        assert sorted(map(tuple, L.find_lines(spark, stored, pattern, ignore_case).collect())) == want


def test_only_candidates_are_verified(spark, stored):
    assert L.candidates(spark, stored, "Model.*C299$").count() <= 3
    assert L.candidates(spark, stored, "[a-z]+") is None
    plan = L.candidates(spark, stored, "PriceById")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_clauses():
    assert L.clauses("abc[0-9]def") == [[["abc"]], [["def"]]] and L.clauses("(abcd|efg)x") == [[["abcd"], ["efg"]]]
    assert L.clauses("(abc)?ab") == [] and L.clauses("(") == [] and L.clauses("(abc|x)") == []
