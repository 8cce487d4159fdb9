import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmatch.functions import similarity as sim

TEXTS = [("", ""), ("", "a b"), ("a b", ""), ("a b c", "b c d"), ("12 x", "x 12"), ("ab", "ab")]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcde é", max_size=70), st.text("abcde é", max_size=70))
def test_subsequence_is_that_of_the_plain_table(a, b):
    assert sim.common_subsequence(a, b) == plain_lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_jaro_winkler_is_bounded(a, b):
    assert 0 <= sim.jaro_winkler_pair(a, b) <= 1


def test_jaro_winkler_known_values():
    assert sim.jaro_winkler_pair("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler_pair("", "") == 0 and sim.jaro_winkler_pair("a", "b") == 0


def test_empty_cases(spark):
    df = spark.createDataFrame(TEXTS, "a string, b string").withColumns({"ta": sim.tokens("a"), "tb": sim.tokens("b")})
    rows = df.select(sim.jaccard("ta", "tb"), sim.token_overlap("ta", "tb"), sim.containment("ta", "tb"), sim.length_ratio("a", "b"), sim.lcs_ratio("a", "b"), sim.lcs_ratio("a", "b", 0.0), sim.exact_present("a", "b"), sim.exact_normalized("a", "b")).collect()
    assert tuple(rows[0]) == (1, 0, 1, 1, 1, 0, 0, 1)
    assert tuple(rows[1]) == (0,) * 8 and tuple(rows[2]) == (0,) * 8
    assert rows[3][0] == 0.5 and rows[3][1] == pytest.approx(2 / 3) and rows[3][4] == pytest.approx(0.6)
    assert rows[4][0] == 1 and rows[5][6] == 1


def test_symmetry(spark):
    df = spark.createDataFrame([("a b 1", "b c 12"), ("x", "xyz y")], "a string, b string")
    for f in (sim.lcs_ratio, sim.jaro_winkler, sim.length_ratio):
        assert all(r[0] == r[1] for r in df.select(f("a", "b"), f("b", "a")).collect())


def test_numeric_tokens(spark):
    df = spark.createDataFrame([("a12b 7 12",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(F.array_sort(sim.numeric_tokens("x"))).collect()] == [["12", "7"], [], []]
