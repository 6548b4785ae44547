import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.functions import lexical, scalars


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def similarity(spark, a, b, name="renamed"):
    from echofold.operators.judge import detectors

    d = detectors()[name]
    rows = d.prepare(spark.createDataFrame([(0, a), (1, b)], "id int, text string"))
    pair = spark.createDataFrame([(0, 1)], "l int, r int")
    from echofold.operators.judge import paired

    return d.judge(paired(pair, rows)).first()


def test_tokens_follow_the_pattern(spark):
    text = "if (x1 >= 3.5) { s = \"a 'b'\"; t = 'c' } é"
    assert one(spark, lexical.tokens(F.col("t")), t=text) == re.findall(lexical.TOKEN_PATTERN, text)


def test_keywords_come_before_identifiers(spark):
    got = one(spark, lexical.normalized(lexical.tokens(F.col("t"))), t="True foo 12 'x' <")
    assert got == ["true", "ID", "LIT", "LIT", "<"]
    assert len(lexical.KEYWORDS) == len(set(lexical.KEYWORDS)) == 55


@pytest.mark.parametrize(("n", "width", "want"), [(2, 4, 1), (0, 4, 0), (5, 4, 2), (4, 4, 1)])
def test_shingle_counts(spark, n, width, want):
    got = one(spark, lexical.shingles(lexical.tokens(F.col("t")), width), t=" ".join(f"t{i}" for i in range(n)))
    assert len(got) == want


def test_shingles_are_distinct(spark):
    assert one(spark, lexical.shingles(lexical.tokens(F.col("t")), 2), t="a b a b") == ["a b", "b a"]


def test_jaccard_of_empty_sets(spark):
    assert one(spark, lexical.structural_similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, lexical.structural_similarity(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_renaming_keeps_similarity(spark):
    r = similarity(spark, "def f(a, b):\n  return a + b", "def g(x, y):\n  return x + y")
    assert (r["structural"], r["verdict"], r["advice"]["recommended"]) == (1.0, "duplicate", False)


def test_operand_order_matters_when_renamed_only(spark):
    a, b = "a - b", "b - a"
    assert one(spark, lexical.renamed(lexical.tokens(F.col("t"))), t=f"sort(a, b) {a}") != one(spark, lexical.renamed(lexical.tokens(F.col("t"))), t=f"sort(a, b) {b}")
    assert similarity(spark, f"f(a, b) {a}", f"f(a, b) {b}", "flat")["structural"] == 1.0


def test_operators_are_kept(spark):
    for a, b in (("lo <= v", "lo < v"), ("a ?? b", "a || b"), ("a === b", "a == b"), ("return True", "return False")):
        assert similarity(spark, a, b)["structural"] < 1.0


def test_later_names_are_not_numbered(spark):
    got = one(spark, lexical.renamed(lexical.tokens(F.col("t"))), t=" ".join(f"n{i}" for i in range(14)) + " n0")
    assert got == [f"ID{i}" for i in range(12)] + ["ID", "ID", "ID0"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("a b if 3 ' + é".split()), max_size=12))
def test_shingles_equal_a_plain_version(spark, words):
    t = " ".join(words)
    toks = re.findall(lexical.TOKEN_PATTERN, t)
    want = [] if not toks else [" ".join(toks)] if len(toks) < 3 else list(dict.fromkeys(" ".join(toks[i : i + 3]) for i in range(len(toks) - 2)))
    assert one(spark, lexical.shingles(lexical.tokens(F.col("t")), 3), t=t) == want


def test_percent_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(0.125,), (0.005,), (0.015,)], "v double").select(scalars.percent(F.col("v")).alias("p")).collect()
    assert [r["p"] for r in rows] == [12, 0, 2]


def test_unquoted(spark):
    for raw, want in (("'a'", "a"), ('"a', '"a'), ("`x y`", "x y"), ("'", "'"), ("''", "")):
        assert one(spark, scalars.unquoted(F.col("t")), t=raw) == want


def test_thresholds_are_doubles(spark):
    from echofold.operators.judge import verdict

    rows = spark.createDataFrame([(0.7,), (0.8,), (0.71,)], "s double").select(verdict(F.col("s"), 0.8, 0.1).alias("v")).collect()
    assert [r["v"] for r in rows] == ["not_duplicate", "duplicate", "uncertain"]
