"""Lexical token streams and their comparison, as column expressions.

Everything here stays in the JVM: regular expressions and higher-order functions over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, and the words that normalisation keeps.
TOKEN_PATTERN = r"""[A-Za-z_][A-Za-z0-9_]*|\d+\.?\d*|"[^"]*"|'[^']*'|\S"""
KEYWORDS = """
if else for while return break continue try in not and or true false null none new await async yield
const let var function class export import typeof instanceof catch finally throw switch case default
extends interface type enum of undefined def elif except raise with as lambda pass is from global nonlocal
assert del
""".split()


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: a lambda variable, not a copy of its expression.

    Inside higher-order functions the optimiser would repeat the expression for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def normalized(stream: Column) -> Column:
    """Keywords lower-cased, other identifiers ID, numbers and strings LIT, the rest as it is."""

    def one(t: Column) -> Column:
        return (
            F.when(F.lower(t).isin(KEYWORDS), F.lower(t))
            .when(t.rlike("^[A-Za-z_]"), F.lit("ID"))
            .when(t.rlike("^[0-9\"']"), F.lit("LIT"))
            .otherwise(t)
        )

    return F.transform(stream, one)


def renamed(stream: Column, most: int = 12) -> Column:
    """Identifiers numbered by first occurrence; those after the first ``most`` are all ID."""
    def is_name(t: Column) -> Column:
        return t.rlike("^[A-Za-z_]") & ~F.lower(t).isin(KEYWORDS)

    def numbered(t: Column, first: Column) -> Column:
        at = F.array_position(first, t)
        return (
            F.when(F.lower(t).isin(KEYWORDS), F.lower(t))
            .when(t.rlike("^[0-9\"']"), F.lit("LIT"))
            .when(~t.rlike("^[A-Za-z_]"), t)
            .when(at > 0, F.concat(F.lit("ID"), (at - 1).cast("string")))
            .otherwise(F.lit("ID"))
        )

    def of(s: Column) -> Column:
        return let(F.slice(F.array_distinct(F.filter(s, is_name)), 1, most), lambda first: F.transform(s, lambda t: numbered(t, first)))

    return let(stream, of)


def shingles(stream: Column, width: int = 4) -> Column:
    """Distinct runs of ``width`` tokens; a shorter stream is one shingle, an empty or null one none."""
    def of(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(s, i, width), " "))
        return F.when(F.coalesce(F.size(s), F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return let(stream, of)


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal, an empty and another have nothing in common."""
    def of(both: Column) -> Column:
        common = F.size(F.array_intersect(both["l"], both["r"]))
        union = F.size(both["l"]) + F.size(both["r"]) - common
        return F.when(union == 0, F.lit(1.0)).otherwise(common / union)

    return let(F.struct(left.alias("l"), right.alias("r")), of)


def textual_overlap(left: Column, right: Column) -> Column:
    return jaccard(F.array_distinct(tokens(left)), F.array_distinct(tokens(right)))


def structural_similarity(left: Column, right: Column, width: int = 3) -> Column:
    return jaccard(shingles(normalized(tokens(left)), width), shingles(normalized(tokens(right)), width))


def structural_hash(stream: Column) -> Column:
    return F.concat(F.lit("ast1:"), F.sha2(F.array_join(stream, " "), 256))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
