"""Paths, percents, scores and display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The source extensions of each language, and the folders that are never scanned.
LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyi"],
}
LANGUAGE_OF = {e: language for language, extensions in LANGUAGES.items() for e in extensions}


def language_of_path(path: Column) -> Column:
    """Language by the last suffix, in any case; null if it is none of ours."""
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]), suffix)


def normal_path(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` segments; ``..`` above the top is dropped."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def unquoted(raw: Column) -> Column:
    """Without a pair of equal quotes around it."""
    first = F.substring(raw, 1, 1)
    paired = (F.length(raw) >= 2) & first.isin('"', "'", "`") & (first == F.substring(raw, -1, 1))
    return F.when(paired, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def bare_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def percent(value: Column) -> Column:
    """Whole percent, halves to even."""
    return F.bround(value * 100).cast("int")


def share_percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(F.bround(F.lit(100.0) * part / whole)).cast("int")


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def blast_score(removable: Column, calls: Column, churn: Column) -> Column:
    return removable * (1 + F.log1p(calls)) * (1 + F.log1p(churn))


def clipped(text: Column, limit: int, mark: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def one_decimal(value: Column, by: int) -> Column:
    """value / by (a double) with one decimal as C prints it: by the double's exact value, ties to even.

    Only halves of a tenth are in doubt; there the double is compared with value / by in whole numbers.
    """
    tenth = by // 10
    low, rest = F.floor(value / tenth).cast("bigint"), value % tenth
    scale = F.lit(1 << 2)  # makes the double a whole number: below 2**(n + 10) its last bit is worth 2**(n - 52) where it is 2**n at least
    for n in (40, 30, 20, 10, 0):
        scale = F.when(value < min(by << (n + 10), (1 << 63) - 1), F.lit(1 << (52 - n))).otherwise(scale)
    exact = ((value / F.lit(float(by))) * scale).cast("bigint").cast("decimal(20,0)") * F.lit(by).cast("decimal(8,0)")
    asked = value.cast("decimal(19,0)") * scale.cast("decimal(17,0)")
    up = (rest * 2 > tenth) | ((rest * 2 == tenth) & ((exact > asked) | ((exact == asked) & (low % 2 == 1))))
    tenths = low + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def compact(value: Column) -> Column:
    """9,999 grouped below ten thousand, then 12K, 1.5M."""

    def scaled(by: int, unit: str) -> Column:
        return F.concat(F.regexp_replace(one_decimal(value, by), r"\.0$", ""), F.lit(unit))

    return F.when(value >= 1_000_000, scaled(1_000_000, "M")).when(value >= 10_000, scaled(1000, "K")).otherwise(F.format_number(value, 0))


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def bar_width(value: Column, widest: Column) -> Column:
    return F.greatest(F.lit(4), F.when(widest == 0, F.lit(0)).otherwise(F.bround(F.lit(100.0) * value / widest)).cast("int"))


def lines_of(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def snippet(text: Column, start: Column, end: Column, limit: int = 1400) -> Column:
    body = F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return clipped(body, limit, "\n…")
