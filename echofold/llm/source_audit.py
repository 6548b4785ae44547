"""How far the word use of each source lies from that of the other sources of its language.

Plain relational work: the terms of all texts are exploded and counted by (lang, source, term) with
map-side partials; a language keeps the terms that enough of its documents have; every (lang, source)
group is crossed with the kept terms of its language, so that a term it lacks counts as zero; smoothed
shares in parts of a billion are integers, so all arithmetic is exact and the same in any order; groups
meet on (lang, term) for the sum of their differences, and windows rank the results.

A document's terms are sorted once, so that the first of equal ones can be marked: occurrences and
documents are then counted in one pass, with no identity of rows needed. The cross runs within salts of
the terms, so that a language with most of the rows is spread evenly. Divisions are of decimals of 38
digits: no count overflows them.

Defined results: a null text, lang or source is ''; a text without terms still makes its group occur;
repeated rows count as often as they occur, also as documents; of equal values the smaller item, byte by
byte, ranks first; an empty table gives nothing; a language without kept terms gives pairs of value 0 and
no terms; a group that is alone in its language has no pairs. Columns other than text, lang and source are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import scratch, stored, width

#: A term is a run of letters A-Z in either case and of whatever is not ASCII, so what parts terms is a run of
#: the others (splitting there gives the same matches several times faster); shares are in parts of UNITS.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNITS = 1_000_000_000


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _lower(text: Column) -> Column:
    """A-Z lower-cased. Where all is ASCII the built-in does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (rows that have it)."""
    rows = docs.select(_plain("lang"), _plain("source"), F.sort_array(F.split(_lower(_plain("text")), APART, -1)).alias("terms"))
    # An outer explode, as an inner one makes the optimizer extract and sort all terms once more, to see whether there are any.
    rows = rows.select("lang", "source", "terms", F.posexplode_outer("terms").alias("at", "term")).where("term <> ''")  # before the first and behind the last term
    first = F.when(F.col("at") == 0, 1).when(F.col("term") != F.expr("terms[at - 1]"), 1).otherwise(0)
    return rows.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("n_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + 2) / (total + 2 * terms)), exact."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", whole(count + 2) * F.lit(UNITS).cast("decimal(10,0)"), whole(total + 2 * terms))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are below 2**30, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame, least_docs: int = 10) -> tuple[DataFrame, DataFrame]:
    """(groups lang, source; table lang, source, term, n, p, q): the share p of each kept term in each group
    and q in its language, zeros included."""
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    counts = term_counts(docs).withColumns({"n_lang": F.sum("n").over(of_term), "docs_lang": F.sum("n_docs").over(of_term)})
    known = stored(counts.where(F.col("docs_lang") >= least_docs).select("lang", "source", "term", "n", "n_lang"), "known")
    kept = stored(known.select("lang", "term", "n_lang").distinct(), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("terms"))
    groups = stored(docs.select(_plain("lang"), _plain("source")).distinct(), "groups", kept=True)
    totals = groups.join(known.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")

    salts = width(docs.sparkSession)
    every = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dense = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(every, ["lang", "salt"])
    dense = dense.join(known.drop("n_lang").hint("merge"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    p = share(F.col("n"), F.coalesce("total", F.lit(0).cast("bigint")), F.col("terms"))
    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    return groups, stored(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "shares", kept=True)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for each group every other source of its language by distance
    (part ``pair``), and the terms that it uses most above its language (part ``term``, to rank ``top``)."""
    with scratch():
        groups, dense = shares(docs, least_docs)
    one, other = dense.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("ps")), dense.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("pt"))
    # The gap is the same both ways, so each two sources meet once.
    sums = one.join(other.hint("merge"), ["lang", "term"]).where("s < t").groupBy("lang", "s", "t").agg(F.sum(gap(F.col("ps"), F.col("pt"))).alias("value"))
    both = sums.select("lang", F.inline(F.expr("array(struct(s AS source, t AS item), struct(t AS source, s AS item))")), "value")
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
