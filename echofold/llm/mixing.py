"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are source token shares raised to an exponent and normalised: 1 keeps the natural mix, 0 makes
sources equal, more than 1 sharpens. Entropy falls as the exponent grows, from the logarithm of the number
of sources, so it is bisected for a target entropy, on [0, MOST]. A source's repetition is
weight * budget / tokens; the largest of them is least at 1 and rises to both sides, so a limit on it keeps
the exponent between two bounds around 1, which are bisected too. With both, the exponent of the entropy,
moved to the nearer bound where it lies outside. A target outside the range of entropies gives the end of
the range, a limit that even the natural mix breaks gives 1.

Realising: a source's budget is its weight times the token budget. Its documents are permuted afresh, by a
hash, for every pass; whole passes are taken, then the part of a last pass that fits the budget. All
sources' sequences are stretched over the same number of blocks, so each block holds every source in its
share; within a block the order is another permutation. Where a last pass ends is one row a source, found
from running sums over bins of the hash and, in one bin, over its documents; so no source, however hot, is
sorted in one task, and the documents themselves are never shuffled.

Tokens are words here (runs of other bytes than white space), at least one a document so that every row
can be placed. Defined results: rows without source are a source of their own; null and empty texts count
one token; rows without id are placed by their text; repeated rows share a place, and those at the end of a
last pass are all taken or all left; an empty table gives no rows; extra columns are ignored, or carried
along where asked for (not those named like a column of the result).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import release, stored, text_batches
from .words import WordHasher, chunks, trimmed, utf8

LEAST_BINS, BIN_ROWS = 1024, 1 << 17
UNIT = 1 << 40
MOST, ROUNDS, SECTIONS = 64.0, 4, 1024
RESULT = ["doc_id", "source", "n_tokens", "pass_no", "block", "place"]


def token_counts(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, key (the text's hash where there is no id), carried (a struct, if asked for), n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for i, j in chunks(batch, "_text"):
                part = batch.slice(i, j - i)
                raw, at = utf8(part.column("_text"))
                solid = ~hasher.space[raw]
                first = solid.copy()
                first[1:] &= ~solid[:-1]
                inner = at[:-1][at[:-1] < len(raw)]
                first[inner] = solid[inner]
                n = np.diff(np.concatenate([[0], np.cumsum(first)])[at])
                rest = part.drop_columns(["_text"])
                yield rest.append_column("n_tokens", pa.array(np.maximum(n, 1), pa.int64()))

    text_batches(docs.sparkSession)
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("key")
    more = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("carried")] if carried else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), key, *more, F.col("text").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(trimmed(run), f"{schema}, n_tokens bigint")


def _measure(totals: DataFrame, low: float, high: float, budget: float, sections: int = SECTIONS) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest repetition) at evenly spaced exponents, one pass over the sources."""
    grid = F.expr(f"explode(transform(sequence(0, {sections if high > low else 0}), k -> {low!r}D + {high - low!r}D * k / {sections}))").alias("a")
    rows = totals.select("tokens", "share", grid).withColumn("v", F.pow("share", F.col("a")))
    plogp = F.when(F.col("v") > 0, F.col("v") * F.log("v")).otherwise(0.0)
    per = rows.groupBy("a").agg(F.sum("v").alias("z"), F.sum(plogp).alias("vl"), F.max(F.col("v") / F.col("tokens")).alias("r"))
    return sorted((r["a"], math.log(r["z"]) - r["vl"] / r["z"], r["r"] / r["z"] * budget) for r in per.collect())


def _border(totals: DataFrame, budget: float, low: float, high: float, before: Callable[[float, float], bool]) -> float:
    """Bisection, SECTIONS ways at a time: the exponent from which on ``before`` (entropy, repetition) is
    no longer true; ``low`` or ``high`` where it is nowhere or everywhere true."""
    for _ in range(ROUNDS):
        points = _measure(totals, low, high, budget)
        true = [a for a, h, r in points if before(h, r)]
        if not true:
            return low
        if true[-1] == points[-1][0]:
            return high
        low = true[-1]
        high = next(a for a, _, _ in points if a > low)
    return high


def exponent(totals: DataFrame, budget: float, entropy: float | None, repetition: float | None) -> float:
    """The exponent for totals (source, tokens, share: tokens over those of the largest source), rounded to
    six places."""
    over = math.inf if repetition is None else repetition * (1 + 1e-9)
    if entropy is None:
        return round(1.0 if repetition is None else _border(totals, budget, 0.0, 1.0, lambda h, r: r > over), 6)
    a = _border(totals, budget, 0.0, MOST, lambda h, r: h > entropy)
    if repetition is not None and _measure(totals, a, a, budget, 1)[0][2] > over:
        a = _border(totals, budget, 0.0, 1.0, lambda h, r: r > over) if a < 1 else _border(totals, budget, 1.0, MOST, lambda h, r: r <= over)
    return round(a, 6)


def source_totals(counts: DataFrame) -> tuple[DataFrame, int, int]:
    """(source, tokens, share: tokens over those of the largest source; a stored table), all tokens, all rows."""
    totals = stored(counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "sources")
    tokens, most, n = totals.agg(F.sum("tokens"), F.max("tokens"), F.sum("n")).first()
    out = totals.withColumn("share", F.col("tokens") / F.lit(float(most or 1)))
    out._echofold_path = totals._echofold_path  # what release() drops
    return out, tokens or 0, n or 0


def weights(totals: DataFrame, budget: float, entropy: float | None = None, repetition: float | None = None) -> DataFrame:
    """source, tokens, weight, target (tokens), passes, from source_totals. A stored table."""
    a = exponent(totals, budget, entropy, repetition) if budget else 1.0
    powered = totals.withColumn("v", F.pow("share", F.lit(a)).cast("decimal(38,12)"))
    z = powered.agg(F.sum("v")).first()[0] or 1
    out = powered.withColumn("weight", F.col("v").cast("double") / F.lit(float(z)))
    return stored(out.select("source", "tokens", "weight", F.round(F.col("weight") * budget).cast("bigint").alias("target")).withColumn("passes", F.col("target") / F.col("tokens")), "weights")


def _place(salt: str | Column) -> Column:
    """A place in [0, UNIT) from the first 40 bits of an md5."""
    text = F.concat_ws(":", F.lit("mix"), salt, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("bigint")


def _ends(counts: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """of (the source), passes, full (whole passes), and the end of the last pass: place, id and key of the
    last document that fits; before all places where none does. ``n`` is the number of documents."""
    bins = max(LEAST_BINS, 1 << max(0, math.ceil(n / BIN_ROWS) - 1).bit_length())
    wide = plan.withColumn("full", F.floor("passes").cast("int")).withColumn("room", F.col("target") - F.col("full") * F.col("tokens"))
    of = wide.select(F.col("source").alias("of"), "full", "room")
    last = counts.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("at", _place(F.col("full").cast("string")))
    last = last.withColumn("bin", F.floor(F.col("at") * bins / UNIT).cast("int")).withColumn("who", F.coalesce("doc_id", F.lit(-(1 << 63))))
    sums = last.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"), F.max("room").alias("room"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")
    sums = sums.withColumn("before", before).where("before <= room")
    # The bin that the budget ends in; where it does not end in one, all of the pass fits.
    edge = sums.groupBy("source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("e")).select(F.col("source").alias("b_source"), F.col("e.bin").alias("b_bin"), F.col("e.before").alias("before"))
    inside = last.join(edge, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    order = Window.partitionBy("source", "bin").orderBy("at", "who", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order)).where("upto <= room")
    ends = fits.groupBy("source").agg(F.max(F.struct("at", "who", "key")).alias("found")).select(F.col("source").alias("f_source"), "found")
    start = F.struct((F.col("b_bin").cast("bigint") * (UNIT // bins) - 1).alias("at"), F.lit((1 << 63) - 1).alias("who"), F.lit((1 << 63) - 1).alias("key"))
    out = wide.join(edge, F.col("source").eqNullSafe(F.col("b_source")), "left").join(ends, F.col("source").eqNullSafe(F.col("f_source")), "left")
    return stored(out.select(F.col("source").alias("of"), "passes", "full", F.coalesce("found", start).alias("end")), "ends")


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, pass_no, block, place: the training order is by block, then place.

    ``budget`` is in tokens and defaults to the corpus's own number. ``carried`` names further columns of
    the documents that the result has.
    """
    carried = tuple(c for c in carried if c not in RESULT)
    counts = stored(token_counts(docs), "tokens")
    totals, tokens, n = source_totals(counts)
    budget = tokens if budget is None else budget
    plan = weights(totals, float(budget), entropy, repetition)
    ends = _ends(counts, plan, n)
    release(totals, plan)
    n_blocks = max(1, math.ceil(budget / block_tokens))

    rows = counts
    if carried:
        release(counts)
        rows = token_counts(docs, carried)
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("of"))).withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("full"))))
    rows = rows.withColumn("at", _place(F.col("pass_no").cast("string")))
    mine = F.struct("at", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("who"), "key")
    taken = rows.where((F.col("pass_no") < F.col("full")) | (mine <= F.col("end")))
    block = F.least(F.floor((F.col("pass_no") + F.col("at") / F.lit(float(UNIT))) / F.col("passes") * n_blocks), F.lit(n_blocks - 1)).cast("int")
    return taken.select("doc_id", "source", "n_tokens", "pass_no", block.alias("block"), _place(F.concat(F.lit("b"), F.col("pass_no").cast("string"))).alias("place"), *[F.col("carried").getField(c).alias(c) for c in carried])
