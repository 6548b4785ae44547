"""Candidate pairs from shared LSH bands, under a bucket cap and a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .fingerprint import BANDS, PERMUTATIONS, band_keys

MAX_BUCKET, BUDGET = 200, 50_000


def buckets(signed: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """id, band, key: one row a band."""
    return signed.select("id", F.explode(band_keys(F.col("signature"), permutations, bands)).alias("b")).select("id", "b.band", "b.key")


def bucket_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))


def collided_pairs(rows: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """l, r (l < r): the distinct pairs of buckets of 2 .. max_bucket units.

    Sizes are counted first, with map-side partial counts, so a crowded bucket is dropped before
    anything is paired; pairs come from a join, never from collected groups.
    """
    usable = bucket_sizes(rows).where(F.col("n").between(2, max_bucket)).select("band", "key")
    kept = stored(rows.join(usable, ["band", "key"]), "buckets")
    left, right = kept.withColumnRenamed("id", "l"), kept.withColumnRenamed("id", "r")
    return left.join(right, ["band", "key"]).where("l < r").select("l", "r").distinct()


def all_collided_pairs(signed: DataFrame) -> DataFrame:
    """l, r (l < r): all pairs of units that share a bucket of whatever size.

    Units of one signature share all buckets, so they are folded into their first before banding and
    every pair is formed once from its two groups, not once for each band.
    """
    firsts = stored(signed.groupBy("signature").agg(F.min("id").alias("first")), "firsts")
    of = stored(signed.join(firsts.hint("merge"), "signature").select("id", "first"), "members")
    left, right = of.select(F.col("id").alias("x"), F.col("first").alias("l")), of.select(F.col("id").alias("y"), F.col("first").alias("r"))
    groups = collided_pairs(buckets(firsts.select(F.col("first").alias("id"), "signature")), 1 << 62)
    between = groups.join(left.hint("merge"), "l").join(right.hint("merge"), "r")
    within = left.join(right.hint("merge"), F.col("l") == F.col("r")).where("x < y")
    pairs = between.select("x", "y").unionByName(within.select("x", "y"))
    return pairs.where("x <> y").select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r")).distinct()


@dataclass(frozen=True)
class CandidateSet:
    pairs: DataFrame
    considered: int
    kept: int
    oversized_buckets: int

    @property
    def dropped_to_budget(self) -> int:
        return self.considered - self.kept

    @property
    def truncated(self) -> bool:
        return self.dropped_to_budget > 0


def within_budget(pairs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The first ``budget`` pairs by (l, r): a top-k, not a full sort."""
    return pairs.orderBy("l", "r").limit(budget)


def generate(signed: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS, budget: int = BUDGET, max_bucket: int = MAX_BUCKET) -> CandidateSet:
    """Candidates of ``signed`` (id, signature). Buckets over the cap are skipped and counted apart."""
    rows = stored(buckets(signed, permutations, bands), "bands")
    pairs = stored(collided_pairs(rows, max_bucket), "pairs")
    considered = pairs.count()
    over = bucket_sizes(rows).where(F.col("n") > max_bucket).count()
    return CandidateSet(within_budget(pairs, budget), considered, min(considered, budget), over)


def possible_pairs(n):
    return n * (n - 1) / 2


def most_similar(pairs: DataFrame, score: str, budget: int = BUDGET, bins: int = 1024) -> DataFrame:
    """The ``budget`` pairs (l, r, score) of the highest score, ties by (l, r): no sort of all pairs.

    Scores lie in [0, 1]. One pass counts them by bins, with map-side partials; a second keeps the bins above the one in
    which the budget ends, and of that one the best by a top-k. Null scores come last.
    """
    binned = pairs.withColumn("_bin", F.coalesce(F.floor(F.col(score) * bins), F.lit(-1)).cast("int"))
    counts = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bin
    room, edge = budget, -1
    for edge in sorted(counts, reverse=True):
        if counts[edge] >= room:
            break
        room -= counts[edge]
    last = binned.where(F.col("_bin") == edge).orderBy(F.desc(score), "l", "r").limit(room)
    return binned.where(F.col("_bin") > edge).unionByName(last).drop("_bin")
