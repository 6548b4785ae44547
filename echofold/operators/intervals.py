"""Intervals for figures of a report, by a Poisson bootstrap (Chamandy et al., 2012).

In each replicate a row counts so many times as a Poisson variable of mean 1 says, which a hash of the replicate and the row's id
decides. So all replicates are sums of one pass over the rows, the same in any order and on any cluster, and partial sums are
formed before the shuffle: one row a replicate and task goes through it.
"""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**32 times the odds that a Poisson variable of mean 1 is at most 0, 1, 2 ...
STEPS = [int((1 << 32) * p) for p in accumulate(exp(-1) / factorial(k) for k in range(9))]


def weight(replicate: Column, key: Column) -> Column:
    """How often a row counts in a replicate: the number of STEPS that 32 bits of a hash reach."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.size(F.filter(F.array(*map(F.lit, STEPS)), lambda s: s <= drawn)).cast("bigint")


def share_interval(rows: DataFrame, key: str, part: str, whole: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """One row: point, low, high of 100 * sum(part) / sum(whole), with the interval of ``level``.

    A replicate whose sum of ``whole`` is 0 has a share of 0, as the point has; null parts and wholes are 0. Of no rows
    the point is 0 and the bounds too.
    """
    share = lambda p, w: F.when(F.coalesce(w, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.lit(100.0) * p / w)
    rows = rows.select(F.col(key).alias("key"), F.coalesce(part, F.lit(0)).alias("part"), F.coalesce(whole, F.lit(0)).alias("whole"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight(F.col("b"), F.col("key"))).where("w > 0")
    sums = drawn.groupBy("b").agg(F.sum(F.col("w") * F.col("part")).alias("p"), F.sum(F.col("w") * F.col("whole")).alias("n"))
    tail = (1 - level) / 2
    bounds = sums.select(share(F.col("p"), F.col("n")).alias("s")).agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))
    point = rows.agg(share(F.sum("part"), F.sum("whole")).alias("point"))
    return point.crossJoin(bounds).select("point", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))  # one row each


def removable_units(members: DataFrame, units: DataFrame) -> DataFrame:
    """id, lines, removable: the lines of every unit, and of those those that go when its cluster is merged into its longest
    unit (the first of equals)."""
    lines = (F.col("end_line") - F.col("start_line") + 1).cast("bigint")
    kept = members.groupBy("cluster_id").agg(F.max_by("id", F.struct(lines, -F.col("id"))).alias("kept"))
    gone = members.join(kept, "cluster_id").where("id <> kept").select("id", F.lit(True).alias("goes"))
    return units.select("id", lines.alias("lines")).join(gone, "id", "left").select("id", "lines", F.when(F.col("goes"), F.col("lines")).otherwise(F.lit(0)).cast("bigint").alias("removable"))
