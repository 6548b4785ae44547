"""Connected components of an undirected graph by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a grouped
minimum and a join on the same key. The minima are written first, so that the join reads two plain
exchanges and adaptive execution may split the partition of a hub node. Edges never reach the driver;
only their count and a checksum do, to see whether a round changed anything. The count also says how many files a
round's tables need: few edges are not written as many tiny files, round after round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import release, stored, width

MAX_ROUNDS, FILE_ROWS = 60, 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of an edge; self-loops add nothing.

    Null ends and repeated edges are ignored. The result is a stored table.
    """
    current = stored(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        "edges",
    )
    before = _state(current)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        files = -(-before[0] // FILE_ROWS)
        few = lambda df: df.coalesce(files) if files < width(df.sparkSession) else df
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "least")
        large = stored(few(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "large")
        least2 = stored(few(large.groupBy("u").agg(F.min("v").alias("m"))), "least")
        small = large.join(least2.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(few(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct()), "edges")
        state = _state(after)
        release(current, least, large, least2)
        current = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._echofold_path = current._echofold_path  # what release() drops
    return out
