"""Copies that are evolving apart: both sides edited on their own since they were last edited together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIVERGED = "diverged_history"


def diverged(pairs: DataFrame, log: DataFrame, days: int = 90) -> DataFrame:
    """Adds ``last_common`` and ``exclusion`` to pairs of paths (l_path, r_path, ...).

    ``log`` is path, ts, commit. Within the last ``days`` before its newest commit, a commit to both paths is common; a pair
    has diverged if both paths have commits after the last common one (of none: after the start). A path has not
    diverged from itself; paths without commits, null ones and rows without a time have no history.

    Each side's last commit is one row a path. Common commits are looked for from each pair's left path, by (commit, right
    path), so a commit that touches very many paths costs a row for each pair that it is in, never pairs of its paths.
    """
    newest = log.agg(F.max("ts").alias("newest"))  # one row
    recent = log.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.make_dt_interval(F.lit(days))).where("path is not null")
    touched = recent.groupBy("path", "commit").agg(F.max("ts").alias("ts"))
    last = touched.groupBy("path").agg(F.max("ts").alias("last"))
    asked = pairs.select("l_path", "r_path").where("l_path <> r_path").distinct()
    left = asked.join(touched.select(F.col("path").alias("l_path"), "commit", F.col("ts").alias("l_ts")).hint("merge"), "l_path")
    both = left.join(touched.select(F.col("path").alias("r_path"), "commit", F.col("ts").alias("r_ts")).hint("merge"), ["r_path", "commit"])
    common = both.groupBy("l_path", "r_path").agg(F.max(F.greatest("l_ts", "r_ts")).alias("last_common"))
    sides = [last.select(F.col("path").alias(f"{s}_path"), F.col("last").alias(f"{s}_last")) for s in "lr"]
    known = asked.join(common, ["l_path", "r_path"], "left").join(sides[0], "l_path").join(sides[1], "r_path")
    apart = F.col("last_common").isNull() | ((F.col("l_last") > F.col("last_common")) & (F.col("r_last") > F.col("last_common")))
    known = known.select("l_path", "r_path", "last_common", F.when(apart, DIVERGED).alias("exclusion"))
    return pairs.join(known, ["l_path", "r_path"], "left")
