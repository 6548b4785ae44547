"""Running totals over one order of all rows, without a task that sees them all.

Rows are dealt to ranges of the order; each range is summed on its own, the sums of the ranges (a number
for each) give every range what lies before it, and windows run within ranges only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored, width


def running_total(rows: DataFrame, order: list, cost, out: str = "before", parts: int | None = None) -> DataFrame:
    """Adds ``out``: the total cost of all rows that come before a row.

    ``order`` are columns that tell all rows apart, in ascending order (nulls first) unless they say otherwise;
    rows that it does not tell apart come in any order and stay in one range. A null cost is zero. An empty table
    gives no rows.
    """
    n = parts or width(rows.sparkSession)
    dealt = stored(rows.withColumn("_cost", F.coalesce(cost if not isinstance(cost, str) else F.col(cost), F.lit(0)).cast("bigint")).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    sums = {r["_range"]: r["total"] for r in dealt.groupBy("_range").agg(F.sum("_cost").alias("total")).collect()}  # a row a range
    ranges = sorted(sums)
    starts = dict(zip(ranges, accumulate((sums[r] for r in ranges), initial=0)))
    offsets = rows.sparkSession.createDataFrame(list(starts.items()), "_range int, _offset bigint")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum("_cost").over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_offset") + F.col("_inside")).drop("_range", "_cost", "_offset", "_inside")


def run_budget(calls: DataFrame, limit: int, order: list, cost: str = "tokens", parts: int | None = None) -> DataFrame:
    """Adds ``allowed`` and ``spent`` to the calls of one run: a call is made while less than ``limit`` is spent, so the
    last one may go over it; what is spent stays as it is once calls are refused."""
    rows = running_total(calls, order, cost, "spent", parts).withColumn("allowed", F.col("spent") < limit)
    end = rows.where("allowed").agg(F.max(F.col("spent") + F.coalesce(F.col(cost), F.lit(0))).alias("_end"))
    return rows.crossJoin(F.broadcast(end)).withColumn("spent", F.when(F.col("allowed"), F.col("spent")).otherwise(F.coalesce("_end", F.lit(0).cast("bigint")))).drop("_end")  # one row


def budget_report(budgeted: DataFrame, limit: int, cost: str = "tokens") -> DataFrame:
    """One row: calls made and refused, tokens spent, and whether the coverage is partial."""
    made = F.coalesce(F.sum(F.when(F.col("allowed"), F.coalesce(F.col(cost), F.lit(0)))), F.lit(0)).cast("bigint")
    refused = F.count_if(~F.col("allowed"))
    return budgeted.agg(F.count_if("allowed").alias("made"), refused.alias("refused"), made.alias("spent"), (refused > 0).alias("partial")).withColumn("token_limit", F.lit(limit).cast("bigint"))
