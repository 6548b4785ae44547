"""A commit log (path, ts) by day, as a table that grows by what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a history.
DAILY = "day date, path string, commits bigint, last_touched timestamp"


def daily(log: DataFrame) -> DataFrame:
    """day, path, commits, last_touched. Commits without a time are in no day and left out; a null path is a path."""
    rows = log.where("ts is not null").withColumn("day", F.to_date("ts"))
    return rows.groupBy("day", "path").agg(F.count(F.lit(1)).alias("commits"), F.max("ts").alias("last_touched"))


def merged(parts: DataFrame) -> DataFrame:
    """The same of histories of parts of a log, one below the other."""
    return parts.groupBy("day", "path").agg(F.sum("commits").alias("commits"), F.max("last_touched").alias("last_touched"))


def churn_since(history: DataFrame, first: Column) -> DataFrame:
    """path, commits of the days from ``first`` on: only their partitions are read."""
    return history.where(F.col("day") >= first).groupBy("path").agg(F.sum("commits").alias("commits"))


def last_touched(history: DataFrame) -> DataFrame:
    return history.groupBy("path").agg(F.max("last_touched").alias("ts"))
