"""Candidates ordered by the cosine of their units' vectors, which are kept by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CACHED = "content_hash string, vector array<double>"


def unit_vector(vector: Column) -> Column:
    """Of length 1; null for a vector that is null, holds nulls or anything not finite, or is all zeros."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    length = F.sqrt(square)
    return F.when((square > 0) & (square < float("inf")), F.transform(vector, lambda x: x / length))


def cosine(left: Column, right: Column) -> Column:
    """Of unit vectors; null for unequal lengths."""
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(left) == F.size(right), dot)


def vectors(units: DataFrame, compute: Callable[[DataFrame], DataFrame], cache: str) -> DataFrame:
    """content_hash, vector (of length 1) of all units (content_hash, ...), from the folder ``cache`` where they are known.

    ``compute`` takes the units of unknown hashes, one of each, and returns content_hash and vector. What it gives is
    added to the cache, so it sees a content once. A run that is cut off may leave rows twice: one of them is read.
    """
    spark = units.sparkSession

    def known() -> DataFrame:
        try:
            rows = spark.read.schema(CACHED).parquet(cache)
        except AnalysisException:  # no folder yet
            rows = spark.createDataFrame([], CACHED)
        return rows.groupBy("content_hash").agg(F.first("vector").alias("vector"))

    unknown = units.where("content_hash is not null").join(known().select("content_hash").hint("merge"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    if not unknown.isEmpty():
        compute(unknown).select("content_hash", unit_vector(F.col("vector").cast("array<double>")).alias("vector")).write.mode("append").parquet(cache)
    return known().join(units.select("content_hash").distinct().hint("merge"), "content_hash", "left_semi")


def reranked(pairs: DataFrame, hashes: DataFrame, of: DataFrame) -> DataFrame:
    """Adds ``cosine`` to pairs (l, r). ``hashes`` are id and content_hash, ``of`` content_hash and vector; null where a side has none."""
    side = lambda s: hashes.join(of.hint("merge"), "content_hash").select(F.col("id").alias(s), F.col("vector").alias(f"{s}_vector"))
    both = pairs.join(side("l"), "l", "left").join(side("r"), "r", "left")
    return both.withColumn("cosine", cosine(F.col("l_vector"), F.col("r_vector"))).drop("l_vector", "r_vector")
