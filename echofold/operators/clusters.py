"""Clusters of duplicates, their blast radius and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare_name, blast_score, share, share_percent
from .components import connected_components

METHOD = "removable*(1+ln(1+calls))*(1+ln(1+churn))"
EXTERNAL = "external_package"


def unit_key(path: str, start: str, name: str) -> Column:
    """Orders like the tuple (path, start line, name)."""
    return F.struct(F.col(path).alias("path"), F.col(start).cast("bigint").alias("start_line"), F.col(name).alias("name"))


def members(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Unit columns with their cluster. ``findings`` (l, r) are surfaceable; ids order as unit keys do.

    units: id, path, start_line, end_line, name, ...
    """
    return labelled(connected_components(findings, "l", "r").withColumnRenamed("node", "id"), units)


def labelled(labels: DataFrame, units: DataFrame) -> DataFrame:
    """Unit columns with the cluster that ``labels`` (id, component) give them."""
    first = units.select(F.col("id").alias("component"), F.concat_ws(":", "path", F.col("start_line").cast("string"), "name").alias("cluster_id"))
    return units.join(labels, "id").join(first, "component").drop("component")


def sizes(of: DataFrame) -> DataFrame:
    """cluster_id, units, total_lines, removable_lines (all but the longest member; 0 for one)."""
    lines = F.col("end_line") - F.col("start_line") + 1
    out = of.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("units"), F.sum(lines).alias("total_lines"), F.max(lines).alias("longest"))
    return out.select("cluster_id", "units", "total_lines", F.when(F.col("units") < 2, F.lit(0)).otherwise(F.col("total_lines") - F.col("longest")).cast("bigint").alias("removable_lines"))


def blast_radius(of: DataFrame, references: DataFrame | None = None, unresolved: DataFrame | None = None, churn: DataFrame | None = None) -> DataFrame:
    """Adds call_sites (summed over members), churn and unresolved_paths (over distinct paths), score, method.

    references: target_path, name. unresolved: path, reason. churn: path, commits.
    """
    out = sizes(of)
    paths = of.select("cluster_id", "path").distinct()
    if references is None:
        out = out.withColumn("call_sites", F.lit(0).cast("bigint"))
    else:
        calls = references.groupBy(F.col("target_path").alias("path"), F.col("name").alias("bare")).agg(F.count(F.lit(1)).alias("calls"))
        per = of.withColumn("bare", bare_name(F.col("name"))).join(calls, ["path", "bare"], "left").groupBy("cluster_id").agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("call_sites"))
        out = out.join(per, "cluster_id")
    if churn is None:
        out = out.withColumn("churn", F.lit(0).cast("bigint"))
    else:
        per = paths.join(churn, "path", "left").groupBy("cluster_id").agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("churn"))
        out = out.join(per, "cluster_id")
    if unresolved is None:
        out = out.withColumn("unresolved_paths", F.lit(0).cast("bigint"))
    else:
        holes = unresolved.where(F.col("reason") != EXTERNAL).select("path").distinct()
        per = paths.join(holes, "path", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("unresolved_paths"))
        out = out.join(per, "cluster_id", "left").withColumn("unresolved_paths", F.coalesce("unresolved_paths", F.lit(0)))
    return out.withColumn("score", blast_score(F.col("removable_lines"), F.col("call_sites"), F.col("churn"))).withColumn("score_method", F.lit(METHOD))


def ranked(radius: DataFrame, top: int | None = None) -> DataFrame:
    """By score, then cluster id; with ``top`` a top-k."""
    out = radius.orderBy(F.desc("score"), "cluster_id")
    return out if top is None else out.limit(top)


def totals(radius: DataFrame, covered: DataFrame) -> DataFrame:
    """One row of what a report sums up, from blast_radius and coverage."""
    sums = radius.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("removable_lines"), F.lit(0)).alias("removable_lines"), F.count_if(F.col("unresolved_paths") == 0).alias("safely_remediable"), F.coalesce(F.max("units"), F.lit(0)).alias("max_copies"))
    both = sums.crossJoin(covered)  # one row each
    return both.select(
        "clusters", "removable_lines", "safely_remediable", "max_copies", share(F.col("removable_lines"), F.col("lines_in_units")).alias("duplicated_percent"),
        share_percent(F.col("files_fully_resolved"), F.col("files_scanned")).alias("resolution_percent"),
    )


def blocked_reasons(of: DataFrame, unresolved: DataFrame) -> DataFrame:
    """cluster_id, reasons: every reason of the paths that have a blocking one."""
    blocked = unresolved.where(F.col("reason") != EXTERNAL).select("path").distinct()
    rows = of.select("cluster_id", "path").distinct().join(blocked, "path", "left_semi").join(unresolved.select("path", "reason"), "path")
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def evidence(findings: DataFrame, of: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` findings of each cluster in candidate order."""
    rows = findings.join(of.select(F.col("id").alias("l"), "cluster_id"), "l")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("l", "r"))).where(F.col("rank") <= most)


def coverage(units: DataFrame, files: DataFrame, unresolved: DataFrame, candidate_pairs: int, truncated: bool = False) -> DataFrame:
    """One row of what a scan looked at."""
    u = units.agg(F.count(F.lit(1)).alias("units_extracted"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("lines_in_units"))
    blocked = unresolved.where(F.col("reason") != EXTERNAL).select("path").distinct().withColumn("hole", F.lit(1))
    f = files.join(blocked, "path", "left").agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("hole").isNull()).alias("files_fully_resolved"))
    n = F.col("units_extracted")
    return f.crossJoin(u).select(
        "files_scanned", "units_extracted", "lines_in_units", F.lit(candidate_pairs).cast("bigint").alias("candidate_pairs"),
        (n * (n - 1) / 2).cast("bigint").alias("total_possible_pairs"), F.lit(truncated).alias("candidates_truncated"), "files_fully_resolved",
    )
