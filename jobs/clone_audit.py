"""Which copies to merge first: near copies in a table of units, ranked by what merging them would save.

    python jobs/clone_audit.py --units PATH --commits PATH --out PATH [--config FILE]

Units whose shingles are alike make a cluster. Clusters are ranked by their blast score: lines that could go, weighted
by the commits to their paths in the days before the newest commit. The output has a row for each unit of a cluster and
is partitioned by language. A run replaces it as a whole, so a run that was cut off is mended by the next one, and
the same input gives the same rows.

The config says in SQL which columns of the tables are a unit's and a commit's. Units without id are left out, units
without text are in no cluster; commits without time or path count nowhere.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.scalars import lines_of
from echofold.operators import clones, clusters
from echofold.operators.running import running_total
from echofold.runtime import scratch, stored
from echofold.sources.files import churn

CONFIG = Path(__file__).with_suffix(".json")
AUDIT = "rank bigint, cluster_id string, id bigint, path string, name string, lines bigint, keep boolean, units bigint, removable_lines bigint, churn bigint, score double, language string"
log = logging.getLogger("clone_audit")


def settings(path: str | os.PathLike = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_units(spark: SparkSession, path: str, of: dict) -> DataFrame:
    rows = spark.read.parquet(path).selectExpr(*(f"{of[c]} AS {c}" for c in ("id", "path", "name", "language", "text"))).where("id is not null")
    first = F.col("id").cast("bigint")
    return rows.select(first.alias("id"), "path", first.alias("start_line"), (first + lines_of(F.coalesce("text", F.lit(""))) - 1).alias("end_line"), "name", "language", "text")


def recent_churn(spark: SparkSession, path: str, of: dict, days: int) -> DataFrame:
    """path, commits of the last days before the newest commit."""
    rows = spark.read.parquet(path).selectExpr(f"{of['path']} AS path", f"{of['ts']} AS ts").where("path is not null and ts is not null")
    newest = rows.agg(F.max("ts").alias("newest"))  # one row
    return churn(rows.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.make_dt_interval(F.lit(days))))


def audit(units: DataFrame, commits: DataFrame, threshold: float, width: int) -> DataFrame:
    """A row for each unit that has a near copy, with its cluster's rank and measures."""
    found = clones.near_copies(units.select("id", "text"), threshold, width)
    members = stored(clusters.labelled(found, units.drop("text")), "members")
    scored = clusters.blast_radius(members, churn=commits).withColumn("score", F.round("score", 4))
    ranked = running_total(scored, [F.desc("score"), "cluster_id"], F.lit(1), "rank").withColumn("rank", F.col("rank") + 1)
    rows = members.join(ranked.select("rank", "cluster_id", "units", "removable_lines", "churn", "score").hint("merge"), "cluster_id")
    first = F.concat_ws(":", "path", F.col("start_line").cast("string"), "name") == F.col("cluster_id")
    lines = (F.col("end_line") - F.col("start_line") + 1).cast("bigint")
    return rows.select("rank", "cluster_id", "id", "path", "name", lines.alias("lines"), first.alias("keep"), F.col("units").cast("bigint").alias("units"), "removable_lines", F.col("churn").cast("bigint").alias("churn"), "score", "language")


def run(spark: SparkSession, units: str, commits: str, out: str, config: dict | None = None) -> DataFrame:
    """Write the audit to ``out`` and return it, read back."""
    config = config or settings()
    source = read_units(spark, units, config["unit"])
    log.info("read %d units from %s and %d commits from %s", source.select("id").count(), units, spark.read.parquet(commits).count(), commits)
    with scratch():
        rows = audit(source, recent_churn(spark, commits, config["commit"], config["window_days"]), config["threshold"], config["shingle_width"])
        rows.hint("rebalance", "language").write.mode("overwrite").partitionBy("language").parquet(out)
    written = spark.read.schema(AUDIT).parquet(out)
    totals = written.agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("clusters")).first()
    log.info("wrote %d units in %d clusters to %s", totals["n"], totals["clusters"], out)
    return written


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--units", "--commits", "--out"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("clone audit").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.units, args.commits, args.out, settings(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
