"""Commits by day and path, kept up to date: a run takes only the files that came since the last one.

    python jobs/commit_history.py --commits FOLDER --out PATH [--config FILE]

The folder (or a pattern of files) is read as a file stream until nothing new is left. Below ``out`` are

    progress/   the stream's checkpoint: which files have been taken, in which batch
    deltas/     partitioned by day and batch: what each batch adds to a day
    history/    partitioned by day: the sum of the day's deltas; this is the result

A batch writes its own partitions of ``deltas`` and then those days of ``history`` that it touches, both by dynamic
partition overwrite. What a batch holds is fixed in the checkpoint before it runs, so a batch that runs again after
a failure writes the same partitions again, and late commits only rewrite their days. Commits without a time are left out.
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

from echofold.operators.history import DAILY, daily, merged

CONFIG = Path(__file__).with_suffix(".json")
DELTAS = DAILY + ", batch bigint"
log = logging.getLogger("commit_history")


def settings(path: str | os.PathLike = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def history(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(f"{out}/history")


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows`` in place of those partitions of the table that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(commits: DataFrame, number: int, out: str) -> None:
    """Add one batch of commits (path, ts)."""
    spark = commits.sparkSession
    new = daily(commits).withColumn("batch", F.lit(number).cast("bigint"))
    replace_partitions(new.hint("rebalance", "day"), f"{out}/deltas", "day", "batch")
    deltas = spark.read.schema(DELTAS).parquet(f"{out}/deltas")
    mine = deltas.where(F.col("batch") == number)
    touched = mine.select("day").distinct()
    replace_partitions(merged(deltas.join(touched, "day", "left_semi")).hint("rebalance", "day"), f"{out}/history", "day")
    of = mine.agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("commits"), F.count_distinct("day").alias("days")).first()
    log.info("batch %d: read %d commits, wrote %d days to %s/history", number, of["commits"], of["days"], out)


def run(spark: SparkSession, commits: str, out: str, config: dict | None = None) -> DataFrame:
    """Take all new files of ``commits``, and return the whole history."""
    config = config or settings()
    schema = spark.read.parquet(commits).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(commits)
    rows = rows.selectExpr(f"{config['commit']['path']} AS path", f"{config['commit']['ts']} AS ts")
    writer = rows.writeStream.foreachBatch(lambda batch, number: take(batch, number, out)).trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{out}/progress").start()
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("%s: %d new commits of %s", out, taken, commits)
    return history(spark, out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("--commits", "--out"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("commit history").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.commits, args.out, settings(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
