"""Session settings, shared storage and table access used by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; one of our own where none is set and Spark runs
    in this process (tests). On a cluster no folder of this machine will do, so it has to be set."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="echofold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Tables written within the innermost open ``scratch`` block of this thread.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Drops the tables that are ``stored`` within the block, but for those to be kept, when it ends."""
    tables: list[DataFrame] = []
    outer = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(outer)
        release(*tables)


def stored(df: DataFrame, label: str = "t", kept: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A written table survives lost executors and keeps column pruning; ``release`` drops it, or the end of a
    ``scratch`` block that it is not to be kept beyond.
    """
    path = f"{shared_dir(df.sparkSession)}/echofold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._echofold_path = path
    tables = _scope.get()
    if tables is not None and not kept:
        tables.append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_echofold_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows, where the session has the default of 10000: rows are whole texts
    here, and a batch is held several times over on its way to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, "1000")


def width(spark: SparkSession) -> int:
    """Reduce-side parallelism of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
