"""Source trees, git history and labelled corpora as DataFrames."""

from __future__ import annotations

import json
import logging
import re
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import LANGUAGE_OF, language_of_path
from ..runtime import stored
from .trees import GitLog, SourceTree, git

log = logging.getLogger(__name__)

# Folders that a scan, and the candidate miner, leave out; marks of test paths.
SKIPPED = """
.git .hg .svn node_modules dist build out vendor __pycache__ .venv venv .tox .mypy_cache .pytest_cache
.next .nuxt coverage site-packages .terraform
""".split()
MINER_SKIPPED = "node_modules .git dist build vendor __pycache__ .venv migrations".split()
TEST_MARKS = ["/test/", "/tests/", "/spec/", "/__tests__/", "/fixtures/", "test_", "_test.", ".test.", ".spec.", "conftest.py"]
MINER_SUFFIXES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}


@F.pandas_udf(T.StringType())
def lenient_utf8(content: pd.Series) -> pd.Series:
    """Bytes as text; what is not UTF-8 becomes the replacement character."""
    return content.map(lambda b: bytes(b).decode("utf-8", errors="replace") if b is not None else None)


def path_order(path: Column) -> Column:
    """Orders paths by their components."""
    return F.split(path, "/")


def listed(spark: SparkSession, root: str, skipped: list[str] = SKIPPED) -> DataFrame:
    """path, source, language, problem of every supported file below a folder that all executors see."""
    spark.dataSource.register(SourceTree)
    where = spark.read.format("source_tree").option("root", str(Path(root).resolve())).option("skipped", json.dumps(list(skipped)))
    return where.option("partitions", 4 * spark.sparkContext.defaultParallelism).load()


def files(spark: SparkSession, root: str, skipped: list[str] = SKIPPED) -> DataFrame:
    """path (relative), source, language of every supported file below ``root``; what cannot be read is left out."""
    if "://" in root:
        return stored_files(spark, root, skipped)
    return listed(spark, root, skipped).where("problem is null").select("path", "source", "language")


def stored_files(spark: SparkSession, root: str, skipped: list[str] = SKIPPED) -> DataFrame:
    """The same of a store that only Spark reads. Spark lists it whole and leaves empty files out; names are filtered before contents are read."""
    base = re.sub("^([a-z0-9]+):/+", r"\1:/", root.rstrip("/"))  # file:/x and file:///x are one place
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in x) for x in sorted(LANGUAGE_OF)) + "}").load(root)
    location = F.regexp_replace(F.col("path"), "^([a-z0-9]+):/+", "$1:/")
    relative = F.substring(location, len(base) + 2, 1 << 20)
    folders = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    kept = found.where(language_of_path(relative).isNotNull() & ~F.arrays_overlap(folders, F.array(*map(F.lit, skipped))))
    return kept.select(relative.alias("path"), lenient_utf8("content").alias("source"), language_of_path(relative).alias("language"))


def is_test_path(path: Column) -> Column:
    whole = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | whole.contains(mark)
    return out


def miner_files(tree: DataFrame, include_tests: bool = False) -> DataFrame:
    """Of files (path, source) those that the miner reads: its own suffixes, in this case only."""
    suffix = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)
    language = F.element_at(F.create_map(*[F.lit(x) for kv in MINER_SUFFIXES.items() for x in kv]), suffix)
    rows = tree.withColumn("language", language).where("language is not null").where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, MINER_SKIPPED))))
    return rows if include_tests else rows.where(~is_test_path(F.col("path")))


def chunks(tree: DataFrame, min_lines: int = 5) -> DataFrame:
    """Heuristic chunks: from a line that starts a function to the line before the next such line."""
    line = F.ltrim(F.regexp_replace("line", "^\\s+", ""))
    starts = F.lit(False)
    for prefix in ("def ", "async def ", "function ", "export function "):
        starts = starts | line.startswith(prefix)
    arrow = line.contains("=>") & (line.startswith("const ") | line.startswith("export const "))
    lines = tree.select("path", "language", F.split(F.regexp_replace("source", "\n$", ""), "\n").alias("lines"))
    heads = lines.select("path", "language", F.posexplode("lines").alias("at", "line")).where(starts | arrow)
    n = lines.select("path", F.size("lines").alias("n_lines"))
    after = F.lead("at").over(Window.partitionBy("path").orderBy("at"))
    spans = heads.withColumn("next", after).join(n, "path")
    spans = spans.select("path", "language", F.substring(F.trim("line"), 1, 60).alias("name"), (F.col("at") + 1).alias("start_line"), F.coalesce("next", "n_lines").alias("end_line"))
    spans = spans.where(F.col("end_line") - F.col("start_line") + 1 >= min_lines)
    return spans.join(lines.select("path", "lines"), "path").withColumn("text", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).drop("lines")


def git_log(spark: SparkSession, root: str, days: int | None = 90) -> DataFrame:
    """path, ts: one row for each file of each commit of the last ``days`` (None: of all, as ``last_touched``
    needs them), read by ranges of commits. A folder without history has none, and the log says why."""
    try:
        head = git(root, "rev-parse", "HEAD").strip()
    except RuntimeError as e:
        log.warning("no history of %s: %s", root, e)
        return spark.createDataFrame([], "path string, ts timestamp")
    spark.dataSource.register(GitLog)
    rows = spark.read.format("git_log").option("root", root).option("head", head)
    rows = rows if days is None else rows.option("since", f"{days}.days.ago")
    return rows.load().select("path", F.to_timestamp("committed").alias("ts"))


def churn(commits: DataFrame, since: Column | None = None) -> DataFrame:
    """path, commits."""
    rows = commits if since is None else commits.where(F.col("ts") >= since)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def last_touched(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.max("ts").alias("ts"))


# The fields of a labelled pair.
SIDE = "struct<kind: string, name: string, text: string, repo: string, commit: string, path: string, start_line: int, end_line: int, license: string>"
PAIR = f"pair_id string, split string, language string, label string, should_consolidate string, exclusion string, left {SIDE}, right {SIDE}, notes string, candidate_similarity double"


def lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """file, line (from 1), value of all lines of the files below ``root`` that fit the pattern.

    Files are read in splits. Rows of a split are numbered as they come, the lines of the splits before are added: one
    number a split, not a file in one task.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.withColumn("before", before), ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def corpus(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Labelled pairs of all .jsonl files below root; blank and ``//`` lines are skipped, a bad line fails with its place."""
    rows = lines(spark, root, "*.jsonl").where("trim(value) <> '' and not startswith(ltrim(value), '//')")
    parsed = F.from_json("value", f"{PAIR}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("p", parsed)
    bad = F.col("p").isNull() | F.col("p._bad").isNotNull() | F.col("p.pair_id").isNull()
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": not a labelled pair"))
    # The check is part of the column that is read on, so no plan leaves it out.
    rows = rows.select(F.when(bad, F.raise_error(place).cast("struct<" + PAIR + ", _bad: string>")).otherwise(F.col("p")).alias("p")).select("p.*").drop("_bad")
    rows = rows.withColumn("should_consolidate", F.coalesce("should_consolidate", F.lit("not_applicable")))
    return rows if split is None else rows.where(F.col("split") == split)


def side_text(side: str, fetched: DataFrame | None, pairs: DataFrame, out: str) -> DataFrame:
    """Adds the text of a side: inline, or lines start..end of a fetched file (repo, commit, path, source)."""
    s = F.col(side)
    if fetched is None:
        return pairs.withColumn(out, s["text"])
    f = fetched.select(F.col("repo").alias("_r"), F.col("commit").alias("_c"), F.col("path").alias("_p"), "source")
    rows = pairs.join(f, (s["repo"] == F.col("_r")) & (s["commit"] == F.col("_c")) & (s["path"] == F.col("_p")), "left")
    lines = F.slice(F.split("source", "\n"), s["start_line"], s["end_line"] - s["start_line"] + 1)
    return rows.withColumn(out, F.coalesce(s["text"], F.array_join(lines, "\n"))).drop("_r", "_c", "_p", "source")


def coherent() -> Column:
    """Whether a pair's label, advice and exclusion agree."""
    label, should = F.col("label"), F.col("should_consolidate")
    fits = F.when(label == "not_duplicate", should == "not_applicable").otherwise(should.isin("consolidate", "leave_alone"))
    return label.isin("duplicate", "not_duplicate") & fits & (F.col("exclusion").isNotNull() == (should == "leave_alone"))


def gates(path: str) -> dict[str, float]:
    """Thresholds of a TOML file, its nested tables flattened."""
    def flat(x: dict) -> dict[str, float]:
        out = {}
        for k, v in x.items():
            out |= flat(v) if isinstance(v, dict) else {k: float(v)} if isinstance(v, (int, float)) and not isinstance(v, bool) else {}
        return out

    return flat(tomllib.loads(Path(path).read_text(encoding="utf-8")))


def repo_findings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(findings, kloc) of folders that hold findings.jsonl and manifest.json: repo, seq (file order), label."""
    repo = F.element_at(F.split("file", "/"), -2)
    rows = lines(spark, root, "findings.jsonl").where("trim(value) <> ''")
    rows = rows.select(repo.alias("repo"), F.col("line").alias("seq"), F.from_json("value", "label boolean").alias("j")).select("repo", "seq", "j.label")
    manifest = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").option("multiLine", True).schema("repo string, kloc double").json(root)
    return rows, manifest.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("repo"), "kloc")
