"""The symbol graph as joins over extracted rows.

Inputs (one row each): files (path, language); units (path, name, start_line, end_line); imports (path,
statement, position, local_name, source_name, specifier, line, language); namespaces (path, specifier, line,
language); holes (path, reason, specifier, line); calls (path, name, line).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import let
from ..functions.scalars import bare_name, normal_path, parent_path

EXTERNAL = "external_package"
# Fixed value: the order in which a script import is completed.
SCRIPT_SUFFIXES = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]


def specifier_candidates(rows: DataFrame) -> DataFrame:
    """Adds ``base`` and the ordered ``candidates`` of each (path, specifier, language)."""
    spec, here = F.col("specifier"), parent_path(F.col("path"))
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
    up = F.concat(here, F.lit("/"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    python = normal_path(F.when(dots > 0, up).otherwise(rest))
    script = normal_path(F.concat(here, F.lit("/"), spec))
    tail = F.array(F.lit(""), *map(F.lit, SCRIPT_SUFFIXES), *[F.lit(f"/index{s}") for s in SCRIPT_SUFFIXES])
    is_python = F.col("language") == "python"
    # A normal path is folded from its segments: once a row, not once for each of its candidates.
    candidates = (
        F.when(is_python, let(python, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
        .when(spec.startswith("."), let(script, lambda p: F.transform(tail, lambda t: F.concat(p, t))))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.withColumn("candidates", candidates)


def resolve(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``target`` (the first candidate that is a file) and, without one, ``reason``. Never a guess."""
    keys = ["path", "specifier", "language"]
    asked = specifier_candidates(rows.select(*keys).distinct())
    probes = asked.select(*keys, F.posexplode("candidates").alias("pos", "candidate"))
    hits = probes.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy(*keys).agg(F.min_by("candidate", "pos").alias("target"))
    spec = F.col("specifier")
    reason = (
        F.when(F.col("target").isNotNull(), F.lit(None).cast("string"))
        .when(spec.startswith("."), "missing_target")
        .when((F.col("language") != "python") & (spec.startswith("@") | ~spec.contains("/")), "path_alias")
        .otherwise(EXTERNAL)
    )
    return rows.join(hits, keys, "left").withColumn("reason", reason)


def first_definitions(units: DataFrame) -> DataFrame:
    """path, bare, name, start_line, end_line: the first unit of each bare name in a file."""
    rows = units.withColumn("bare", bare_name(F.col("name")))
    w = Window.partitionBy("path", "bare").orderBy("start_line", "end_line", "name")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("path", "bare", "name", "start_line", "end_line")


@dataclass(frozen=True)
class SymbolGraph:
    definitions: DataFrame
    references: DataFrame
    unresolved: DataFrame

    def call_sites(self, path: str, name: str) -> DataFrame:
        return self.references.where((F.col("target_path") == path) & (F.col("name") == name))

    def call_site_counts(self) -> DataFrame:
        return self.references.groupBy("target_path", "name").agg(F.count(F.lit(1)).alias("calls"))

    def fully_resolved(self, files: DataFrame) -> DataFrame:
        return files.join(self.unresolved.where(F.col("reason") != EXTERNAL).select("path").distinct(), "path", "left_anti")

    def by_reason(self) -> DataFrame:
        return self.unresolved.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def build(files: DataFrame, units: DataFrame, imports: DataFrame, namespaces: DataFrame, holes: DataFrame, calls: DataFrame) -> SymbolGraph:
    definitions = first_definitions(units)
    columns = ["path", "reason", "specifier", "line"]

    spaces = resolve(namespaces, files)
    spaces = spaces.withColumn("reason", F.when(F.col("target").isNotNull(), "namespace_import").otherwise(F.col("reason"))).where(F.col("reason") != EXTERNAL)
    named = resolve(imports, files)
    unresolved = holes.select(*columns).unionByName(spaces.select(*columns)).unionByName(named.where("target is null").select(*columns))

    # Of the resolved imports of a local name the first statement wins, in it the last alias.
    w = Window.partitionBy("path", "local_name").orderBy("statement", F.desc("position"))
    local = named.where("target is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    local = local.select("path", F.col("local_name").alias("name"), "target", F.when(F.col("source_name") == "default", F.col("local_name")).otherwise(F.col("source_name")).alias("bare"))
    d = definitions.select(F.col("path").alias("target"), "bare", "start_line", "end_line")
    remote = local.join(d, ["target", "bare"])

    own = d.select(F.col("target").alias("path"), F.col("bare").alias("name"), F.col("start_line").alias("own_start"), F.col("end_line").alias("own_end"))
    rows = calls.join(own, ["path", "name"], "left").join(remote.select("path", "name", "target", "bare"), ["path", "name"], "left")
    local_hit = F.col("own_start").isNotNull()
    rows = rows.where(local_hit | F.col("target").isNotNull()).where(~(local_hit & F.col("line").between(F.col("own_start"), F.col("own_end"))))
    references = rows.select(
        F.when(local_hit, F.col("name")).otherwise(F.col("bare")).alias("name"),
        F.when(local_hit, F.col("path")).otherwise(F.col("target")).alias("target_path"),
        F.col("path").alias("from_path"), "line",
    )
    return SymbolGraph(definitions, references, unresolved)
