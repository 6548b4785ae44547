"""The audit: source tree -> units -> candidates -> findings -> ranked clusters -> report."""

from __future__ import annotations

import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..operators import candidates as cand
from ..operators import clusters, graph, judge
from ..operators.fingerprint import BANDS, PERMUTATIONS, with_signature
from ..operators.judge import Detector, detectors, paired, surfaceable
from ..runtime import scratch, stored
from ..sources import files as tree
from ..sources import units as parsing

SCHEMA_VERSION = "echofold.audit/v1"


def identified(units: DataFrame) -> DataFrame:
    """Adds ``id``: the rank by (path components, start, end, name), dense from 0."""
    order = [tree.path_order(F.col("path")), F.col("start_line"), F.col("end_line"), F.col("name")]
    # Ranks by range partitions: counts of the partitions before, then the place in the own one.
    parted = units.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, as a task that is run again would sample its ranges anew.
    parted = stored(parted.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = parted.join(F.broadcast(offsets), "_part")  # one row a partition
    return out.withColumn("id", F.col("before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "n", "before")


def signed(units: DataFrame, width: int = 4, permutations: int = PERMUTATIONS) -> DataFrame:
    """id, signature of the renamed stream's shingles, whatever detector judges later."""
    shingles = lexical.shingles(lexical.renamed(lexical.tokens(F.col("text"))), width)
    return with_signature(units.select("id", shingles.alias("hashes")), permutations=permutations)


def detect(units: DataFrame, detector: Detector | None = None, budget: int = cand.BUDGET, max_bucket: int = cand.MAX_BUCKET) -> tuple[DataFrame, cand.CandidateSet]:
    """(surfaceable findings with l and r, candidates) of identified units."""
    detector = detector or detectors()["renamed"]
    found = cand.generate(signed(units), PERMUTATIONS, BANDS, budget, max_bucket)
    prepared = stored(detector.prepare(judge.involved(found.pairs, units)), "units")
    return surfaceable(detector.judge(paired(found.pairs, prepared))), found


def scan(
    spark: SparkSession, root: str, detector: str = "renamed", min_lines: int = parsing.MIN_LINES, budget: int = cand.BUDGET,
    use_git: bool = True, top: int | None = None, tool_version: str = "1.0.0",
) -> dict:
    """The report of a directory as one document (a dict with sorted, stable content but for time)."""
    with scratch():
        return _scan(spark, root, detector, min_lines, budget, use_git, top, tool_version)


def _scan(spark: SparkSession, root: str, detector: str, min_lines: int, budget: int, use_git: bool, top: int | None, tool_version: str) -> dict:
    started = time.perf_counter()
    where = str(Path(root).resolve())
    files = stored(tree.files(spark, where), "files")
    parsed = stored(parsing.extracted(files), "parsed")
    own = parsed if min_lines == parsing.MIN_LINES else parsing.extracted(files, min_lines)
    units = stored(identified(parsing.kinds(own)["units"]), "identified")
    findings, found = detect(units, detectors()[detector], budget)
    findings = stored(findings, "findings")
    # The graph sees units of the default length, whatever the scan's own.
    g = graph.build(files, **parsing.kinds(parsed))
    unresolved = stored(g.unresolved, "unresolved")
    log = tree.git_log(spark, where) if use_git else None
    churn = tree.churn(log) if log is not None else None
    known = churn is not None and not churn.isEmpty()

    members = stored(clusters.members(findings, units), "members")
    radius = clusters.blast_radius(members, g.references, unresolved, churn if known else None)
    ranked = clusters.ranked(radius, top)
    unit = F.struct("path", "start_line", "end_line", "name", "language")
    listed = members.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", unit.alias("unit")))), lambda x: x["unit"]).alias("units_listed"))
    side = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("path", "start_line", "end_line", "name", "language")]).alias(s)
    shown = clusters.evidence(findings, members).select("cluster_id", "rank", F.struct(side("left"), side("right"), "structural", "textual", "rationale").alias("e"))
    shown = shown.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "e"))).alias("evidence"))
    rows = ranked.join(listed, "cluster_id").join(shown, "cluster_id", "left").join(clusters.blocked_reasons(members, unresolved), "cluster_id", "left").collect()
    rows.sort(key=lambda r: (-r["score"], r["cluster_id"]))
    c = clusters.coverage(units, files, unresolved, found.considered, found.truncated).first().asDict()
    c["unresolved_by_reason"] = {r["reason"]: r["n"] for r in sorted(g.by_reason().collect())}
    c |= {"churn_available": known, "oversized_buckets": found.oversized_buckets, "pairs_judged": found.kept}
    return {
        "schema_version": SCHEMA_VERSION, "tool_version": tool_version, "generated_at": datetime.now(UTC).isoformat(timespec="seconds"),
        "root": where, "detector": detectors()[detector].name, "duration_seconds": round(time.perf_counter() - started, 2),
        "coverage": c, "clusters": [_cluster(r, known, detectors()[detector].name) for r in rows],
    }


def _cluster(r, churn_known: bool, method: str) -> dict:
    return {
        "cluster_id": r["cluster_id"], "units": [u.asDict() for u in r["units_listed"]], "removable_lines": r["removable_lines"], "call_sites": r["call_sites"],
        "churn": r["churn"] if churn_known else None, "score": round(r["score"], 2), "score_method": r["score_method"], "safely_remediable": r["unresolved_paths"] == 0,
        "blocked_reasons": r["reasons"] or [], "evidence": [_evidence(x["e"], method) for x in r["evidence"] or []],
    }


def _evidence(e, method: str) -> dict:
    return {
        "left": e["left"].asDict(), "right": e["right"].asDict(), "structural_percent": round(100 * e["structural"]), "structural_method": method,
        "textual_percent": round(100 * e["textual"]), "textual_method": "token-jaccard", "rationale": e["rationale"],
    }
