"""Pair detectors and adjudication: from measured pairs to findings.

A detector is a function from pairs with prepared unit columns to the same rows with ``structural``,
``textual``, ``verdict``, ``advice`` and ``rationale``. Measures are named and never combined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.scalars import percent

DUPLICATE, UNCERTAIN, NOT_DUPLICATE = "duplicate", "uncertain", "not_duplicate"
# Why a true duplicate may be left alone, and the fields of an adjudication.
EXCLUSIONS = ["below_size_floor", "generated_or_vendored", "cross_boundary", "diverged_history", "unresolved_call_sites", "requires_flag_param"]
ADJUDICATION_FIELDS = ["verdict", "confidence", "behavior_summary", "consolidation_recommended", "exclusion", "rationale"]
ADJUDICATION = "verdict string, confidence string, behavior_summary string, consolidation_recommended boolean, exclusion string, rationale string"


def verdict(similarity: Column, threshold: float, band: float) -> Column:
    """Doubles throughout: 0.8 - 0.1 is a little more than 0.7."""
    return F.when(similarity >= F.lit(threshold), DUPLICATE).when(similarity >= F.lit(threshold - band), UNCERTAIN).otherwise(NOT_DUPLICATE)


def advice(verdict: Column) -> Column:
    """A duplicate found by measures alone is not recommended for merging: its callers are unknown."""
    return F.when(
        verdict == DUPLICATE,
        F.struct(F.lit(False).alias("recommended"), F.lit("unresolved_call_sites").alias("exclusion"), F.lit("call sites were not looked at").alias("rationale")),
    )


def rationale(structural: Column, textual: Column) -> Column:
    return F.format_string("structural %d%%, textual %d%%", percent(structural), percent(textual))


@dataclass(frozen=True)
class Detector:
    """Judges by the Jaccard similarity of shingles of a normalised stream; equal hashes are 1.0 at once."""

    name: str
    threshold: float
    band: float
    width: int
    stream: Callable[[Column], Column]

    def prepare(self, units: DataFrame, text: str = "text") -> DataFrame:
        """Adds what judging needs, once for each unit: shingle, hash and raw token columns."""
        raw = lexical.tokens(F.col(text))
        stream = self.stream(raw)
        return units.withColumns({"shingles": lexical.shingles(stream, self.width), "shape": lexical.structural_hash(stream), "raw": F.array_distinct(raw)})

    def judge(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` have structs ``left`` and ``right`` of prepared units."""
        equal = F.col("left.shape") == F.col("right.shape")
        structural = F.when(equal, F.lit(1.0)).otherwise(lexical.jaccard(F.col("left.shingles"), F.col("right.shingles")))
        out = pairs.withColumn("structural", structural).withColumn("textual", lexical.jaccard(F.col("left.raw"), F.col("right.raw")))
        out = out.withColumn("verdict", verdict(F.col("structural"), self.threshold, self.band))
        return out.withColumns({"advice": advice(F.col("verdict")), "rationale": rationale(F.col("structural"), F.col("textual"))})


#: ``renamed`` and ``flat`` read lexical tokens, so their scores are not those of a syntax tree.
_DETECTORS = {
    "baseline": Detector("token-overlap", 0.80, 0.10, 3, lexical.normalized),
    "renamed": Detector("lexical-renamed", 0.70, 0.10, 4, lexical.renamed),
    "flat": Detector("lexical-flat", 0.70, 0.10, 4, lexical.normalized),
    "raw": Detector("raw-shingles", 0.80, 0.10, 4, lambda t: t),
}


def detectors() -> dict[str, Detector]:
    """All detectors by the name that the command line and ``scan`` know them by."""
    return dict(_DETECTORS)


def register(key: str, detector: Detector) -> None:
    """Add a detector, or anything with its name, ``prepare`` and ``judge``. A key that is taken stays as it is: ValueError."""
    if key in _DETECTORS:
        raise ValueError(f"there is a detector {key} already")
    _DETECTORS[key] = detector


def involved(pairs: DataFrame, units: DataFrame, key: str = "id") -> DataFrame:
    """The units that a pair (l, r) names."""
    ends = pairs.select(F.col("l").alias(key)).unionByName(pairs.select(F.col("r").alias(key))).distinct()
    return units.join(ends, key, "left_semi")


def paired(pairs: DataFrame, units: DataFrame, key: str = "id") -> DataFrame:
    """Pairs (l, r) with both prepared units; the planner picks the join."""
    whole = F.struct(*units.columns)
    left = units.select(F.col(key).alias("l"), whole.alias("left"))
    right = units.select(F.col(key).alias("r"), whole.alias("right"))
    return pairs.join(left, "l").join(right, "r")


def surfaceable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("verdict") == DUPLICATE)


def remediable(findings: DataFrame) -> DataFrame:
    return surfaceable(findings).where(F.coalesce(F.col("advice.recommended"), F.lit(False)))


def adjudications(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Parsed payloads and whether they are valid: known fields only, lengths, coherent advice."""
    a = F.col("adjudication")
    keys = F.array_sort(F.json_object_keys(F.col(column)))
    known = F.size(F.array_except(keys, F.array(*map(F.lit, ADJUDICATION_FIELDS)))) == 0
    sound = (
        a["verdict"].isin(DUPLICATE, UNCERTAIN, NOT_DUPLICATE)
        & a["confidence"].isin("low", "medium", "high")
        & F.length(a["behavior_summary"]).between(1, 600)
        & F.length(a["rationale"]).between(1, 1200)
        & a["consolidation_recommended"].isNotNull()
        & (a["exclusion"].isNull() | a["exclusion"].isin(EXCLUSIONS))
    )
    coherent = F.when(a["verdict"] == DUPLICATE, a["consolidation_recommended"] == a["exclusion"].isNull()).otherwise(~a["consolidation_recommended"] & a["exclusion"].isNull())
    return raw.withColumn("adjudication", F.from_json(column, ADJUDICATION)).withColumn("valid", F.coalesce(known & sound & coherent, F.lit(False)))


def adjudicated(pairs: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Verdicts from adjudications: none, an invalid one or one of low confidence is uncertain."""
    rows = pairs.join(answers.where("valid").select(*on, "adjudication"), on, "left")
    a = F.col("adjudication")
    rows = rows.withColumn("verdict", F.when(a.isNull() | (a["confidence"] == "low"), UNCERTAIN).otherwise(a["verdict"]))
    given = F.struct(a["consolidation_recommended"].alias("recommended"), a["exclusion"].alias("exclusion"), a["rationale"].alias("rationale"))
    return rows.withColumn("advice", F.when(F.col("verdict") == DUPLICATE, given))


def framed(left: Column, right: Column, nonce: Column, limit: int = 8000) -> Column:
    """The prompt's body: both texts, clipped, between markers that carry a nonce."""
    from ..functions.scalars import clipped

    mark = "\n[truncated]"
    return F.concat(F.lit("<left-"), nonce, F.lit(">\n"), clipped(left, limit, mark), F.lit("\n</left-"), nonce, F.lit(">\n<right-"), nonce, F.lit(">\n"), clipped(right, limit, mark), F.lit("\n</right-"), nonce, F.lit(">"))


def token_budget(calls: DataFrame, limit: int, order: str = "seq", cost: str = "tokens", by: str = "run") -> DataFrame:
    """Adds ``spent`` before each call of a run and whether it may still be made."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).withColumn("allowed", F.col("spent") < limit)
