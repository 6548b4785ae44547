"""Detector quality: confusion, ratios, precision at k, and checks of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .judge import DUPLICATE, UNCERTAIN


def confusion(judged: DataFrame, actual: Column, verdict: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, uncertain. Only a duplicate verdict counts as positive."""
    said = verdict == DUPLICATE
    return judged.agg(
        F.count_if(actual & said).alias("tp"), F.count_if(~actual & said).alias("fp"), F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"), F.count_if(verdict == UNCERTAIN).alias("uncertain"),
    )


def scores(counts: DataFrame) -> DataFrame:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def advisability(judged: DataFrame) -> DataFrame:
    """Of true duplicates with a known should_consolidate: how often advice agrees. Columns: label,
    should_consolidate, recommended."""
    known = (F.col("label") == DUPLICATE) & (F.col("should_consolidate") != "not_applicable") & F.col("recommended").isNotNull()
    right = known & (F.col("recommended") == (F.col("should_consolidate") == "consolidate"))
    return judged.agg(F.count_if(known).alias("n"), F.count_if(right).alias("n_right")).withColumn("accuracy", ratio(F.col("n_right"), F.col("n")))


def precision_at_k(findings: DataFrame, kloc: DataFrame, k: int = 20, by: str = "repo", order: str = "seq") -> DataFrame:
    """findings: repo, seq (file order), label boolean (null: unlabelled). kloc: repo, kloc.

    All findings are counted map-side; only the first k of a repo, in each task, go on to be ranked.
    """
    from pyspark.sql import Window

    first = findings.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("n") <= k)
    top = first.groupBy(by).agg(F.count("label").alias("labelled"), F.count_if("label").alias("tp"))
    out = findings.groupBy(by).agg(F.count(F.lit(1)).alias("surfaced")).join(top, by)
    return out.join(kloc, by).select(by, "surfaced", "labelled", "tp", ratio(F.col("tp"), F.col("labelled")).alias("precision_at_k"), ratio(F.col("surfaced"), F.col("kloc")).alias("per_kloc"))


def pair_fingerprint(left: Column, right: Column) -> Column:
    """The same for a pair and its mirror."""
    return F.array_join(F.array_sort(F.array(F.sha2(left, 256), F.sha2(right, 256))), "|")


def split_leakage(pairs: DataFrame) -> DataFrame:
    """Fingerprints that both splits hold; pairs: split, left_text, right_text."""
    rows = pairs.select("split", pair_fingerprint(F.col("left_text"), F.col("right_text")).alias("fingerprint"))
    return rows.where("split = 'train'").select("fingerprint").intersect(rows.where("split = 'holdout'").select("fingerprint"))


def repeated_ids(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def composition(pairs: DataFrame) -> DataFrame:
    """One row of shares and distinct counts of a corpus."""
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("pairs"), (F.count_if(F.col("label") == DUPLICATE) / n).alias("duplicate_share"), (F.count_if(F.col("split") == "holdout") / n).alias("holdout_share"),
        F.countDistinct("exclusion").alias("exclusions"), F.countDistinct("language").alias("languages"),
    )


def meets_gates(score: DataFrame, min_precision: float, min_recall: float) -> DataFrame:
    return score.withColumn("passed", (F.col("precision") >= F.lit(min_precision)) & (F.col("recall") >= F.lit(min_recall)))
