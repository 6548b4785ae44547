"""A bounded sample of labelled texts for a model that is fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import release, stored


def sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int, max_bytes: int) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels to learn from, and the number of labelled rows of each label.

    labels: doc_id and the integer ``column``; rows without either are not learned from, nor are those whose
    crc32(doc_id as text) mod 5 is 0. Of a document with several labels the largest counts. Of each label the
    documents with the smallest hash of the id are taken, at most ``max_rows`` and, whole, as many as keep
    within ``max_bytes`` of text (one at least): these two bound what the driver holds.
    """
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    known = labels.select(doc_id, F.col(column).cast("int").alias("label")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    # Of a crowded label only hashes below a bound that more than max_rows of them are sure to keep to.
    share = {g: min(1.0, (1.25 * max_rows + 200) / n) for g, n in counts.items()}
    bound = F.lit(None).cast("bigint")
    for g, x in share.items():
        bound = F.when(F.col("label") == g, F.lit(min((1 << 63) - 1, int(-(1 << 63) + x * (1 << 64))))).otherwise(bound)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = known.where(F.xxhash64("doc_id") <= bound).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_rows).drop("rank")
    texts = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    picked = stored(texts.join(F.broadcast(first), "doc_id"), "sample")  # max_rows ids of each label
    sizes = picked.groupBy("doc_id", "label").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    fits = sizes.withColumn("upto", F.sum("size").over(order)).where((F.col("upto") <= max_bytes) | (F.col("upto") == F.col("size"))).select("doc_id")
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in picked.join(F.broadcast(fits), "doc_id").toLocalIterator())
    release(picked)
    return [r[1] for r in rows], [r[2] for r in rows], counts
