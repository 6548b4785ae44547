"""Incremental near-match indexes over a stream of units (additions of ours).

Every micro-batch is signed once, met with the bands of all earlier batches and of itself, and added to the
index. Writes carry the batch number and overwrite it, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexical
from ..operators.candidates import buckets
from ..operators.fingerprint import BANDS, PERMUTATIONS, estimated_jaccard, with_signature
from ..runtime import release, stored


class NearMatches:
    """``add`` is a foreachBatch function; units have id and text. Matches: l (earlier or smaller id), r, estimated."""

    def __init__(self, folder: str, floor: float = 0.8, width: int = 4):
        self.folder, self.floor, self.width = folder.rstrip("/"), floor, width

    def add(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shingles = lexical.shingles(lexical.tokens(F.col("text")), self.width)
        signed = with_signature(batch.select("id", shingles.alias("hashes")))
        signed.write.mode("overwrite").parquet(f"{self.folder}/index/batch={number}")
        index = spark.read.parquet(f"{self.folder}/index").where(F.col("batch") <= number)
        new = index.where(F.col("batch") == number)
        old_rows = buckets(index, PERMUTATIONS, BANDS).withColumnRenamed("id", "l")
        new_rows = buckets(new, PERMUTATIONS, BANDS).withColumnRenamed("id", "r")
        pairs = stored(old_rows.join(new_rows, ["band", "key"]).where("l <> r").select("l", "r").distinct(), "pairs")
        left = index.select(F.col("id").alias("l"), F.col("signature").alias("sl"), F.col("batch").alias("bl"))
        both = pairs.join(left, "l").join(new.select(F.col("id").alias("r"), F.col("signature").alias("sr")), "r")
        both = both.where((F.col("bl") < number) | (F.col("l") < F.col("r"))).withColumn("estimated", estimated_jaccard(F.col("sl"), F.col("sr")))
        both.where(F.col("estimated") >= self.floor).select("l", "r", "estimated").write.mode("overwrite").parquet(f"{self.folder}/matches/batch={number}")

    def start(self, units: DataFrame, **options) -> StreamingQuery:
        """Run over all that is there, then stop."""
        return units.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).options(**options).start()

    def matches(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/matches").drop("batch")


class FirstMatches:
    """Matches with the representative of a bucket alone: the unit with the smallest id of the micro-batch that opened it.

    ``add`` is a foreachBatch function; units have id and hashes (array<bigint>). The index has one row a bucket, and units are
    met with it by joins: no work in Python is done for each bucket, and a bucket of n units has n - 1 pairs.
    Matches: id, match, estimated. Units without id are left out.
    """

    def __init__(self, folder: str, permutations: int = PERMUTATIONS, bands: int = BANDS, floor: float = 0.8):
        if permutations % bands:
            raise ValueError(f"{permutations} permutations do not divide into {bands} bands")
        self.folder, self.permutations, self.bands, self.floor = folder.rstrip("/"), permutations, bands, floor

    def _rows(self, signed: DataFrame) -> DataFrame:
        size = self.permutations // self.bands
        keys = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.struct(i.alias("band"), F.slice("signature", i * size + 1, size).alias("key")))
        return signed.select("id", F.inline(keys))

    def add(self, batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, lambda name: f"{self.folder}/{name}/batch={number}"
        with_signature(batch.where("id is not null").select("id", "hashes"), permutations=self.permutations).write.mode("overwrite").parquet(place("signed"))
        units = spark.read.schema("id bigint, signature array<bigint>, batch int").parquet(f"{self.folder}/signed").where(F.col("batch") <= number)
        new = units.where(F.col("batch") == number)
        buckets = self._rows(new).groupBy("band", "key").agg(F.min("id").alias("opened"))
        if number:
            known = spark.read.schema("band int, key array<bigint>, first bigint, batch int").parquet(f"{self.folder}/index").where(F.col("batch") < number)
            buckets = buckets.join(known.drop("batch").hint("merge"), ["band", "key"], "left")
        else:
            buckets = buckets.withColumn("first", F.lit(None).cast("bigint"))
        buckets = stored(buckets, "buckets")
        buckets.where("first is null").select("band", "key", F.col("opened").alias("first")).write.mode("overwrite").parquet(place("index"))
        held = buckets.select("band", "key", F.coalesce("first", "opened").alias("match"))
        met = stored(self._rows(new).join(held.hint("merge"), ["band", "key"]).where("id <> match").select("id", "match").distinct(), "met")
        both = met.join(new.select("id", F.col("signature").alias("s")).hint("merge"), "id")
        both = both.join(units.select(F.col("id").alias("match"), F.col("signature").alias("m")).hint("merge"), "match")
        both = both.select("id", "match", estimated_jaccard(F.col("s"), F.col("m")).alias("estimated")).where(F.col("estimated") >= self.floor)
        both.write.mode("overwrite").parquet(place("matches"))
        release(buckets, met)

    def start(self, units: DataFrame, **options) -> StreamingQuery:
        """Run over all that is there, then stop."""
        return units.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).options(**options).start()

    def matches(self, spark) -> DataFrame:
        return spark.read.schema("id bigint, match bigint, estimated double, batch int").parquet(f"{self.folder}/matches").drop("batch")
