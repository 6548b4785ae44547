"""A near-match index in the state of a stream (an addition of ours): one row of state a bucket, not a copy of the index.

A unit's signature is cut into bands, and a stream keyed by (band, key) keeps for every bucket its representative, the unit with the
smallest id of the micro-batch that opened it. Later units of the bucket are compared with the representative and leave no state, so
state grows with new buckets only. Signatures are folded before the shuffle: of the units of an Arrow batch with the same
signature only the first goes on, and the others follow it, so a large group of copies sends few rows to its buckets.
A bucket's new rows of one micro-batch are held by one task: ``maxFilesPerTrigger`` of the source is their bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fingerprint import band_keys

MATCH = "id bigint, match bigint, estimated double"
COPIES = -1  # stands for the band of units that follow a copy


def folded(signed: DataFrame) -> DataFrame:
    """id, signature, follows: of the units of an Arrow batch with one signature, all but the first follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["id", "signature"]).to_pandas()
            rows["shape"] = [np.asarray(s).tobytes() for s in rows["signature"]]
            first = rows.groupby("shape")["id"].transform("min")
            out = pd.DataFrame({"id": rows["id"], "signature": rows["signature"], "follows": first.where(first != rows["id"])}).astype({"follows": "Int64"})
            yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("id", pa.int64()), ("signature", pa.list_(pa.int64())), ("follows", pa.int64())]), preserve_index=False)

    return signed.select("id", "signature").mapInArrow(run, "id bigint, signature array<bigint>, follows bigint")


def _meet(floor: float):
    def meet(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] == COPIES:
            for rows in chunks:
                yield pd.DataFrame({"id": rows["id"], "match": rows["follows"].astype("int64"), "estimated": 1.0})
            return
        chunks = list(chunks)
        rows = chunks[0] if len(chunks) == 1 else pd.concat(chunks)
        ids, signatures = rows["id"].to_numpy(), np.stack(rows["signature"].to_numpy())
        if state.exists:
            first, signature = state.get
        else:
            at = int(ids.argmin())
            first, signature = int(ids[at]), signatures[at].tolist()
            state.update((first, signature))
            if len(ids) == 1:
                return
        alike = (signatures == np.asarray(signature)).mean(axis=1)
        hit = (alike >= floor) & (ids != first)
        yield pd.DataFrame({"id": ids[hit], "match": first, "estimated": alike[hit]})

    return meet


def matches(signed: DataFrame, permutations: int, bands: int, floor: float = 0.8) -> DataFrame:
    """id, match, estimated for a stream of units (id, signature): every unit with the representatives of its buckets that
    are alike enough, and copies with the unit that they follow (estimated 1). Units without id are left out."""
    rows = folded(signed.where("id is not null"))
    # Copies pass by the buckets, through groups of no state: a second branch of the plan would sign all units again.
    aside = F.array(F.struct(F.lit(COPIES).alias("band"), F.pmod(F.xxhash64("id"), F.lit(1 << 16)).cast("string").alias("key")))
    of = F.when(F.col("follows").isNull(), band_keys(F.col("signature"), permutations, bands)).otherwise(aside)
    keyed = rows.select("id", "signature", "follows", F.explode_outer(of).alias("b")).select("id", "signature", "follows", "b.band", "b.key")
    return keyed.groupBy("band", "key").applyInPandasWithState(_meet(floor), MATCH, "first bigint, signature array<bigint>", "append", GroupStateTimeout.NoTimeout)


def start(found: DataFrame, folder: str) -> StreamingQuery:
    """Append the matches of all that is new to ``folder``/matches, then stop."""
    sink = found.writeStream.format("parquet").option("path", f"{folder}/matches").option("checkpointLocation", f"{folder}/progress")
    return sink.outputMode("append").trigger(availableNow=True).start()


def first_matches(found: DataFrame) -> DataFrame:
    """id, match: the smallest match of each unit; one that follows a copy has the copy's match, if that has one."""
    least = found.groupBy("id").agg(F.min("match").alias("match"))
    of = least.select(F.col("id").alias("match"), F.col("match").alias("further"))
    follows = found.where("estimated = 1").groupBy("id").agg(F.min("match").alias("match"))
    led = follows.join(of.hint("merge"), "match").select("id", F.col("further").alias("match"))
    return least.unionByName(led).groupBy("id").agg(F.min("match").alias("match"))
