"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

All runs of GRAM bytes of a text get a rolling hash; of every WINDOW consecutive ones the least is selected,
the rightmost of equal ones, and kept with its position. Whatever two texts share over GRAM + WINDOW - 1 bytes
or more holds a whole window of both, so it gives them a selected gram in common, at the same place of the
run: that is the guarantee, and the positions say where. A text of fewer grams than a window is one
window; a text shorter than a gram is one gram; an empty text has no selections.

As a string a fingerprint is base64 of five bytes a selection: how far it lies behind the one before (the first:
behind -1), which is at most WINDOW, and its hash in 32 bits, big-endian. ``decoded`` reads it. Likeness is the Jaccard
similarity of the sets of selected hashes; of two empty fingerprints it is 1, of one empty and another 0.

``with_next`` brings every document together with the next one in ascending order of ids, once: rows are dealt to
ranges of (doc_id, hash of the text) and sorted on disk there, and each range gets the first row of the range
behind it as a guest. Texts move once; the driver sees one key a range.

Defined results: a null text is empty; rows without doc_id come first; rows of one doc_id follow in the order of the hash of their text;
equal rows are neighbours of each other (and stay in one range, which is read as a stream); a table of one row is its own next;
an empty table gives nothing; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import text_batches, width
from .words import BLOCK, byte_table, mix, powers, trimmed

GRAM, WINDOW = 12, 32
#: Bytes of text in a range, about; a task sorts one range.
RANGE_BYTES = 32 << 20
BASE = 0xB5AD4ECEDA1CE2A9
#: The order of documents: rows without doc_id first, then by doc_id and the hash of the text.
KEYS = ["known", "id", "h"]


class Winnower:
    """Selections of texts; blocks of a text are hashed at a time, so a long text needs little more than its selections."""

    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        if not (gram > 0 and 0 < window < 256):
            raise ValueError("a gram has at least one byte, and a window 1 to 255 grams")
        self.gram, self.window = gram, window
        self.table = byte_table(False)
        self.up, self.down = powers(BASE, BLOCK + gram + window)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """Rolling hashes in 32 bits of all grams of a block of bytes, the same wherever a gram stands."""
        k = min(self.gram, len(raw))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * self.down[: len(raw) - k + 1] + np.uint64(k)) >> np.uint64(32)

    def _least(self, keys: np.ndarray) -> np.ndarray:
        """Least key of every window, from running minima forwards and backwards within runs of a window's length."""
        w = self.window
        if len(keys) <= w:
            return keys.min(keepdims=True)
        padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        runs = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(runs, axis=1).reshape(-1)
        behind = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(keys) - w + 1
        return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes uint32, positions int64 in bytes) of the selected grams, in order of position."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        grams = max(1, len(raw) - self.gram + 1)
        windows = max(1, grams - self.window + 1)
        low = np.uint64(0xFFFFFFFF)
        hashes, places = [], []
        for start in range(0, windows, BLOCK):
            stop = min(start + BLOCK, windows)
            h = self.hashes(raw[start : stop + self.window + self.gram - 2])
            # Hash above, place counted from the end below: the least is the rightmost of equal hashes.
            least = self._least((h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64)))
            least = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
            at = (low - (least & low)).astype(np.int64) + start
            if places and at[0] == places[-1][-1]:
                least, at = least[1:], at[1:]
            hashes.append((least >> np.uint64(32)).astype(np.uint32))
            if len(at):
                places.append(at)
        return np.concatenate(hashes), np.concatenate(places)


def encoded(hashes: np.ndarray, places: np.ndarray) -> str:
    rows = np.empty(len(hashes), dtype=[("step", "u1"), ("hash", ">u4")])
    rows["step"] = np.diff(places, prepend=-1)
    rows["hash"] = hashes
    return base64.b64encode(rows.tobytes()).decode("ascii")


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint's string."""
    rows = np.frombuffer(base64.b64decode(fingerprint), dtype=[("step", "u1"), ("hash", ">u4")])
    return rows["hash"].astype(np.uint32), np.cumsum(rows["step"], dtype=np.int64) - 1


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def selections(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, position (in bytes of UTF-8), hash: one row a selected gram of each text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, position bigint, hash bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(gram, window)
        for batch in batches:
            ids = batch.column("doc_id")
            for i, text in enumerate(batch.column("text")):
                hashes, places = winnow((text.as_py() or "").encode())
                if len(hashes):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(hashes), i))), pa.array(places), pa.array(hashes.astype(np.int64))], names=["doc_id", "position", "hash"])

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def with_next(docs: DataFrame, digest, schema: str) -> DataFrame:
    """``digest(pairs)`` over all rows, where pairs are (doc_id, text, text of the next document); it yields
    tuples of ``schema``.

    A range starts at the least key of a partition of Spark's own range partitioning; the starts are fixed on the
    driver, so that a task that runs again sees the same ranges.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("*", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("h"))
    size = keyed.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    wanted = max(width(spark), size // RANGE_BYTES + 1)
    least = keyed.select(*KEYS).repartitionByRange(wanted, *KEYS).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEYS)).alias("least"))
    starts = sorted(tuple(r) for r in least.select("least.*").distinct().collect())

    @F.pandas_udf("int")
    def range_of(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(starts, key) - 1 for key in zip(known, ids, hashes)], dtype="int32")

    # The first row of each range is the guest of the range before it; the very first, of the last.
    firsts = spark.createDataFrame([(*s, (k - 1) % len(starts)) for k, s in enumerate(starts)], "known boolean, id bigint, h bigint, part int")
    guests = keyed.join(F.broadcast(firsts), KEYS)  # a row for each range
    guests = guests.groupBy("part").agg(F.first(F.struct(*keyed.columns)).alias("row")).select("row.*", "part", F.lit(True).alias("guest"))
    rows = keyed.withColumn("part", range_of(*KEYS)).withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = rows.repartition(max(wanted, len(starts)), "part").sortWithinPartitions("part", "guest", *KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            held = None
            for batch in batches:
                for doc_id, text, part, guest in zip(batch.column("doc_id"), batch.column("text"), batch.column("part"), batch.column("guest")):
                    text, part = text.as_py(), part.as_py()
                    if held is not None and held[2] == part:
                        yield held[0], held[1], text
                    held = None if guest.as_py() else (doc_id.as_py(), text, part)

        rows = []
        for row in digest(pairs()):
            rows.append(row)
            if len(rows) == 256:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    names = to_arrow_schema(StructType.fromDDL(schema))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

    text_batches(spark)
    return dealt.select("doc_id", "text", "part", "guest").mapInArrow(trimmed(run), schema)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many code points from the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row; the
    edited text is that of ``edited`` with the next document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def digest(pairs):
        winnow = Winnower(gram, window)
        known = (None, None)
        for doc_id, text, following in pairs:
            own = known[1] if known[0] is text else winnow(text.encode())
            after = own if following == text else winnow(following.encode())
            known = (following, after)
            changed = edited(text, following).encode()
            other = winnow(changed)
            yield doc_id, len(text), hashlib.sha256(changed).hexdigest(), encoded(*own), encoded(*other), likeness(own[0], other[0]), likeness(own[0], after[0])

    return with_next(docs, digest, schema)
