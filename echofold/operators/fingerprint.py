"""MinHash signatures, similarity estimates and band keys.

A signature is, for each of K functions (a * h + b) mod p with p = 2**61 - 1, the least value over the
base hashes h of a unit's shingles; an empty set has p everywhere. The products need more than 64 bits,
so they are formed from 32-bit halves in numpy, a flattened Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import let
from ..runtime import text_batches

PRIME = (1 << 61) - 1
PERMUTATIONS, BANDS = 128, 32
AT_ONCE = 1 << 16  # strings that are Python objects at a time


def coefficients(n: int) -> list[tuple[int, int]]:
    """n pairs (a, b), a in [1, p-1] and b in [0, p-1], from a fixed rule (no seed of anyone else's)."""
    out = []
    for i in range(n):
        a, b = (int.from_bytes(hashlib.sha256(f"echofold {side} {i}".encode()).digest()[:8], "big") for side in "ab")
        out.append((1 + a % (PRIME - 1), b % PRIME))
    return out


def reduced(x: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.minimum(x, x - p)  # below p the difference wraps to a larger number


def times(a: int, h: np.ndarray) -> np.ndarray:
    """a * h mod p for h < p."""
    low = np.uint64(0xFFFFFFFF)
    ah, al = np.uint64(a >> 32), np.uint64(a & 0xFFFFFFFF)
    hh, hl = h >> np.uint64(32), h & low
    middle = ah * hl + al * hh  # times 2**32
    middle = (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    lowest = al * hl
    lowest = (lowest & np.uint64(PRIME)) + (lowest >> np.uint64(61))
    return reduced(((ah * hh) << np.uint64(3)) + middle + lowest)  # each under 2**62


def minima(values: np.ndarray, offsets: np.ndarray, pairs: list[tuple[int, int]], slice_size: int = 1 << 14) -> np.ndarray:
    """Least values per set, a slice that stays in cache at a time."""
    out = np.full((len(offsets) - 1, len(pairs)), PRIME, dtype=np.int64)
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[:-1][full]
    h = reduced(values.view(np.uint64))
    for a in range(0, len(h), slice_size):
        part = h[a : a + slice_size]
        i, j = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, a + len(part), side="left")
        cuts, rows = np.maximum(starts[i:j], a) - a, full[i:j]
        for k, (x, y) in enumerate(pairs):
            low = np.minimum.reduceat(reduced(times(x, part) + np.uint64(y)), cuts).view(np.int64)
            out[rows, k] = np.minimum(out[rows, k], low)
    return out


def blake2b(strings: list[str]) -> np.ndarray:
    """64-bit BLAKE2b, little-endian, of each string; a distinct one is hashed once."""
    known = {s: int.from_bytes(hashlib.blake2b(s.encode("utf-8"), digest_size=8).digest(), "little", signed=True) for s in set(strings)}
    return np.fromiter((known[s] for s in strings), np.int64, len(strings))


def hashed(strings: pa.Array) -> np.ndarray:
    """The same of an Arrow array of any length, a slice at a time: memory does not grow with the batch."""
    out = np.empty(len(strings), np.int64)
    for at in range(0, len(strings), AT_ONCE):
        out[at : at + AT_ONCE] = blake2b(strings.slice(at, AT_ONCE).to_pylist())
    return out


def with_signature(units: DataFrame, hashes: str = "hashes", permutations: int = PERMUTATIONS) -> DataFrame:
    """Adds ``signature array<bigint>`` from a column of base hashes (array<bigint>, unsigned bits); drops it.

    A column of strings (shingles) is hashed with BLAKE2b in the same pass.
    """
    text_batches(units.sparkSession)
    strings = "string" in units.schema[hashes].dataType.simpleString()
    pairs = coefficients(permutations)
    rest = [f for f in units.schema.fields if f.name != hashes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(hashes)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            flat = column.flatten()
            base = hashed(flat) if strings else flat.to_numpy(zero_copy_only=False).astype(np.int64)
            table = minima(base, offsets, pairs)
            flat = pa.array(table.reshape(-1))
            ends = pa.array(np.arange(0, table.size + 1, permutations, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.ListArray.from_arrays(ends, flat)], names=[*(f.name for f in rest), "signature"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "signature array<bigint>"])
    return units.mapInArrow(run, schema)


def md5_hashes(shingles: Column) -> Column:
    """60 bits of MD5: native, and the same in other engines."""
    return F.transform(shingles, lambda s: F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint"))


def estimated_jaccard(left: Column, right: Column) -> Column:
    """Share of equal places; 0 for empty or unequally long signatures."""
    same = F.size(F.filter(F.arrays_zip(left.alias("l"), right.alias("r")), lambda z: z["l"] == z["r"]))
    return F.when((F.size(left) == 0) | (F.size(left) != F.size(right)), F.lit(0.0)).otherwise(same / F.greatest(F.size(left), F.lit(1)))


def band_keys(signature: Column, permutations: int, bands: int = BANDS) -> Column:
    """array<struct<band, key>>: the signature cut into equal runs."""
    if permutations % bands:
        raise ValueError(f"{permutations} permutations do not divide into {bands} bands")
    rows = permutations // bands
    return let(
        F.transform(signature, lambda v: v.cast("string")),
        lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.array_join(F.slice(s, i * rows + 1, rows), ",").alias("key"))),
    )
