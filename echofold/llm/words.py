"""Vectorised words and word hashes of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. The hash of a word is a
polynomial over a random byte table modulo 2**64, read off two prefix sums and then mixed,
so a whole block of texts is hashed without a Python step per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
CHUNK_BYTES = 4 << 20
ODD = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 with good avalanche (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.full(n, b, dtype=np.uint64)
        if n:
            a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def spaces() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def byte_table(fold_case: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD)) | np.uint64(1)
    if fold_case:
        t[65:91] = t[97:123]
    return t


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``size`` bytes of text, one row at least."""
    n = batch.num_rows
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, min(stop, n)
        start = min(stop, n)


def trimmed(run):
    """``run`` over batches, and the memory that it freed given back to the system when it ends: Python
    workers live on between tasks, and what one operator's arrays took would stay with them."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


class WordHasher:
    """Word hashes of texts; ``fold_case`` lower-cases A-Z first, ``space`` says which bytes part words."""

    def __init__(self, fold_case: bool = False, space: np.ndarray | None = None):
        self.table = byte_table(fold_case)
        self.space = spaces() if space is None else space
        self.up, self.down = powers(0xC2B2AE3D27D4EB4F, BLOCK + 1)

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the offsets (n + 1) of each text's words."""
        return self.located(raw, at)[:2]

    def located(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and where each word starts.

        Work goes block by block, cut at spaces and text ends, so one very long text needs no more
        scratch memory than many short ones.
        """
        hashes, starts = [], []
        cut, n = 0, len(raw)
        while cut < n:
            stop = min(cut + BLOCK, n)
            if stop < n:
                stop = self._cut(raw, at, cut, stop)
            h, s = self._block(raw, at, cut, stop)
            hashes.append(h)
            starts.append(s + cut)
            cut = stop
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
        starts = np.concatenate(starts)
        return np.concatenate(hashes), np.searchsorted(starts, at), starts

    def _cut(self, raw: np.ndarray, at: np.ndarray, low: int, high: int) -> int:
        """The last position in (low, high] where no word is split; past high for an endless word."""
        tail = self.space[raw[low:high]]
        inner = at[np.searchsorted(at, high, side="right") - 1]
        last = low + len(tail) - int(np.argmax(tail[::-1])) if tail.any() else low
        best = max(last, int(inner))
        if best > low:
            return best
        step = high
        while step < len(raw):
            part = self.space[raw[step : step + BLOCK]]
            bound = at[np.searchsorted(at, step, side="left")]
            hit = step + int(np.argmax(part)) if part.any() else step + len(part)
            if bound <= hit:
                return int(bound)
            if part.any():
                return hit
            step += len(part)
        return len(raw)

    def _block(self, raw: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        seg = raw[low:high]
        solid = ~self.space[seg]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = at[np.searchsorted(at, low, side="left") : np.searchsorted(at, high, side="left")] - low
        first[inner] = solid[inner]
        starts = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        before = inner[inner > 0] - 1
        last[before] = solid[before]
        ends = np.flatnonzero(last) + 1
        up, down = (self.up, self.down) if len(seg) <= BLOCK else powers(0xC2B2AE3D27D4EB4F, len(seg))
        sums = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(self.table[seg] * up[: len(seg)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64)), starts


def gram_hashes(words: np.ndarray, k: int, base: int = 0x8CB92BA72F3D8DD7) -> np.ndarray:
    """Hashes of all runs of k words; entry i covers words i .. i + k - 1 (texts' ends are not heeded)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
