"""Benchmark decontamination: documents that hold an item up to a share of word edits.

Windows. A document window within ``e`` edits of an item of n words shares at least
n + 1 - q * (e + 1) of the item's q-word runs with it, on diagonals no further than e apart (q is chosen
so that this is at least one). Windows as long as the item are placed on every diagonal of a document
that has such a run and reaches that count within its band; this loses no window within ``e`` edits.

Candidates. Each window, and each item, is embedded by CGK random walks (Chakraborty, Goldenberg and
Koucky, 2016): the walk copies the current word and moves on by a random bit that depends on the place
and the word, so that few edits become a small Hamming distance. Bit-sampling keys of a few places of
the embedding, repeated with fresh walks and samples, are looked up among the items' keys. The number of
repeats is the one that reaches the target recall, at the largest distance allowed, on simulated walks.

Verification. Candidates are checked by exact edit distance (the item against the best stretch around
the window).

Words are runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased. The items are a bounded
side: blocks of at most ``ITEM_WORDS`` words are shipped with the code, further items in further passes,
whose hits alone are written and joined. A text with more than ``HITS`` shared runs at a time (frequent
words, long texts) is read in stretches that overlap by more than the longest item.

Defined results: null and empty texts are clean; items without id or words match nothing; an item of fewer
than five words allows no edit, and one of a single word marks every text with that word; items given twice count once; repeated rows give repeated rows; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored, text_batches
from .toxicity import word_breaks
from .words import WordHasher, chunks, gram_hashes, mix, trimmed, utf8

ITEM_WORDS = 400_000
HITS, LEAST_STRETCH = 4_000_000, 256
SAMPLED, RECALL = 2, 0.999
TRIALS, LONGEST = 8000, 200
FILTER_BITS = 22
OUT = "doc_id bigint, n_items bigint, best_item bigint, best_distance bigint"


def allowed(n: int, share: float) -> int:
    return int(share * n + 1e-9)


def run_length(n: int, e: int) -> int:
    """Words of the longest run that an item of n words must keep after e edits."""
    return max(1, min(4, -(-(n - e) // (e + 1))))


def walks(words: np.ndarray, seed: int, places: int | None = None) -> np.ndarray:
    """CGK embedding of rows of equal length n into 3n places, or the first few of them.

    Past its end a row is padded with zeros. Words are mixed hashes, so the random bit is the top one of their
    product with a random odd number of the place and the seed (added bitwise first: padding moves on too).
    """
    rows, n = words.shape
    places = places or 3 * n
    odd = mix(np.arange(places, dtype=np.uint64) * np.uint64(7919) + np.uint64(seed * 1_000_003 + 1)) | np.uint64(1)
    padded = np.concatenate([words, np.zeros((rows, 1), np.uint64)], axis=1)
    at, out, every = np.zeros(rows, dtype=np.int64), np.empty((rows, places), np.uint64), np.arange(rows)
    for j in range(places):
        w = out[:, j] = padded[every, at]
        at = np.minimum(at + (((w ^ odd[j]) * odd[j]) >> np.uint64(63)).view(np.int64), n)
    return out


def edit_distance(items: np.ndarray, stretches: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least edits between each row of items and any part of the row of stretches (given lengths)."""
    rows, n = items.shape
    m = stretches.shape[1]
    place = np.arange(m + 1)
    d = np.zeros((rows, m + 1), dtype=np.int32)
    for i in range(n):
        diff = (stretches != items[:, i, None]).astype(np.int32)
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + diff, d[:, 1:] + 1)
        d = place + np.minimum.accumulate(new - place, axis=1)
    d[place[None, :] > lengths[:, None]] = 1 << 20
    return d.min(axis=1)


def sampled(n: int, r: int) -> np.ndarray:
    """The places of repeat r for items of n words."""
    return np.random.default_rng(n * 1009 + r).choice(2 * n, SAMPLED, replace=False) if n > 1 else np.array([0, 0])


@lru_cache(maxsize=4096)
def _simulated(n: int, e: int, recall: float) -> int:
    rng, needed = np.random.default_rng([n, e]), 1
    for evenly in (True, False):
        words = mix(rng.integers(1, 1 << 62, (TRIALS, n), dtype=np.uint64))
        at = np.tile(np.linspace(0, n - 1, e).astype(np.int64), (TRIALS, 1)) if evenly else rng.random((TRIALS, n)).argsort(axis=1)[:, :e]
        edited = words.copy()
        np.put_along_axis(edited, at, mix(rng.integers(1, 1 << 62, (TRIALS, e), dtype=np.uint64)), axis=1)
        r = 0
        while len(words) > TRIALS * (1 - recall) / 2:
            places = sampled(n, r)
            x, y = (walks(w, r, int(places.max()) + 1)[:, places] for w in (words, edited))
            missed = (x != y).any(axis=1)
            words, edited, r = words[missed], edited[missed], r + 1
        needed = max(needed, r)
    return needed


def repeats(e: int, n: int, recall: float) -> int:
    """Walks needed for the target recall of an item of n words at exactly e edits: as many as leave half
    of the allowed misses among simulated items with e words replaced, at even distances and at random
    (in a block fewer are needed). Lengths are rounded up to steps of a quarter, and long items, which
    would take long to simulate, grow in proportion from LONGEST."""
    if e == 0:
        return 1
    step = 4
    while step < min(n, LONGEST):
        step = max(step + 1, step * 5 // 4)
    return math.ceil(_simulated(step, max(1, math.ceil(e / n * step - 1e-9)), recall) * max(1.0, n / step))


class Items:
    """The benchmark, in groups of equal length, with run index and walk keys."""

    def __init__(self, rows: list[tuple[int, str]], share: float, recall: float = RECALL):
        raw, at = utf8(pa.array([t for _, t in rows], pa.large_string()))
        words, off = WordHasher(fold_case=True, space=word_breaks())(raw, at)
        self.ids, self.words = [], []
        for (i, _), a, b in zip(rows, off[:-1], off[1:]):
            if b > a:
                self.ids.append(i)
                self.words.append(words[a:b])
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.e = np.array([allowed(n, share) for n in self.n], dtype=np.int64)
        self.q = np.array([run_length(n, e) for n, e in zip(self.n, self.e)], dtype=np.int64)
        self.recall = recall
        self.index = {}
        for q in sorted(set(self.q.tolist())):
            runs, item, place = [], [], []
            for k in np.flatnonzero(self.q == q):
                g = gram_hashes(self.words[k], q)
                runs.append(g)
                item.append(np.full(len(g), k))
                place.append(np.arange(len(g)))
            runs, item, place = (np.concatenate(x) for x in (runs, item, place))
            order = np.argsort(runs, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[runs & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.index[q] = (runs[order], item[order], place[order], bits)
        self.repeats = {n: repeats(e, n, recall) for n, e in sorted(set(zip(self.n.tolist(), self.e.tolist())))}
        self.tables = {}

    def shared(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each run length: places in words with a shared run, where the index has it first, how often; the length."""
        out = []
        for q, (runs, _, _, bits) in self.index.items():
            g = gram_hashes(words, q)
            at = np.flatnonzero(bits[g & np.uint64((1 << FILTER_BITS) - 1)])
            low, high = (np.searchsorted(runs, g[at], side=s) for s in ("left", "right"))
            some = high > low
            out.append((at[some], low[some], (high - low)[some], q))
        return out

    def seeds(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in words, item, place in item) of all shared runs."""
        out = []
        for at, low, n, q in found:
            _, item, place, _ = self.index[q]
            hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(at, n), item[hit], place[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def windows(self, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word) of the windows to be embedded, from a bounded number of runs at a time."""
        if not len(self.n) or not len(words):
            return (np.zeros(0, np.int64),) * 3
        n_texts, parts = len(off) - 1, []
        found = self.shared(words)
        if sum(int(n.sum()) for _, _, n, _ in found) <= HITS or n_texts == 1 and len(words) <= LEAST_STRETCH:
            return self._windows(words, off, found)
        if n_texts > 1:
            for a, b in ((0, n_texts // 2), (n_texts // 2, n_texts)):
                text, item, first = self.windows(words[off[a] : off[b]], off[a : b + 1] - off[a])
                parts.append((text + a, item, first + off[a]))
        else:  # what starts in a half, with the words around it that its items can reach
            around = int((self.n + 2 * self.e).max()) + 8
            half, n = len(words) // 2, len(words)
            for a, b in ((0, half), (half, n)):
                low, high = max(0, a - around), min(n, b + around)
                if high - low >= n:
                    return self._windows(words, off, found)
                text, item, first = self.windows(words[low:high], np.array([0, high - low]))
                first = first + low
                mine = (first >= a if a else first < half) & (first < b if b < n else first >= half)
                parts.append((text[mine], item[mine], first[mine]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _windows(self, words: np.ndarray, off: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, item, place = self.seeds(found)
        if not len(at):
            return at, item, place
        text = np.searchsorted(off, at, side="right") - 1
        inside = at + self.q[item] <= off[text + 1]
        at, item, place, text = at[inside], item[inside], place[inside], text[inside]
        diagonal = at - place
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        # Shared runs within the band of e diagonals on either side of each.
        span = np.int64(len(words) + 4 * int(self.n.max()) + 8)
        key = (text * len(self.n) + item) * span + diagonal + 2 * int(self.n.max())
        near = np.searchsorted(key, key + self.e[item], side="right") - np.searchsorted(key, key - self.e[item], side="left")
        need = np.maximum(1, self.n[item] + 1 - self.q[item] * (self.e[item] + 1))
        keep = near >= need
        keep[1:] &= key[1:] != key[:-1]
        return text[keep], item[keep], diagonal[keep]

    def table(self, n: int):
        """Walk keys of the items of n words, for each repeat: sorted keys, items, sampled places."""
        if n not in self.tables:
            mine = np.flatnonzero(self.n == n)
            rows = np.stack([self.words[k] for k in mine])
            out = []
            for r in range(self.repeats[n]):
                places = sampled(n, r)
                keys = self._keys(rows, r, places)
                order = np.argsort(keys, kind="stable")
                out.append((keys[order], mine[order], places))
            self.tables[n] = out
        return self.tables[n]

    def _keys(self, rows: np.ndarray, r: int, places: np.ndarray) -> np.ndarray:
        embedded = walks(rows, r, int(places.max()) + 1)
        key = np.full(len(rows), r, dtype=np.uint64)
        for p in places:
            key = mix(key + embedded[:, p])
        return key

    def found(self, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, distance) of verified matches, each pair once."""
        text, item, start = self.windows(words, off)
        texts, items, distances = [], [], []
        for n in np.unique(self.n[item]):
            mine = self.n[item] == n
            t, s = text[mine], start[mine]
            rows = self._stretch(words, off, t, s, int(n))[0]
            pairs = []
            for r, (keys, who, places) in enumerate(self.table(int(n))):
                k = self._keys(rows, r, places)
                low, high = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
                c = high - low
                w = np.repeat(np.arange(len(k)), c)
                hit = np.repeat(low, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                pairs.append(w * len(self.n) + who[hit])
            pair = np.unique(np.concatenate(pairs))
            w, k = pair // len(self.n), pair % len(self.n)
            e = int(self.e[np.flatnonzero(self.n == n)[0]])
            for a in range(0, len(w), 2048):
                ws, ks = w[a : a + 2048], k[a : a + 2048]
                around, lengths = self._stretch(words, off, t[ws], s[ws] - e, int(n) + 2 * e)
                d = edit_distance(np.stack([self.words[x] for x in ks]), around, lengths)
                good = d <= e
                texts.append(t[ws][good])
                items.append(ks[good])
                distances.append(d[good])
        if not texts:
            return (np.zeros(0, np.int64),) * 3
        t, k, d = (np.concatenate(x) for x in (texts, items, distances))
        order = np.lexsort((d, k, t))
        t, k, d = t[order], k[order], d[order]
        first = np.ones(len(t), dtype=bool)
        first[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        return t[first], k[first], d[first]

    @staticmethod
    def _stretch(words: np.ndarray, off: np.ndarray, text: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n words from each start, zeros before and beyond the text. Rows, and how far the text reaches in them."""
        at = start[:, None] + np.arange(n)
        ok = (at >= off[text][:, None]) & (at < off[text + 1][:, None])
        return np.where(ok, words[np.clip(at, 0, max(0, len(words) - 1))], np.uint64(0)), np.clip(off[text + 1] - start, 0, n)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded number of words, streamed to the driver."""
    rows = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id"), "text").agg(F.count(F.lit(1)).alias("n")).select("item_id", "text").orderBy("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r[1]) // 2 + 1
        if block and size + n > ITEM_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _scan(items: Items, mark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(fold_case=True, space=word_breaks())
        for batch in batches:
            for i, j in chunks(batch, "text"):
                part = batch.slice(i, j - i)
                yield mark(part, items, *items.found(*hasher(*utf8(part.column("text")))))

    return run


def _report(part: pa.RecordBatch, items: Items, text: np.ndarray, item: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    n = np.bincount(text, minlength=part.num_rows)
    ids = np.array(items.ids, dtype=np.int64)[item] if len(item) else np.zeros(0, np.int64)
    order = np.lexsort((ids, distance, text))
    first = order[np.searchsorted(text[order], np.flatnonzero(n))]
    best, least = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
    best[n > 0], least[n > 0] = ids[first], distance[first]
    none = n == 0
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(best, pa.int64(), mask=none), pa.array(least, pa.int64(), mask=none)], names=["doc_id", "n_items", "best_item", "best_distance"])


def _keyed_hits(part: pa.RecordBatch, *found) -> pa.RecordBatch:
    """The report of rows that hold an item, with their key."""
    rows = _report(part, *found)
    return rows.append_column("k", part.column("k")).filter(pa.array(rows.column("n_items").to_numpy() > 0))


def _clean(part: pa.RecordBatch, items: Items, text: np.ndarray, item: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return part.filter(pa.array(np.bincount(text, minlength=part.num_rows) == 0))


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, contaminated, n_items, best_item, best_distance for every row.

    With a benchmark of one block (the usual case) the documents are passed once, without a shuffle; with
    more, the hits of each block are written and joined, on the id and a hash of the text.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = _blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        out = texts.selectExpr("doc_id", "0L n_items", "cast(null as bigint) best_item", "cast(null as bigint) best_distance")
    elif second is None:
        out = texts.mapInArrow(trimmed(_scan(Items(first, share), _report)), OUT)
    else:
        keyed, hits = texts.withColumn("k", F.xxhash64("text")), []
        for block in chain([first, second], blocks):
            found = keyed.mapInArrow(trimmed(_scan(Items(block, share), _keyed_hits)), OUT + ", k bigint")
            hits.append(stored(found.groupBy("doc_id", "k").agg(F.max("n_items").alias("n_items"), F.min(F.struct("best_distance", "best_item")).alias("best")), "hits"))
        found = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "k").agg(F.sum("n_items").alias("n_items"), F.min("best").alias("best"))
        joined = keyed.select("doc_id", "k").alias("l").join(found.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.k = r.k"), "left")
        out = joined.select("l.doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.best_item").alias("best_item"), F.col("best.best_distance").alias("best_distance"))
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """The documents, all columns, that hold no item."""
    text_batches(docs.sparkSession)
    for b in _blocks(benchmark):
        docs = docs.mapInArrow(trimmed(_scan(Items(b, share), _clean)), docs.schema)
    return docs
