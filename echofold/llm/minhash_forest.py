"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are folded into the one with the smallest id. Every other document
gets TREES sorted signature orders: a tree's key is its own sequence of hash minima, the first
START of them as one equality key and the following ones as sort keys. The keys of each tree are
sorted over the whole cluster (range partitions, so a crowded region spans as many tasks as it needs),
and neighbours in an order are the documents with the longest common prefix: depth adapts to the
region by itself, deep where many documents share a prefix, START where few do.

Round one takes the nearest neighbour in the first FIRST_TREES orders, checks it on the full shingle sets
and joins the links into components. Round two takes, in every order, up to REACH neighbours on either
side that are still in another component, checks them and joins again: a crowd of near copies, one
component by then, adds no pairs. From the place in a region on that a window does not reach from its start, only the
NEAREST neighbours are taken, as round three has all pairs of such a region: a crowd that is alike but not linked
adds NEAREST pairs a document and order. Round two also names the regions (documents with one first key) that have more
documents than a window reaches or that lie across the border of two tasks. Round three is for those of
them that still hold several components: their documents, but for the pairs within the largest component,
are dealt into cells of two blocks of about BLOCK documents, and each cell finds all links between its
blocks by exact counts of common shingles. So every pair that shares a first key in any tree is linked, in
one component already, or checked. Rounds one and two take a number of candidates linear in the number of
documents; round three grows with the square of the documents of a region that have no link to its largest
component, in numpy and not in rows (a row for each document and cell).

At a similarity of 0.8 a pair shares START minima in a tree with odds 0.41, in none of 24 trees with odds
of 3 in a million. Candidates are checked if LEAST_SKETCH of the 96 minima agree in 4 bits; such a pair
has fewer with odds of 2 in ten million (binomial), so 3.4 in a million are missed in all.

Defined results: a null or blank text has an empty set and is linked with nothing; one word is a set of
one; rows with the same id are one document; a row without id is kept and linked with nothing; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import release, stored, text_batches, width
from .words import WordHasher, chunks, mix, trimmed, utf8

TREES, START, HASHES, REACH, NEAREST = 24, 4, 96, 16, 3
DEEPER, FIRST_TREES, BLOCK = 16, 8, 256
LEAST_SKETCH = 57  # of 96; at a similarity of 0.8, 78 agree on average
SKETCH = [f"s{i}" for i in range(HASHES // 16)]
SIGNED = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, signature binary"
KEYS = "k0 bigint, k1 bigint, k2 bigint, id bigint, part bigint" + "".join(f", {s} bigint" for s in SKETCH)
FOUND = "a bigint, b bigint, k0 bigint, n bigint, low bigint, high bigint"


class Shingler:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, no words none."""

    def __init__(self, size: int):
        self.size = size
        self.words = WordHasher(fold_case=True)
        self.odd = mix(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, off = self.words(raw, at)
        n, size = len(w), self.size
        h = w * self.odd[0]
        for j in range(1, size):
            h[: n - j] += mix(w[j:] * self.odd[j])
        h = mix(h)
        counts = np.diff(off)
        keep = np.arange(n) < np.repeat(off[1:] - size + 1, counts)
        for d in np.flatnonzero((counts > 0) & (counts < size)):  # the whole sequence as one
            a, b = off[d], off[d + 1]
            acc = np.uint64(b - a)
            for x in w[a:b]:
                acc = mix(np.array([acc]) + np.array([x]))[0]
            h[a], keep[a] = acc, True
        h = h[keep]
        per = np.maximum(counts - size + 1, np.minimum(counts, 1))
        off = np.concatenate([[0], np.cumsum(per)])
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            if b - a > 1:
                h[a:b].sort()
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        new[off[:-1][per > 0]] = True
        return h[new], np.concatenate([[0], np.cumsum(new)])[off]


def _minima(values: np.ndarray, off: np.ndarray, seeds: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Rows of hash minima of non-empty sets."""
    out = np.full((len(off) - 1, len(seeds)), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(off))
    starts = off[:-1][full]
    h = (values >> np.uint64(32)).astype(np.uint32)
    step = 1 << 15
    for a in range(0, len(h), step):  # a slice that stays in cache
        b = min(a + step, len(h))
        i, j = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b, side="left")
        cuts = np.maximum(starts[i:j], a) - a
        rows = full[i:j]
        part = h[a:b]
        for k in range(len(seeds)):
            low = np.minimum.reduceat((part ^ seeds[k]) * odd[k], cuts)
            out[rows, k] = np.minimum(out[rows, k], low)
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        r = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
        seeds, odd = (r[:HASHES] >> np.uint64(32)).astype(np.uint32), (r[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for batch in batches:
            for a, b in chunks(batch, "text"):
                part = batch.slice(a, b - a)
                values, off = shingler(*utf8(part.column("text")))
                n = np.diff(off)
                f1, f2 = (np.zeros(len(n), np.uint64) for _ in range(2))
                full = np.flatnonzero(n)
                if len(full):
                    f1[full] = np.add.reduceat(mix(values + np.uint64(77)), off[:-1][full])
                    f2[full] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0xABCDEF)), off[:-1][full])
                rows = _minima(values, off, seeds, odd)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "signature"],
                )

    return run


def _orders() -> tuple[list[list[int]], list[np.ndarray]]:
    """For each tree the hashes of its first key, and DEEPER ones that follow in its order."""
    first = [[t * START + i for i in range(START)] for t in range(TREES)]  # TREES * START = HASHES
    return first, [np.random.default_rng(t).permutation([h for h in range(HASHES) if h not in first[t]])[:DEEPER] for t in range(TREES)]


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, HASHES).astype(np.uint64)


def _packed(sig: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    k = np.zeros(len(sig), dtype=np.uint64)
    for j in places:
        k = (k << np.uint64(bits)) | (sig[:, j] & np.uint64((1 << bits) - 1))
    return k


def _first_keys(sig: np.ndarray, trees: int = TREES) -> list[np.ndarray]:
    out = []
    for t, places in enumerate(_orders()[0][:trees]):
        k0 = np.full(len(sig), t + 1, dtype=np.uint64)
        for j in places:
            k0 = mix(k0 + sig[:, j])
        out.append(k0)
    return out


def _sketch(sig: np.ndarray) -> list[np.ndarray]:
    """4 bits of all minima."""
    return [_packed(sig, np.arange(i, i + 16), 4) for i in range(0, HASHES, 16)]


def _tree_keys(trees: int):
    """One row for each tree: its first key, two keys of the following minima (8 bits of each), the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deeper = _orders()[1][:trees]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch)
            keys = [_first_keys(sig, trees), *([_packed(sig, d[i : i + 8], 8) for d in deeper] for i in (0, 8))]
            arrays = [np.concatenate(k).view(np.int64) for k in keys]
            arrays += [np.tile(batch.column(c).to_numpy(), trees) for c in ("id", "part")]
            arrays += [np.tile(x.view(np.int64), trees) for x in _sketch(sig)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k0", "k1", "k2", "id", "part", *SKETCH])

    return run


def _region_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first key of each tree."""
    for batch in batches:
        if batch.num_rows:
            k0 = np.concatenate(_first_keys(_signatures(batch))).view(np.int64)
            tree = np.repeat(np.arange(TREES, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(np.tile(batch.column("id").to_numpy(), TREES)), pa.array(tree)], names=["k0", "id", "tree"])


def _agreement(x: np.ndarray) -> np.ndarray:
    """How many of the 16 fields of an xor are zero."""
    x = x | (x >> np.uint64(2))
    x = x | (x >> np.uint64(1))
    return 16 - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int16)


class _Regions:
    """Runs of one first key in a task's rows: those longer than a window, and the first and last one."""

    def __init__(self, reach: int):
        self.reach, self.open, self.first = reach, None, True

    def _ended(self, runs: list[np.ndarray], last: bool) -> list[np.ndarray]:
        keep = runs[1] > self.reach + 1
        if len(keep):
            keep[0] |= self.first
            keep[-1] |= last
            self.first = False
        return [x[keep] for x in runs]

    def add(self, k0: np.ndarray, parts: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(np.concatenate([[True], k0[1:] != k0[:-1]]))
        runs = [k0[at], np.diff(np.append(at, len(k0))), np.minimum.reduceat(parts, at), np.maximum.reduceat(parts, at)]
        if self.open is not None:
            if self.open[0][0] == runs[0][0]:
                for x, y, join in zip(runs[1:], self.open[1:], (np.add, np.minimum, np.maximum)):
                    x[0] = join(x[0], y[0])
            else:
                runs = [np.concatenate(x) for x in zip(self.open, runs)]
        self.open = [x[-1:] for x in runs]
        return self._ended([x[:-1] for x in runs], False)

    def end(self) -> list[np.ndarray]:
        return self._ended(self.open, True) if self.open is not None else [np.zeros(0, np.int64)] * 4


def _neighbours(reach: int, regions: bool):
    """Pairs of ids within ``reach`` places in a tree's order that share its first key and are alike, and
    the pieces of regions that a window does not cover. Behind the first ``reach`` + 1 rows of a piece, which is one
    of those then, pairs are within NEAREST places."""
    names = ["k0", "id", "part", *SKETCH]

    def rows(found: list, pieces: list[np.ndarray]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        none = [pa.nulls(n, pa.int64()) for n in (len(pieces[0]), len(a))]
        pairs = [pa.concat_arrays([pa.array(x, pa.int64()), none[0]]) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*pairs, *(pa.concat_arrays([none[1], pa.array(x, pa.int64())]) for x in pieces)], names=["a", "b", "k0", "n", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, pieces, start = None, _Regions(reach), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in names]
            fresh = 0 if kept is None else len(kept[0])
            k0, ids, parts, *sketch = new if kept is None else [np.concatenate(x) for x in zip(kept, new)]
            row = np.arange(len(k0))
            new_run = np.concatenate([[False], k0[1:] != k0[:-1]])
            place = row - np.maximum.accumulate(np.where(new_run, row, -start))  # in its run; start: that of the first row
            found = []
            for d in range(1, reach + 1):
                if len(k0) <= d:
                    break
                hit = (k0[d:] == k0[:-d]) & (ids[d:] != ids[:-d]) & (parts[d:] != parts[:-d])
                if d > NEAREST:
                    hit &= place[d:] <= reach
                hit[: max(0, fresh - d)] = False
                at = np.flatnonzero(hit)
                agree = sum(_agreement((x[at] ^ x[at + d]).view(np.uint64)) for x in sketch)
                at = at[agree >= LEAST_SKETCH]
                found.append((np.minimum(ids[at], ids[at + d]), np.maximum(ids[at], ids[at + d])))
            kept, start = [x[-reach:] for x in (k0, ids, parts, *sketch)], int(place[-reach:][0])
            yield rows(found, pieces.add(*new[:3:2]) if regions else [np.zeros(0, np.int64)] * 4)
        if regions:
            yield rows([], pieces.end())

    return run


def _candidates(signed: DataFrame, reach: int, trees: int, regions: bool) -> DataFrame:
    keys = signed.mapInArrow(trimmed(_tree_keys(trees)), KEYS)
    order = ["k0", "k1", "k2", "id"]
    ordered = keys.repartitionByRange(width(signed.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(trimmed(_neighbours(reach, regions)), FOUND), "found")


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("a is not null").select("a", "b").distinct()


def _check(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for i, j in chunks(batch, "text_a", 2 << 20):
                part = batch.slice(i, j - i)
                (va, oa), (vb, ob) = (shingler(*utf8(part.column(c))) for c in ("text_a", "text_b"))
                linked = np.zeros(j - i, dtype=bool)
                for r in range(j - i):
                    x, y = va[oa[r] : oa[r + 1]], vb[ob[r] : ob[r + 1]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
                        continue
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    linked[r] = 100 * common >= percent * (len(both) - common)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(linked)), part.column("b").filter(pa.array(linked))], names=["a", "b"])

    return run


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = stored(docs.join(ends.hint("merge"), "doc_id", "left_semi"), "texts")
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    rows = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    out = stored(rows.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_check(size, percent)), "a bigint, b bigint"), "links")
    release(texts)
    return out


def _alike(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left and the right block of a cell, and which pairs of them are to be checked: of two
    components, alike in the sketch, in no region of an earlier tree together (they are checked there)."""
    side = rows.column("side").to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: both
    sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, HASHES).astype(np.uint64)
    part = rows.column("part").to_numpy()
    pair = part[left][:, None] != part[right]
    for k0 in _first_keys(sig, rows.column("tree")[0].as_py()):
        pair &= k0[left][:, None] != k0[right]
    agree = sum(_agreement(x[left][:, None] ^ x[right]) for x in _sketch(sig))
    return left, right, pair & (agree >= LEAST_SKETCH)


def _cell_members(rows: pa.Table) -> pa.Table:
    """The rows of a cell that are in a pair to be checked."""
    left, right, pair = _alike(rows)
    used = np.unique(np.concatenate([left[pair.any(axis=1)], right[pair.any(axis=0)]]))
    return rows.take(pa.array(used, pa.int64()))


def _common(values: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets of rows ``left`` with those of ``right``."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    _, column, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n[column] > 1)
    order = shared[np.argsort(column[shared], kind="stable")]
    row, column = row[order], np.cumsum(np.concatenate([[0], np.diff(column[order]) > 0])) if len(order) else order
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [a, a + step])
        m = np.zeros((len(off) - 1, step), dtype=np.float32)
        m[row[i:j], column[i:j] - a] = 1
        out += m[left] @ m[right].T
    return out


def _cell_links(size: int, percent: int):
    """Links of a cell; of several that join the same components, one."""

    def run(rows: pa.Table) -> pa.Table:
        left, right, pair = _alike(rows)
        values, off = Shingler(size)(*utf8(rows.column("text").combine_chunks()))
        n, common = np.diff(off), _common(values, off, left, right).astype(np.int64)
        i, j = np.nonzero(pair & (100 * common >= percent * (n[left][:, None] + n[right] - common)))
        ids, part, root, out = rows.column("id").to_pylist(), rows.column("part").to_pylist(), {}, []

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for x, y in zip(left[i].tolist(), right[j].tolist()):
            p, q = find(part[x]), find(part[y])
            if p != q:
                root[p] = q
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _region_links(regions: DataFrame, reps: DataFrame, parts: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """All links between components in ``regions`` (k0); None where no region has two."""
    keys = reps.select("id", "signature").mapInArrow(trimmed(_region_keys), "k0 bigint, id bigint, tree int")
    of = parts.select(F.col("node").alias("id"), "component")
    members = keys.join(regions.hint("merge"), "k0", "left_semi").distinct().join(of.hint("merge"), "id", "left")
    members = stored(members.select("k0", "tree", "id", F.coalesce("component", "id").alias("part")), "members")
    sizes = members.groupBy("k0", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("k0").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK))
    sizes = sizes.where("n > most.n").select("k0", F.col("most.part").alias("most"), blocks(F.col("n") - F.col("most.n")).alias("others"), blocks(F.col("most.n")).alias("large"))
    # The blocks of the largest component come after the others'; a cell is (x, y), x one of the others', x <= y.
    rows = members.join(sizes.hint("merge"), "k0")
    large = F.col("part") == F.col("most")
    own = F.when(large, F.col("others") + F.pmod(F.xxhash64("id", "k0"), "large")).otherwise(F.pmod(F.xxhash64("id", "k0"), "others"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(large, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("large") - 1))))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("k0", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "tree", "id", "part", side.alias("side"))
    kinds, cell = "k0 bigint, x bigint, y bigint, tree int, id bigint, part bigint, side int, signature binary", ["k0", "x", "y"]
    signed = reps.select("id", "signature").hint("merge")
    near = stored(rows.join(signed, "id").select("k0", "x", "y", "tree", "id", "part", "side", "signature").groupBy(*cell).applyInArrow(_cell_members, kinds), "near")
    release(members)
    if near.isEmpty():
        release(near)
        return None
    ends = near.select(F.col("id").alias("doc_id")).distinct()
    texts = stored(docs.join(ends.hint("merge"), "doc_id", "left_semi").withColumnRenamed("doc_id", "id"), "texts")
    out = stored(near.join(texts.hint("merge"), "id").groupBy(*cell).applyInArrow(_cell_links(size, percent), "a bigint, b bigint"), "links")
    release(near, texts)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links are |A and B| * 100 >= percent * |A or B|."""
    return _classes(docs, size, percent)[0]


def _joined(links: DataFrame, parts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and their components in place of ``parts``."""
    both = stored(links.unionByName(new), "links")
    release(links, parts, new)
    return both, connected_components(both)


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result, and the stored tables that it reads."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(trimmed(_sign(size)), SIGNED), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    sets = stored(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")
    firsts = sets.select(F.col("rep").alias("doc_id")).distinct()
    reps = stored(named.join(firsts.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "signature"), "reps")

    # Round one: the nearest neighbours in the first few trees.
    found = _candidates(reps.withColumn("part", F.col("id")), 1, FIRST_TREES, False)
    links = _links(_pairs(found), docs, size, percent)
    parts = connected_components(links)

    # Round two: all trees, wider, between components.
    crowd = reps.join(parts.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    wider = _candidates(crowd.select("id", "signature", "part"), REACH, TREES, True)
    more = stored(_pairs(wider).join(_pairs(found).hint("merge"), ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links, parts = _joined(links, parts, _links(more, docs, size, percent))

    # Round three: all pairs between components where a window does not reach.
    regions = wider.where("k0 is not null").groupBy("k0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.min("low").alias("low"), F.max("high").alias("high"))
    regions = stored(regions.where(f"(n > {REACH + 1} or pieces > 1) and low < high").select("k0"), "regions")
    if not regions.isEmpty():
        rest = _region_links(regions, reps, parts, docs, size, percent)
        if rest is not None:
            links, parts = _joined(links, parts, rest)
    release(reps, found, wider, more, regions, links)

    same = ["f1", "f2", "n_shingles"]
    rows = signed.select("doc_id", *same).join(sets.hint("merge"), same, "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    rows = rows.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    rows = rows.join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    out = rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out, [signed, sets, parts]


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that are the first of their component (rows without id all stay)."""
    classes, tables = _classes(docs, size, percent)
    gone = stored(classes.where("not kept").select(F.col("doc_id").alias("_echofold_gone")).distinct(), "gone")
    release(*tables)
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("bigint") == F.col("_echofold_gone"), "left_anti")
