"""Exact top-k inner-product search with KD-trees per shard.

Every shard of the vectors builds a KD-tree by median splits of the widest dimension, each node with
a tight bounding box. The inner product of a query with anything in a box is at most
``max(q, 0) . high + min(q, 0) . low``; a query visits boxes best first, bounds the two halves of a box
when it opens it, and stops when the best remaining bound is below its k-th score (a box that only ties
may still hold a smaller id). The k-th score found in a query's home shard goes with it to the other shards.

Shards and blocks of queries meet in tasks of bounded size: a shard holds at most about ``SHARD_ROWS``
vectors and ``SHARD_BYTES`` of them, a block about ``BLOCK_QUERIES`` queries and as many bytes, both dealt
by a hash of the id.

Components are floor(256 * x), whole numbers of any size. A score beyond 64 bits is given, and ranked, as the largest or
smallest long. Vectors that are null or hold null or non-finite components take no
part, nor do rows without vec_id; only vectors of equal length are scored with each other. Repeated
rows of a candidate are rows of their own; a query given twice is answered once if it is the same
vector, else for the vector that sorts first. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

SHARD_ROWS, BLOCK_QUERIES, LEAF = 131_072, 65_536, 256
SHARD_BYTES = 64 << 20
EXACT = 1 << 53  # sums of products up to here are exact in float64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
OUT = "query_id bigint, vec_id bigint, score bigint"


class KDTree:
    """Median splits of the widest dimension, leaves of at most LEAF rows, tight boxes."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.low, self.high, self.kids, self.span = [], [], [], []
        work = [(0, len(rows), -1, 0)]
        while work:
            a, b, parent, side = work.pop()
            mine = rows[self.order[a:b]]
            low, high = mine.min(axis=0), mine.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.kids.append([-1, -1])
            self.span.append((a, b))
            if parent >= 0:
                self.kids[parent][side] = node
            if b - a > LEAF and (high > low).any():
                d = int(np.argmax(high - low))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(mine[:, d], mid, kind="introselect")]
                work += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.rows = rows[self.order]

    def bounds(self, above: np.ndarray, below: np.ndarray, nodes) -> np.ndarray:
        """Upper bounds of the inner products of a query (its positive and negative parts) with boxes."""
        return self.high[nodes] @ above + self.low[nodes] @ below


def search(tree: KDTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each query its best (score, -id) of this shard, none below its floor."""
    out = []
    ids = ids[tree.order]
    for i, (q, mine, floor) in enumerate(zip(queries, own, floors)):
        above, below = np.maximum(q, 0), np.minimum(q, 0)
        best: list[tuple[int, int]] = []
        heap = [(-tree.bounds(above, below, 0), 0)]
        while heap:
            top, node = heapq.heappop(heap)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if max(-top, LEAST) < least:
                break
            kids = tree.kids[node]
            if kids[0] >= 0:
                for bound, kid in zip(tree.bounds(above, below, kids), kids):
                    if max(bound, LEAST) >= least:
                        heapq.heappush(heap, (-bound, kid))
                continue
            a, b = tree.span[node]
            scores = tree.rows[a:b] @ q
            if scores.dtype == object:
                scores = np.array([min(max(s, LEAST), MOST) for s in scores], dtype=object)
            for j in np.flatnonzero(scores >= least):
                entry = (int(scores[j]), -int(ids[a + j]))
                if -entry[1] == mine:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        out.append((i, best))
    return out


def matrix(values: pd.Series) -> np.ndarray:
    """Quantised vectors; float64 where products are exact, else Python integers."""
    x = np.stack(values.to_list()).astype(np.float64)
    most = np.abs(x).max() * 256.0 + 1 if x.size and np.abs(x).max() < EXACT else 0.0 if not x.size else math.inf
    if most * most * x.shape[1] < EXACT:
        return np.floor(x * 256.0)
    # Doubles from 2**53 on are whole numbers; 256 times the largest ones is no double any more.
    return np.array([[int(v) * 256 if abs(v) >= EXACT else math.floor(v * 256.0) for v in row] for row in x.tolist()], dtype=object)


def _answer(k: int):
    def answer(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(vectors):
            v, q = matrix(vectors["embedding"]), matrix(queries["q_embedding"])
            if v.dtype != q.dtype or v.dtype != object and v.size and np.abs(v).max() * np.abs(q).max() * v.shape[1] >= EXACT:
                v, q = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (v, q))
            own = queries["query_id"].to_numpy()
            floor = queries["floor"].to_list()
            for i, best in search(KDTree(v), vectors["vec_id"].to_numpy(), q, own, floor, k):
                rows += [(int(own[i]), -m, s) for s, m in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return answer


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for rows with vec_id % every = 0."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding").cast("bigint") * 8), F.lit(0))).first()
    shards = max(math.ceil(n / SHARD_ROWS), math.ceil(size / SHARD_BYTES), min(32, math.ceil(n / 1024)), 1)
    blocks = max(1, math.ceil(n / every / BLOCK_QUERIES), math.ceil(size / every / SHARD_BYTES))
    part = [F.size("embedding").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")]
    rows = rows.select("*", *part)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "d", "shard").agg(F.min("embedding").alias("embedding")).withColumnRenamed("vec_id", "query_id")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))

    names = {"d": "q_d", "shard": "q_shard", "embedding": "q_embedding", "block": "q_block"}  # apart from the vectors' own
    queries = queries.select(*[F.col(c).alias(names.get(c, c)) for c in queries.columns])
    home = queries.withColumn("floor", F.lit(LEAST).cast("bigint")).groupBy("q_d", "q_shard").cogroup(rows.groupBy("d", "shard")).applyInPandas(_answer(k), OUT)
    home = stored(home, "home")
    kth = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    bound = queries.join(kth.select("query_id", "floor"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST).cast("bigint")))
    away = bound.withColumn("q_shard", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array("q_shard"))))
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    far = away.groupBy("q_d", "q_shard", "q_block").cogroup(spread.groupBy("d", "shard", "block")).applyInPandas(_answer(k), OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.unionByName(far).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
