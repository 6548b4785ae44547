import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from echofold.operators import intervals, rerank


def test_interval_equals_a_plain_bootstrap(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 0, 3, 9, None]), r.randrange(10, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, part bigint, whole bigint").repartition(5)
    got = intervals.share_interval(df, "id", "part", "whole", 60).first()
    shares = []
    for b in range(1, 61):
        w = [sum(s <= int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) for s in intervals.STEPS) for i, _, _ in rows]
        shares.append(100 * sum(x * (p or 0) for x, (_, p, _) in zip(w, rows)) / sum(x * n for x, (_, _, n) in zip(w, rows)))
    point = 100 * sum(p or 0 for _, p, _ in rows) / sum(n for _, _, n in rows)
    assert np.allclose([got["point"], got["low"], got["high"]], [point, *np.quantile(shares, [0.025, 0.975])])
    assert got["low"] < got["point"] < got["high"]
    assert tuple(intervals.share_interval(df.limit(0), "id", "part", "whole", 5).first()) == (0.0, 0.0, 0.0)


def test_weights_are_poisson(spark):
    n = 40_000
    w = spark.range(n).select(intervals.weight(F.lit(7), F.col("id")).alias("w")).groupBy("w").count().collect()
    seen = {x["w"]: x["count"] / n for x in w}
    assert abs(seen[0] - 0.3679) < 0.01 and abs(seen[1] - 0.3679) < 0.01 and abs(sum(k * v for k, v in seen.items()) - 1) < 0.02


def test_a_longest_unit_of_each_cluster_stays(spark):
    units = spark.createDataFrame([(1, 1, 5), (2, 1, 9), (3, 1, 9), (4, 1, 2)], "id bigint, start_line int, end_line int")
    members = units.where("id < 4").withColumn("cluster_id", F.lit("c"))
    assert sorted(map(tuple, intervals.removable_units(members, units).collect())) == [(1, 5, 5), (2, 9, 0), (3, 9, 9), (4, 2, 0)]


def test_a_content_is_computed_once(spark, tmp_path):
    seen, cache = [], f"{tmp_path}/cache"

    def compute(unknown):
        seen.append(sorted(x["content_hash"] for x in unknown.collect()))
        return unknown.withColumn("vector", F.array(F.length("content_hash").cast("double"), F.lit(1.0)))

    units = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None)], "id bigint, content_hash string")
    for _ in range(2):
        assert sorted(x["content_hash"] for x in rerank.vectors(units, compute, cache).collect()) == ["a", "bb"]
    more = units.unionByName(spark.createDataFrame([(5, "ccc")], "id bigint, content_hash string"))
    of = rerank.vectors(more, compute, cache)
    assert seen == [["a", "bb"], ["ccc"]]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (1, 5)], "l bigint, r bigint")
    got = {(x["l"], x["r"]): x["cosine"] for x in rerank.reranked(pairs, more, of).collect()}
    assert got[3, 4] is None and abs(got[1, 2] - 1) < 1e-12 and abs(got[1, 3] - 3 / (2**0.5 * 5**0.5)) < 1e-12


def test_vectors_without_a_direction_have_none(spark):
    rows = [([0.0, 0.0],), (None,), ([1.0, None],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([3.0, 4.0],), ([],)]
    got = spark.createDataFrame(rows, "v array<double>").select(rerank.unit_vector(F.col("v")).alias("u")).collect()
    assert [x["u"] for x in got] == [None, None, None, None, None, [0.6, 0.8], None]
    two = spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert two.select(rerank.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] is None
