import datetime as dt
import random

from echofold.operators.candidates import most_similar
from echofold.operators.divergence import diverged


def test_budget_by_similarity_equals_a_sort(spark):
    r = random.Random(1)
    rows = [(i, i + r.randrange(1, 50), r.choice([0.0, 0.5, 1.0, 0.25, r.random(), None])) for i in range(400)]
    df = spark.createDataFrame(rows, "l bigint, r bigint, score double").repartition(6)
    order = sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0), x[0], x[1]))
    for budget in (0, 1, 17, 120, 399, 400, 1000):
        for bins in (4, 1024):
            assert sorted(map(tuple, most_similar(df, "score", budget, bins).collect()), key=repr) == sorted(order[:budget], key=repr)
    assert most_similar(df.limit(0), "score", 5).count() == 0


def at(day, hour=0):
    return dt.datetime(2024, 5, 1) + dt.timedelta(days=day, hours=hour)


def test_divergence(spark):
    log = [
        ("a", at(0), 1), ("b", at(0), 1), ("a", at(1), 2), ("b", at(2), 3),  # together, then each on its own
        ("c", at(0), 1), ("d", at(1), 4), ("c", at(3), 5), ("d", at(3), 5),  # together last
        ("e", at(5), 6), ("f", at(-200), 7), ("g", at(4), 8), ("g", None, 9), (None, at(6), 10),
    ]
    pairs = [(1, "a", "b"), (2, "c", "d"), (3, "a", "c"), (4, "e", "g"), (5, "e", "f"), (6, "a", "a"), (7, None, "a"), (8, "z", "a"), (1, "a", "b")]
    df = diverged(spark.createDataFrame(pairs, "id int, l_path string, r_path string"), spark.createDataFrame(log, "path string, ts timestamp, commit int"))
    got = sorted((x["id"], x["exclusion"], x["last_common"]) for x in df.collect())
    apart = "diverged_history"
    assert got == [(1, apart, at(0)), (1, apart, at(0)), (2, None, at(3)), (3, apart, at(0)), (4, apart, None), (5, None, None), (6, None, None), (7, None, None), (8, None, None)]
    assert diverged(spark.createDataFrame([], "id int, l_path string, r_path string"), spark.createDataFrame(log, "path string, ts timestamp, commit int")).count() == 0
