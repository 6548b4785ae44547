import random
from itertools import accumulate

from pyspark.sql import functions as F

from echofold.operators import clones, running
from echofold.operators.running import budget_report, run_budget, running_total


def test_running_total_equals_a_plain_sum(spark):
    r = random.Random(2)
    rows = [(i // 7, i % 7, r.choice([None, 0, 1, 5, 1 << 40])) for i in range(300)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "a int, b int, cost bigint").repartition(5)
    got = {(x["a"], x["b"]): x["before"] for x in running_total(df, ["a", "b"], "cost", parts=9).collect()}
    want = accumulate((c or 0 for _, _, c in rows), initial=0)
    assert got == {(a, b): w for (a, b, _), w in zip(rows, want)}
    assert running_total(df.limit(0), ["a"], "cost").count() == 0
    back = running_total(df, [F.desc("a"), F.desc("b")], "cost", parts=3).where("a = 42 and b = 5").first()
    assert back["before"] == 0
    nulls = spark.createDataFrame([(None, 3), (1, 4)], "a int, cost bigint")
    assert {x["a"]: x["before"] for x in running_total(nulls, ["a"], "cost").collect()} == {None: 0, 1: 3}


def test_running_total_has_no_task_that_sees_all_rows(spark):
    df = spark.range(1000).withColumn("cost", F.lit(1).cast("bigint"))
    plan = running_total(df, ["id"], "cost", parts=8)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_budget_is_spent_once_for_the_run(spark):
    calls = spark.createDataFrame([(i, 10) for i in range(20)], "seq int, tokens bigint")
    rows = run_budget(calls, 35, ["seq"], parts=4)
    got = [(r["spent"], r["allowed"]) for r in rows.orderBy("seq").collect()]
    assert got == [(0, True), (10, True), (20, True), (30, True)] + [(40, False)] * 16
    assert tuple(budget_report(rows, 35).first()) == (4, 16, 40, True, 35)
    assert [r["spent"] for r in run_budget(calls, 0, ["seq"]).collect()] == [0] * 20
    assert tuple(budget_report(run_budget(calls, 1000, ["seq"]), 1000).first()) == (20, 0, 200, False, 1000)


def plain_clusters(rows, width=4, threshold=0.8):
    from echofold.functions.lexical import TOKEN_PATTERN
    import re

    sets = {}
    for i, text in rows:
        t = re.findall(TOKEN_PATTERN, text or "")
        sets[i] = {tuple(t[k : k + width]) for k in range(max(1, len(t) - width + 1))} if t else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = [(i, find(i)) for i in sets]
    size = {}
    for _, c in out:
        size[c] = size.get(c, 0) + 1
    return sorted((i, c) for i, c in out if size[c] > 1)


def test_near_copies_equal_all_pairs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    bases = [r.choices(words, k=80) for _ in range(6)]
    rows = [(i, "copy of this text \"in quotes\" and more of it") for i in range(100, 400)]  # more than a bucket may hold
    for i in range(90):
        w = r.choice(bases)[:]
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(80)] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, "one"), (1004, "one"), (1005, "two"), (1006, "x y z"), (1007, "x  y z")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = sorted(map(tuple, clones.near_copies(df).collect()))
    assert got == plain_clusters(rows)
    assert clones.near_copies(df.limit(0)).count() == 0


def test_copies_are_never_paired(spark):
    df = spark.createDataFrame([(i, "a b c d e f g") for i in range(500)] + [(500 + i, f"a b c d e f g h{i}") for i in range(3)], "id bigint, text string")
    _, signed = clones.representatives(df)
    assert signed.count() == 4
    assert running is not None and clones.links(df, signed, 0.1).count() == 6
