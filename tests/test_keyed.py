import random

from echofold.plans import registry
from echofold.streaming import keyed


def add(spark, rows, folder):
    spark.createDataFrame(rows, "id bigint, signature array<bigint>").coalesce(2).write.mode("append").parquet(f"{folder}/in")


def go(spark, folder, **options):
    stream = spark.readStream.schema("id bigint, signature array<bigint>").parquet(f"{folder}/in")
    query = keyed.start(keyed.matches(stream, 4, 2, **options), folder)
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return (state[-1]["numRowsTotal"], sum(s["numRowsUpdated"] for s in state)) if state else (0, 0)


def found(spark, folder):
    return sorted(map(tuple, keyed.first_matches(spark.read.schema(keyed.MATCH).parquet(f"{folder}/matches")).collect()))


def test_state_is_one_row_a_bucket_and_grows_by_new_ones(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, [(1, [1, 2, 3, 4]), (2, [9, 9, 9, 9]), (None, [1, 2, 3, 4])], folder)
    assert go(spark, folder, floor=0.5) == (4, 4)
    add(spark, [(3, [1, 2, 3, 4]), (4, [1, 2, 7, 8])], folder)
    assert go(spark, folder, floor=0.5) == (5, 1)  # the bucket (7, 8) of unit 4
    add(spark, [(5, [1, 2, 3, 4])] * 3 + [(6, [5, 6, 7, 8])], folder)
    assert go(spark, folder, floor=0.5) == (6, 1)
    assert go(spark, folder, floor=0.5) == (0, 0)  # nothing new
    assert found(spark, folder) == [(3, 1), (4, 1), (5, 1), (6, 4)]


def test_copies_of_a_batch_follow_its_first(spark, tmp_path):
    folder = str(tmp_path)
    add(spark, [(10 + k, [1, 2, 3, 4]) for k in range(50)] + [(5, [1, 2, 0, 0])], folder)
    go(spark, folder, floor=0.5)
    assert found(spark, folder) == [(10 + k, 5) for k in range(50)]


def test_batches_give_what_one_pass_gives(spark, tmp_path):
    r = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    bases = [r.choices(words, k=30) for _ in range(10)]
    docs = []
    for i in range(160):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(30)] = r.choice(words)
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    one, four = (sorted(map(tuple, registry.incremental(spark, df, n).collect())) for n in (1, 4))
    assert sorted(set(one) ^ set(four)) == [] and len(one) > 50
