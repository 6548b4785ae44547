from echofold.plans import registry
from echofold.streaming.incremental import FirstMatches, NearMatches


def test_batches_meet_earlier_ones(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(60))
    batches = [[(1, text), (2, "x y z")], [(3, text), (4, "q")], [(5, text + " t60"), (6, "x y z")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id bigint, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    index = NearMatches(f"{tmp_path}/out")
    index.start(stream).awaitTermination()
    found = {tuple(sorted((r["l"], r["r"]))) for r in index.matches(spark).collect()}
    assert found == {(1, 3), (1, 5), (3, 5), (2, 6)}
    index.add(spark.read.parquet(f"{tmp_path}/in/2"), 2)
    assert {tuple(sorted((r["l"], r["r"]))) for r in index.matches(spark).collect()} == found


def test_first_matches_meet_the_units_that_opened_their_buckets(spark, tmp_path):
    """One row of index a bucket, written by the batch that opened it; a replayed batch changes nothing."""
    batches = [[(1, list(range(40))), (2, [900, 901]), (None, list(range(40))), (8, [])], [(3, list(range(40))), (4, list(range(1, 41))), (9, [])], [(5, list(range(40))), (6, [900, 901]), (6, [900, 901]), (7, [77])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id bigint, hashes array<bigint>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id bigint, hashes array<bigint>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    index = FirstMatches(f"{tmp_path}/out", 16, 4, 0.5)
    index.start(stream).awaitTermination()
    found = sorted(map(tuple, index.matches(spark).collect()))
    assert {x[:2] for x in found if x[0] != 4} == {(3, 1), (5, 1), (6, 2), (9, 8)} and {x[1] for x in found if x[0] == 4} <= {1}
    assert all(x[2] == 1.0 for x in found if x[0] != 4)
    buckets = spark.read.parquet(f"{tmp_path}/out/index")
    assert buckets.count() == buckets.select("band", "key").distinct().count() and buckets.where("first in (3, 5, 6, 9)").count() == 0
    index.add(spark.read.parquet(f"{tmp_path}/in/2"), 2)
    assert sorted(map(tuple, index.matches(spark).collect())) == found


def test_documents_are_met_through_the_index_in_tables(spark, sf, monkeypatch):
    queries, one = [], FirstMatches.start
    monkeypatch.setattr(FirstMatches, "start", lambda *a: (queries.append(one(*a)), queries[-1])[1])
    registry.incremental_matches(spark, sf)
    assert len(queries) == 4
