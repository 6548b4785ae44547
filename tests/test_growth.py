"""What has to grow no faster than the input."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from echofold.functions import scalars
from echofold.operators import clones, fingerprint, sampling
from echofold.plans import code_tree, registry
from echofold.sources import units
from test_operators import walk

DATA = "/root/testdata/sf0.001"


def test_large_numbers_are_shortened_as_c_prints_them(spark):
    # 1002.05 lies under its double, 1000.25 is one: below 1024 a double has 43 binary places.
    values = [1_000_250_000, 1_002_050_000, 1_010_350_000, 1_023_950_000, 1_024_050_000, 8_191_950_000, 9_000_650_000, 2_000_450_000_000, 999_950_000, 77_350]
    values += list(range(1_000_050_000, 1_030_000_000, 100_000))
    got = {r["v"]: r["shown"] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", scalars.compact(F.col("v")).alias("shown")).collect()}

    def plain(v):
        by, unit = (1_000_000, "M") if v >= 1_000_000 else (1000, "K")
        return f"{v / by:.1f}".removesuffix(".0") + unit

    assert {v: got[v] for v in values if got[v] != plain(v)} == {}


def test_a_python_file_is_read_in_time_linear_in_its_length():
    def seconds(n):
        text = "\n\n".join(f"def f{i}(a):\n    b = g{i}(a)\n    c = 'é'\n    return b + c" for i in range(n))
        start = time.perf_counter()
        rows = units.rows_of("a.py", "python", text)
        took = time.perf_counter() - start
        assert [r["text"].splitlines()[0] for r in rows if r["kind"] == "unit"] == [f"def f{i}(a):" for i in range(n)]
        return took

    seconds(100)
    assert seconds(4000) < 30 * seconds(500)  # eight times the text; cutting units out line by line took 60 times as long


def test_rows_of_many_files_share_batches(spark):
    files = spark.createDataFrame([(f"f{i}.py", f"import m{i}\n", "python") for i in range(500)], "path string, source string, language string").coalesce(1)
    sizes = []
    parsed = units.extracted(files).mapInArrow(lambda batches: (b.from_arrays([b.column("path").slice(0, 1)], names=["path"]) for b in batches), "path string")
    sizes.append(parsed.count())
    assert sizes[0] <= 5 and units.extracted(files).count() == 500
    assert units.extracted(spark.createDataFrame([("a.py", "def f():\n  a\n  b\n", "python")], files.schema), texts=False).select("kind", "text").collect()[0][:] == ("unit", None)


def test_names_of_files_are_known_without_their_text(spark):
    named, whole = code_tree.paths(spark, DATA), code_tree.files(spark, DATA).select("path", "language")
    assert named.exceptAll(whole).count() == whole.exceptAll(named).count() == 0
    of, g = code_tree.symbol_graph(spark, DATA)
    assert "orders" not in " ".join(g.fully_resolved(of).inputFiles())


def test_pairs_measured_in_cells_equal_plain_ones(spark):
    r = random.Random(5)
    sets = {i: (sorted(r.sample(range(40), r.randrange(0, 12))), sorted(r.sample(range(9), r.randrange(0, 5)))) for i in range(60)}
    pairs = [(i, j) for i in sets for j in sets if i < j and (r.random() < 0.3 or i == 0)]
    held = spark.createDataFrame([(i, a, b) for i, (a, b) in sets.items()], "id bigint, one array<bigint>, two array<bigint>")
    asked = spark.createDataFrame(pairs, "l bigint, r bigint")

    def plain(a, b):
        return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0

    want = {(i, j): (plain(sets[i][0], sets[j][0]), plain(sets[i][1], sets[j][1])) for i, j in pairs}
    for at_once in (2, 256):
        got = clones.measured(asked, held, at_once=at_once).collect()
        assert len(got) == len(want) and {(x["l"], x["r"]): (x["one"], x["two"]) for x in got} == want
    assert {(x["l"], x["r"]) for x in clones.measured(asked, held, 0.25).collect()} == {k for k, v in want.items() if v[0] >= 0.25}


def test_copies_of_documents_are_not_measured(spark, tmp_path):
    texts = [" ".join(f"w{k}" for k in range(n, n + 60)) for n in (0, 1, 2, 500)]
    rows = [(i, texts[i % 4] if i % 4 < 3 else texts[3] + f" x{i}", "en", f"s{i % 3}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    folded, scored = registry.raw_pairs(spark, str(tmp_path))
    assert scored.where("l < 3 and r < 3").count() == 3 and folded.count() == 200  # 150 documents, three texts
    found = {(x["l"], x["r"]) for x in registry.structural_overlap_pairs(spark, str(tmp_path)).collect()}
    assert found == {(i, j) for i in range(200) for j in range(i + 1, 200) if (i % 4 < 3) == (j % 4 < 3)}
    assert registry.similarity_band_histogram(spark, str(tmp_path)).agg(F.sum("pairs")).first()[0] == len(found)
    top = sorted((x["l"], x["r"]) for x in registry.cluster_evidence_top3(spark, str(tmp_path)).collect())
    assert top == [(0, 1), (0, 2), (0, 4), (3, 7), (3, 11), (3, 15)]


def test_the_walk_is_handed_what_it_can_choose_and_no_more(spark):
    r = random.Random(7)
    hubs = [f"u{i:03}" for i in range(6)]
    rows = [(a, f"u{j:03}", f"f{int(a[1:]) % 2}", f"f{j % 2}", 0.9) for a in hubs for j in range(10, 400)]
    rows += [(f"u{i:03}", f"u{j:03}", f"f{i % 2}", f"f{j % 2}", round(r.uniform(0.55, 0.97), 2)) for i in range(400, 450) for j in range(i + 1, 450)]
    rows += [(f"v{i}", f"v{i + 1}", f"g{i % 9}", f"g{(i * 7) % 9}", round(r.uniform(0.55, 0.97), 2)) for i in range(0, 300, 2)]
    scored = spark.createDataFrame(rows, sampling.SCHEMA)
    got = sampling.diverse(scored).orderBy("rank").collect()
    assert [tuple(x)[:5] for x in got] == walk(rows, 60)
    handed = sampling.reachable(sampling.banded(sampling.in_range(scored))).groupBy("band", F.least("l_path", "r_path"), F.greatest("l_path", "r_path")).count()
    assert handed.agg(F.max("count")).first()[0] <= 99


def test_strings_are_hashed_a_slice_at_a_time(spark, monkeypatch):
    strings = [f"a b c {i % 70_000}" for i in range(150_000)]
    want, sizes, one = fingerprint.blake2b(strings), [], fingerprint.blake2b
    monkeypatch.setattr(fingerprint, "blake2b", lambda s: (sizes.append(len(s)), one(s))[1])
    assert (fingerprint.hashed(pa.array(strings)) == want).all() and max(sizes) <= fingerprint.AT_ONCE and sum(sizes) == len(strings)
    monkeypatch.undo()
    fingerprint.with_signature(spark.createDataFrame([(1, ["x"])], "id bigint, hashes array<string>"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_detectors_share_their_candidates(spark, monkeypatch):
    calls, one = [], registry.small_signatures
    monkeypatch.setattr(registry, "small_signatures", lambda *a: (calls.append(a), one(*a))[1])
    assert registry.detector_scores(spark, DATA).columns == ["l", "r", "baseline", "renamed", "flat"] and len(calls) == 1
