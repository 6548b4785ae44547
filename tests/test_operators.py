import hashlib
import random

import pytest
from pyspark.sql import functions as F

from echofold.operators import candidates, clusters, evaluate, judge, sampling
from echofold.operators.components import connected_components
from echofold.operators.fingerprint import PRIME, band_keys, coefficients, estimated_jaccard, with_signature


def signed(spark, sets, k=128):
    return with_signature(spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id bigint, hashes array<string>"), permutations=k)


def test_signature_is_the_formula(spark):
    s = ["a b", "b c", "ü"]
    got = signed(spark, [s, []], 8).orderBy("id").collect()
    hs = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in s]
    assert got[0]["signature"] == [min((a * h + b) % PRIME for h in hs) for a, b in coefficients(8)]
    assert got[1]["signature"] == [PRIME] * 8


def test_estimate_is_near_the_truth(spark):
    rows = signed(spark, [[f"tok{i}" for i in range(50)], [f"tok{i}" for i in range(10, 60)]])
    pair = rows.alias("x").join(rows.alias("y"), F.expr("x.id < y.id"))
    est = pair.select(estimated_jaccard(F.col("x.signature"), F.col("y.signature")).alias("e")).first()["e"]
    assert abs(est - 40 / 60) < 0.12


def test_bands_must_divide():
    with pytest.raises(ValueError, match="divide"):
        band_keys(F.lit(None), 10, 3)


def test_budget_and_caps(spark):
    rows = signed(spark, [["same"]] * 20)
    found = candidates.generate(rows, budget=5)
    assert (found.considered, found.kept, found.dropped_to_budget, found.truncated, found.pairs.count()) == (190, 5, 185, True, 5)
    assert [tuple(r) for r in found.pairs.orderBy("l", "r").collect()] == [(0, i) for i in range(1, 6)]
    many = signed(spark, [["same"]] * 50)
    assert candidates.generate(many, max_bucket=10).considered == 0
    assert candidates.generate(many, max_bucket=10).oversized_buckets == 32
    assert candidates.generate(many, max_bucket=100).considered == 50 * 49 // 2


def test_empty_sets_collide(spark):
    assert candidates.generate(signed(spark, [[], []])).considered == 1


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert dict(tuple(x) for x in got.collect()) == plain_components(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def unit(i, path, start, lines, name):
    return (i, path, start, start + lines - 1, name)


UNITS = "id bigint, path string, start_line bigint, end_line bigint, name string"


def test_clusters_and_removable_lines(spark):
    units = spark.createDataFrame([unit(0, "a.py", 1, 30, "C.f"), unit(1, "b.py", 1, 10, "g"), unit(2, "c.py", 5, 10, "h"), unit(3, "z.py", 1, 9, "q")], UNITS)
    found = spark.createDataFrame([(0, 1), (1, 2)], "l bigint, r bigint")
    of = clusters.members(found, units)
    assert [tuple(r) for r in clusters.sizes(of).collect()] == [("a.py:1:C.f", 3, 50, 20)]
    refs = spark.createDataFrame([("a.py", "f"), ("a.py", "f"), ("b.py", "f")], "target_path string, name string")
    holes = spark.createDataFrame([("a.py", "external_package"), ("b.py", "wildcard_import"), ("b.py", "external_package")], "path string, reason string")
    churn = spark.createDataFrame([("a.py", 3), ("b.py", 1)], "path string, commits bigint")
    row = clusters.blast_radius(of, refs, holes, churn).first()
    assert (row["call_sites"], row["churn"], row["unresolved_paths"]) == (2, 4, 1)
    import math

    assert math.isclose(row["score"], 20 * (1 + math.log1p(2)) * (1 + math.log1p(4)))
    assert clusters.blocked_reasons(of, holes).first()["reasons"] == ["external_package", "wildcard_import"]


def test_churned_cluster_ranks_first(spark):
    units = spark.createDataFrame([unit(i, f"{p}.py", 1, 10, "f") for i, p in enumerate("abcd")], UNITS)
    of = clusters.members(spark.createDataFrame([(0, 1), (2, 3)], "l bigint, r bigint"), units)
    churn = spark.createDataFrame([("d.py", 9)], "path string, commits bigint")
    assert [r["cluster_id"] for r in clusters.ranked(clusters.blast_radius(of, churn=churn)).collect()] == ["c.py:1:f", "a.py:1:f"]
    assert [r["cluster_id"] for r in clusters.ranked(clusters.blast_radius(of), 1).collect()] == ["a.py:1:f"]


def test_scores_guard_zero(spark):
    rows = spark.createDataFrame([("not_duplicate", "uncertain")], "label string, verdict string")
    s = evaluate.scores(evaluate.confusion(rows, F.col("label") == "duplicate", F.col("verdict"))).first()
    assert (s["precision"], s["recall"], s["f1"], s["uncertain"]) == (0.0, 0.0, 0.0, 1)


def test_remediable_needs_advice(spark):
    rows = spark.sql("select 'duplicate' verdict, named_struct('recommended', true) advice union all select 'duplicate', named_struct('recommended', false) union all select 'uncertain', named_struct('recommended', true)")
    assert judge.remediable(rows).count() == 1


def walk(rows, limit):
    """A plain version of the diversity walk."""
    bands = {b: [] for b in sampling.BANDS}
    for r in sorted(rows, key=lambda r: (-r[4], r[0], r[1])):
        if sampling.LOW <= r[4] <= sampling.HIGH:
            bands[max(b for b in sampling.BANDS if r[4] >= b)].append(r)
    used, out, go = {}, [], True
    while go and len(out) < limit:
        go = False
        for b in sampling.BANDS:
            while bands[b] and len(out) < limit:
                r = bands[b].pop(0)
                keys = [("c", r[0], 2), ("c", r[1], 2), ("f", r[2], 6), ("f", r[3], 6), ("p", tuple(sorted(r[2:4])), 3)]
                if all(used.get(k[:2], 0) < k[2] for k in keys):
                    for k in keys:
                        used[k[:2]] = used.get(k[:2], 0) + 1
                    out.append(r)
                    go = True
                    break
    return out


def test_diverse_sample_equals_a_plain_walk(spark):
    r = random.Random(3)
    rows = [(f"u{i}", f"u{j}", f"f{i % 5}", f"f{j % 5}", round(r.uniform(0.5, 1), 3)) for i in range(20) for j in range(i + 1, 20)]
    got = sampling.diverse(spark.createDataFrame(rows, sampling.SCHEMA), 25).orderBy("rank").collect()
    assert [tuple(x)[:5] for x in got] == walk(rows, 25)


def test_diverse_sample_of_nothing(spark):
    assert sampling.diverse(spark.createDataFrame([], sampling.SCHEMA)).count() == 0


def test_large_groups_of_copies_are_whole(spark, tmp_path):
    """More copies than the cap of the candidate list: pairs as in the SQL, and one component."""
    from compare import duck, rows_of
    from echofold.plans import registry

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 230 + [" ".join([*words[:-1], f"z{i}"]) for i in range(5)] + ["", "", "other words of one more text"]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    df, cur = registry.QUERIES["structural_overlap_pairs"](spark, str(tmp_path)), duck(str(tmp_path)).execute(registry.ORACLES["structural_overlap_pairs"])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
    assert {tuple(r) for r in registry.QUERIES["duplicate_components"](spark, str(tmp_path)).collect()} == {(i, 0) for i in range(235)}


def test_detectors_can_be_added(spark):
    from echofold.functions import lexical
    from echofold.operators import judge

    mine = judge.Detector("two-token-runs", 0.5, 0.1, 2, lexical.normalized)
    judge.register("mine", mine)
    try:
        with pytest.raises(ValueError):
            judge.register("baseline", mine)
        units = judge.detectors()["mine"].prepare(spark.createDataFrame([(1, "if a b c"), (2, "if a b d")], "id int, text string"))
        pairs = spark.createDataFrame([(1, 2)], "l int, r int")
        assert judge.detectors()["mine"].judge(judge.paired(pairs, units)).first()["verdict"] == judge.DUPLICATE
    finally:
        judge._DETECTORS.pop("mine")
