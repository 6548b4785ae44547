"""Fingerprints and the audit of sources, held against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from echofold.llm import source_audit, winnowing

DOCS = "doc_id bigint, text string, lang string, source string"


def plain_winnow(data, hashes, gram, window):
    """Positions that the definition selects, given the hash of each gram."""
    n = max(1, len(data) - gram + 1) if data else 0
    out = []
    for start in range(max(1, n - window + 1) if n else 0):
        inside = range(start, min(start + window, n))
        at = max(inside, key=lambda i: (-hashes[i], i))
        if not out or out[-1] != at:
            out.append(at)
    return out


@pytest.mark.parametrize("gram,window", [(12, 32), (3, 4), (1, 1), (5, 255)])
def test_selections_are_those_of_the_definition(gram, window):
    r, winnow = random.Random(gram), winnowing.Winnower(gram, window)
    texts = [b"", b"a", b"ab" * 3, b"a" * 500] + [bytes(r.choice(b"ab c") for _ in range(r.randrange(1, 400))) for _ in range(60)]
    for data in texts:
        one = [int(winnow.hashes(np.frombuffer(data[i : i + gram], np.uint8))[0]) for i in range(max(1, len(data) - gram + 1))] if data else []
        hashes, places = winnow(data)
        assert list(places) == plain_winnow(data, one, gram, window)
        assert list(hashes) == [one[i] for i in places]
        back = winnowing.decoded(winnowing.encoded(hashes, places))
        assert list(back[0]) == list(hashes) and list(back[1]) == list(places)


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    r = random.Random(3)
    data = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    whole = winnowing.Winnower()(data)
    monkeypatch.setattr(winnowing, "BLOCK", 97)
    parts = winnowing.Winnower()(data)
    assert list(whole[0]) == list(parts[0]) and list(whole[1]) == list(parts[1])
    for same in (b"a" * 1000, data):
        a = winnowing.Winnower()(same)
        monkeypatch.setattr(winnowing, "BLOCK", 1 << 18)
        b = winnowing.Winnower()(same)
        monkeypatch.setattr(winnowing, "BLOCK", 97)
        assert list(a[0]) == list(b[0]) and list(a[1]) == list(b[1])


def test_a_shared_run_of_the_guaranteed_length_is_found_in_place():
    r, winnow = random.Random(5), winnowing.Winnower()
    for _ in range(300):
        run = bytes(r.choice(b"abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
        (i, a), (j, b) = ((len(x), x + run + y) for x, y in [[bytes(r.choice(b"xyzw") for _ in range(r.randrange(200))) for _ in range(2)] for _ in range(2)])
        found = [{(h, p - at) for h, p in zip(*(x.tolist() for x in winnow(text))) if 0 <= p - at <= winnowing.WINDOW - 1} for at, text in ((i, a), (j, b))]
        assert found[0] & found[1]


def plain_fingerprints(rows):
    winnow = winnowing.Winnower()
    out = []
    rows = [(d, t or "") for d, t in rows]
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) - len(t) // 4
        changed = t[:cut] + following[: len(t) // 4]
        a, b, c = (set(winnow(x.encode())[0].tolist()) for x in (t, changed, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), winnowing.encoded(*winnow(t.encode())), winnowing.encoded(*winnow(changed.encode())), like(a, b), like(a, c)))
    return out


def key(row):
    return repr(row)


def test_fingerprints_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_BYTES", 20_000)
    r = random.Random(7)
    words = ["été", "straße", "🙂", "año", "alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(0, 400, 2)]
    rows += [(401, None), (402, ""), (403, "a"), (404, "abcd"), (405, "a" * 3000), (406, " ".join(r.choices(words, k=60_000))), (-5, "first of all ids"), (408, rows[3][1]), (410, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "'x' AS guest", "2 AS known", "3 AS id", "4 AS h", "5 AS fingerprint").repartition(7)
    got = sorted(map(tuple, winnowing.fingerprints(df).collect()), key=key)
    assert got == sorted(plain_fingerprints(sorted(rows)), key=key)
    by_id = {g[0]: g for g in got}
    assert by_id[408][6] == 1.0 and by_id[408][3] == by_id[6][3] == by_id[410][3]
    assert by_id[401][3] == "" and by_id[401][6] == 1.0
    assert winnowing.fingerprints(df.limit(0)).count() == 0
    one = winnowing.fingerprints(df.where("doc_id = 404")).first()
    assert one["near_next"] == 1.0  # its own next


def test_rows_without_id_and_repeated_rows_have_a_place(spark):
    rows = [(None, "no id here"), (None, None), (1, "same text"), (1, "same text"), (1, "same text"), (2, "the last one of them")]
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 6 and sorted(g["near_next"] == 1.0 for g in got if g["doc_id"] == 1) == [False, True, True]
    # Rows without id come first: the last document is followed by one of them.
    last = next(g for g in got if g["doc_id"] == 2)
    assert last["edited_sha256"] in {hashlib.sha256(("the last one of them"[:15] + t[:5]).encode()).hexdigest() for t in ("no id here", "")}


def test_selections_are_rows_of_the_operator(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 9), (2, None)], "doc_id bigint, text string")
    got = sorted((g["position"], g["hash"]) for g in winnowing.selections(df).collect())
    hashes, places = winnowing.Winnower()(b"abcdefghij" * 9)
    assert got == list(zip(places.tolist(), hashes.tolist()))


def test_every_document_of_the_table_is_closer_to_its_edit(spark, sf):
    got = winnowing.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).where("n_chars >= 100").collect()
    assert got and all(0 <= g["near_next"] <= 1 and 0 < g["near_edited"] <= 1 for g in got)
    assert sum(g["near_edited"] > g["near_next"] for g in got) >= 0.99 * len(got)


# --- audit of sources --------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least_docs=10, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= least_docs), key=lambda t: t.encode())
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        every = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, p = shares(every), {s: shares(c) for s, c in counts.items()}
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_audit.audit(df, **options).collect())


def test_audit_equals_a_plain_version(spark):
    r = random.Random(11)
    words = ["Été", "été", "Straße", "año", "Alpha", "alpha", "BETA", "beta", "x1y", "don't", "🙂🙂", "漢字", "É"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choices(words, weights=range(1, len(words) + 1), k=r.randrange(0, 40))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "", None, "Z", "é"])) for i in range(400)]
    rows += [(1000, None, "en", "silent"), (1001, "12 34 --", "en", "silent"), (1002, "alone", "xx", "only"), (1003, "rare", "yy", "one"), (1004, None, "yy", "two"), (None, "alpha " * 50_000, "en", "a")]
    rows += [rows[0]] * 30
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS term", "2 AS n", "3 AS salt", "4 AS terms", "5 AS first", "6 AS rank").repartition(5)
    got = audited(df)
    assert got == plain_audit(rows)
    assert ("yy", "one", "pair", "two", 0, 1) in got and not [g for g in got if g[0] == "xx"]
    assert audited(df, least_docs=1, top=3) == plain_audit(rows, 1, 3)
    assert audited(df.limit(0)) == []


def test_shares_hold_for_counts_beyond_64_bits_of_product(spark):
    n, total, v = 600_000_000_001, 7_000_000_000_003, 12_345
    df = spark.sql(f"SELECT {n}L AS n, {total}L AS total, {v}L AS v")
    got = df.select(source_audit.share(df["n"], df["total"], df["v"]).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)
