"""Operators on documents against brute force, and their defined results for odd rows."""

import math
import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echofold.llm import decontaminate, minhash_forest, mixing, ordinal_quality, prefix_tokens, substring_dedup, toxicity
from echofold.llm.words import utf8

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def corpus(seed=0, n=60):
    """Near and exact copies, shared passages, blanks."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    base = [text(120) for _ in range(6)]
    passage = text(80)
    rows = []
    for i in range(n):
        kind = r.random()
        t = r.choice(base).split()
        if kind < 0.5:
            for _ in range(r.randint(0, 9)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            t = " ".join(t)
        elif kind < 0.7:
            t = text(r.randint(0, 60)) + "\n" + passage + " " + text(r.randint(0, 60))
        elif kind < 0.8:
            t = r.choice(["", " ", None, "One", "one", "A b", "a  B"])
        else:
            t = text(r.randint(1, 200))
        rows.append((i, t, f"s{i % 3}"))
    return rows


def odd(spark, docs):
    """The same rows with more columns, of names that operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("id", "n", "k0", "a", "key", "rep", "component", "row_key", "first", "score", "kept", "_gone")})


@pytest.mark.parametrize(("seed", "size"), [(0, 2), (1, 5)])
def test_near_duplicates(spark, seed, size):
    rows = corpus(seed)
    got = minhash_forest.near_duplicates(odd(spark, table(spark, rows)), size).collect()
    assert sorted(map(tuple, got)) == brute.near_duplicates([r[:2] for r in rows], size)
    left = minhash_forest.without_copies(odd(spark, table(spark, rows)), size)
    assert sorted(r["doc_id"] for r in left.where("_gone = 'x'").collect()) == [r["doc_id"] for r in sorted(got) if r["kept"]]


def test_near_duplicates_of_a_crowd(spark):
    """A large group of near copies, more than a window reaches, is one component; strangers stay alone."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(4):
            t[r.randrange(200)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(t), "s"))
    rows += [(1000 + i, " ".join(f"y{r.randrange(9999)}" for _ in range(50)), "s") for i in range(20)]
    got = sorted(map(tuple, minhash_forest.near_duplicates(table(spark, rows), 2).collect()))
    assert got == brute.near_duplicates([x[:2] for x in rows], 2)


def test_near_duplicates_on_fixture_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, minhash_forest.near_duplicates(docs, 2).collect())) == brute.near_duplicates(rows, 2)


def test_near_duplicates_odd_rows(spark):
    t = "a b c d e f g h"
    rows = [(None, t, "s"), (7, t, None), (7, t, "s"), (9, t, "s"), (3, None, "s"), (4, "", "s")]
    got = sorted((tuple(r) for r in minhash_forest.near_duplicates(table(spark, rows), 5).collect()), key=repr)
    assert got == sorted([(None, 4, None, True), (7, 4, 7, True), (7, 4, 7, True), (9, 4, 7, False), (3, 0, 3, True), (4, 0, 4, True)], key=repr)
    assert minhash_forest.near_duplicates(table(spark, rows).limit(0)).count() == 0
    assert sorted((r["doc_id"] for r in minhash_forest.without_copies(table(spark, rows)).collect()), key=repr) == sorted([None, 7, 7, 3, 4], key=repr)


@pytest.mark.parametrize("seed", [2, 3])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = substring_dedup.repeat_digests(odd(spark, table(spark, rows))).collect()
    want = brute.substring_dedup([r[:2] for r in rows])
    assert sorted(map(tuple, got)) == want and sum(w[2] for w in want) > 0
    whole = odd(spark, table(spark, rows))
    cut = substring_dedup.without_repeats(whole)
    assert cut.columns == whole.columns and cut.where("row_key <> 'x' or _gone <> 'x'").count() == 0
    kept = {r["doc_id"]: r["text"] for r in cut.collect()}
    import hashlib

    assert {d: hashlib.sha256(" ".join(brute.WORD.findall(t or "")).encode()).hexdigest() for d, t in kept.items()} == {w[0]: w[3] for w in want}


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_maximal_repeats(spark, seed):
    """Passages that share seeds but differ to their left, right or both, in crowds and in pairs."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30 if seed == 6 else 3000)]
    text = lambda k: r.choices(vocabulary, k=k)
    line, passages = text(20), [text(r.randint(45, 140)) for _ in range(5)]
    rows = []
    for i in range(120):
        t = text(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            kind = r.random()
            if kind < 0.3:
                p = p[r.randint(0, 30) :]
            elif kind < 0.6:
                p[r.randrange(len(p))] = r.choice(vocabulary[:4])
            elif kind < 0.8:
                p = p[: r.randint(20, len(p))] + line + p[20:]
            t += p + text(r.randint(0, 12))
        rows.append((r.randint(0, 10) * 1000 + i, " ".join(t + line * r.randint(0, 4)), "s"))
    got = sorted(map(tuple, substring_dedup.maximal_repeats(table(spark, rows)).collect()))
    assert got == brute.maximal_repeats([x[:2] for x in rows]) and got and min(x[2] for x in got) >= 50
    assert sorted(map(tuple, substring_dedup.repeat_digests(table(spark, rows)).collect())) == brute.substring_dedup([x[:2] for x in rows])
    assert substring_dedup.maximal_repeats(table(spark, rows).limit(0)).count() == 0


def test_substring_dedup_within_and_at_the_border(spark):
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, p + " " + p, "s"), (2, p, "s"), (3, " ".join(p.split()[:49]), "s"), (5, "q " + p + " z", "s")]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeat_digests(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 50, 3: 0, 5: 50}


def test_substring_dedup_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(None, p, "s"), (1, p, "s"), (2, p, "s"), (2, p, "s"), (2, p + " q", "t"), (3, None, "s"), (4, "", None)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.repeat_digests(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 60, 0), (1, 60, 0), (2, 60, 60), (2, 60, 60), (2, 61, 60), (3, 0, 0), (4, 0, 0)], key=repr)
    assert substring_dedup.without_repeats(table(spark, rows)).count() == 7
    assert substring_dedup.repeat_digests(table(spark, rows).limit(0)).count() == 0


def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(table(spark, [(-1, None, "s"), (-2, "", "s"), (-3, "<s> ▁a\x00 \n  é😀</s>", "s"), (-4, "ab" * 3000, "s"), (-4, " " * 40, None)]))
    rows = prefix_tokens.count_tokens(docs, tokenizer_file(), 4096).join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> -4").collect()
    assert all(r["n_tokens"] == len(sp.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)
    assert sorted(r["n_tokens"] for r in prefix_tokens.count_tokens(docs.where("doc_id = -4"), tokenizer_file()).collect()) == sorted([len(sp.encode("ab" * 3000)), len(sp.encode(" " * 40))])


def test_prefixes_are_exact():
    import sentencepiece

    sp, tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file()), prefix_tokens.PrefixTokens(tokenizer_file())
    text = "Thehein  ing<s>\nÜber 12.5 ▁▁ xx\x00"
    counts = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
    assert [tok.count_at(text, i) for i in range(len(text) + 1)] == counts
    assert tok.prefixes(text).tolist() == counts and tok.prefixes("").tolist() == [0] and tok.prefixes(None).tolist() == [0]
    for budget in range(max(counts) + 2):
        over = next((i for i, c in enumerate(counts) if c > budget), len(text) + 1)
        assert tok.fit(text, budget) == over - 1


def test_stored_prefixes_answer_without_encoding(spark):
    import sentencepiece

    sp, r = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file()), random.Random(2)
    texts = ["", None, "a  b ", "Ünï code 😀😀 x", "".join(r.choices("abc  <s>é\n", k=300)), "z" * 9000]
    rows = prefix_tokens.count_tokens(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), tokenizer_file(), 10, with_prefixes=True)
    rows = rows.select("*", *[prefix_tokens.count_at(F.col("prefix_tokens"), n).alias(f"at{n}") for n in (0, 1, 3, 50, 8000)], *[prefix_tokens.longest_fit(F.col("prefix_tokens"), b).alias(f"fit{b}") for b in (0, 1, 2, 60)])
    for x in rows.collect():
        t = texts[x["doc_id"]] or ""
        counts = [len(sp.encode(t[:i])) for i in (range(len(t) + 1) if len(t) < 1000 else (0, 1, 3, 50, 8000, 9000))]
        if len(t) < 1000:
            assert x["prefix_tokens"] == counts
            assert all(x[f"fit{b}"] == next((i for i, c in enumerate(counts) if c > b), len(t) + 1) - 1 for b in (0, 1, 2, 60))
        assert x["n_tokens"] == counts[-1] and x["over_limit"] == (counts[-1] > 10)
        assert all(x[f"at{n}"] == len(sp.encode(t[:n])) for n in (0, 1, 3, 50, 8000))


def test_caches_keep_within_bytes(monkeypatch):
    monkeypatch.setattr(prefix_tokens, "CACHE_BYTES", 20_000)
    tok, r = prefix_tokens.PrefixTokens(tokenizer_file()), random.Random(1)
    fresh = prefix_tokens.PrefixTokens(tokenizer_file())
    for _ in range(400):
        text = "".join(r.choices("abcdeé", k=r.randint(1, 60)))
        fresh.totals.clear()
        assert tok.count(text) == fresh.count(text)
        assert tok.totals_bytes <= 20_000 and tok.stable_bytes <= 20_500


def edits(r, words, k):
    w = list(words)
    for _ in range(k):
        i, kind = r.randrange(len(w)), r.random()
        if kind < 0.4:
            w[i] = f"zq{r.randrange(999)}"
        elif kind < 0.7 and len(w) > 1:
            del w[i]
        else:
            w.insert(i, f"zq{r.randrange(999)}")
    return w


def test_contamination_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate([5, 9, 15, 20, 31, 40, 57])]
    rows = []
    for i in range(150):
        host = r.choices(vocabulary, k=r.randint(0, 90))
        if i % 3:
            t = r.choice(items)[1].split()
            c = r.randint(0, len(host))
            host = host[:c] + edits(r, t, r.randint(0, len(t) // 4)) + host[c:]
        rows.append((i, " ".join(host).upper() if i % 5 == 0 else ", ".join(host), "s"))
    bench = spark.createDataFrame([*items, (None, "w1 w2"), (99, None), (98, " ")], "item_id bigint, text string")
    got = {x["doc_id"]: x for x in decontaminate.contamination(odd(spark, table(spark, rows)), bench).collect()}
    missed = 0
    for i, t, _ in rows:
        words = t.lower().replace(",", " ").split()
        want = {k: d for k, item in items if (d := brute.distance(item.split(), words)) <= int(0.2 * len(item.split()))}
        assert got[i]["n_items"] <= len(want) and (not got[i]["contaminated"] or want[got[i]["best_item"]] <= got[i]["best_distance"])
        missed += len(want) - got[i]["n_items"]
    assert missed <= 2  # the target recall is 0.999
    kept = {x["doc_id"] for x in decontaminate.without_leaks(table(spark, rows), bench).collect()}
    assert kept == {i for i in got if not got[i]["contaminated"]}


def test_frequent_words_are_read_in_stretches(spark, monkeypatch):
    """Whatever the number of runs held at a time, the same items are found."""
    r = random.Random(9)
    items = [(k, " ".join(r.choices("a b c d".split(), k=n))) for k, n in enumerate([1, 3, 6, 12, 20, 31])]
    rows = [(i, " ".join(r.choices("a b c d e".split(), k=r.choice([0, 5, 80, 900]))), "s") for i in range(40)]
    rows += [(100 + k, " ".join(r.choices("a b c d e".split(), k=700)) + " " + t + " " + " ".join(r.choices("a b c d e".split(), k=700)), "s") for k, t in items]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    once = sorted(map(tuple, decontaminate.contamination(table(spark, rows), bench).collect()))
    assert all(x[2] >= 1 for x in once if x[0] >= 100)
    hasher = decontaminate.WordHasher(fold_case=True, space=decontaminate.word_breaks())
    words, off = hasher(*utf8(pa.array([t for _, t, _ in rows])))
    whole = decontaminate.Items(items, 0.2).windows(words, off)
    monkeypatch.setattr(decontaminate, "HITS", 300)
    monkeypatch.setattr(decontaminate, "LEAST_STRETCH", 16)
    assert [x.tolist() for x in decontaminate.Items(items, 0.2).windows(words, off)] != [[]] * 3
    assert sorted(zip(*(x.tolist() for x in decontaminate.Items(items, 0.2).windows(words, off)))) == sorted(zip(*(x.tolist() for x in whole)))


def test_contamination_in_several_passes(spark, monkeypatch):
    rows = [(1, "a b c d e f g h", "s"), (1, "x", "s"), (2, None, "s"), (None, "a b c d e f g h", "s"), (3, "q r s t u v w z", None)]
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "q r s t u v w"), (2, "q r s t u v w")], "item_id bigint, text string")
    once = sorted((tuple(x) for x in decontaminate.contamination(table(spark, rows), bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 1)
    assert sorted((tuple(x) for x in decontaminate.contamination(table(spark, rows), bench).collect()), key=repr) == once
    assert [x[1] for x in once].count(True) == 3
    assert decontaminate.contamination(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(table(spark, rows).limit(0), bench).count() == 0


def mixed_rows():
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(1, 30)), "big" if i % 10 else f"small{i % 3}") for i in range(600)]
    return rows + [(9000, None, None), (9001, "", None), (None, "a b", "big"), (None, "a b", "big"), (None, None, "small1"), (17, "w w", "small2"), (18, "same id", "big")]


@pytest.mark.parametrize("mix", [{"repetition": 3.0}, {"entropy": 1.1}, {"entropy": 0.3}, {"entropy": 1.2, "repetition": 2.0}, {"entropy": 0.05, "repetition": 1.05}, {"budget": 1500}, {"entropy": 1.0, "budget": 40}, {"repetition": 0.5}, {"entropy": 9.0}])
def test_mixing_equals_a_plain_version(spark, mix):
    rows = mixed_rows()
    out = mixing.mix(odd(spark, table(spark, rows)).repartition(5), block_tokens=500, **mix).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, brute.mixing(rows, block_tokens=500, **mix)))


def test_mixing_meets_its_targets(spark, sf):
    """Entropy of the weights and of the result, repetition, and each block's shares."""
    from echofold.llm.entries import MAX_REPETITION, TARGET_ENTROPY

    def entropy(n):
        return -sum(x / sum(n) * math.log(x / sum(n)) for x in n)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    totals, tokens, _ = mixing.source_totals(mixing.token_counts(docs))
    natural = entropy([x["tokens"] for x in totals.collect()])
    a = mixing.exponent(totals, float(tokens), TARGET_ENTROPY, MAX_REPETITION)
    assert 0 < a < mixing.MOST and a != 1.0 and abs(natural - TARGET_ENTROPY) > 0.01
    plan = mixing.weights(totals, float(tokens), TARGET_ENTROPY, MAX_REPETITION).collect()
    assert abs(entropy([x["weight"] for x in plan]) - TARGET_ENTROPY) < 1e-3 and max(x["passes"] for x in plan) <= MAX_REPETITION
    out = mixing.mix(docs, TARGET_ENTROPY, MAX_REPETITION, block_tokens=20_000, carried=("text", "n_tokens"))
    assert out.columns == [*mixing.RESULT, "text"]
    out, text = out.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == text[r["doc_id"]] for r in out)
    taken, per_block = {}, {}
    for x in out:
        taken[x["source"]] = taken.get(x["source"], 0) + x["n_tokens"]
        per_block[x["block"]] = per_block.get(x["block"], 0) + x["n_tokens"]
    assert abs(entropy(list(taken.values())) - TARGET_ENTROPY) < 0.05  # whole documents: a little under the budget
    assert all(n > 0.4 * 20_000 for n in per_block.values()) and len(per_block) == -(-tokens // 20_000)


def test_mixing_of_nothing(spark):
    docs = table(spark, mixed_rows()).limit(0)
    assert mixing.mix(docs).count() == 0 and mixing.mix(docs, 1.0, 2.0, carried=("text",)).count() == 0


@pytest.mark.parametrize("target", [1.2, 1.35, 0.2, 0.01])
def test_mixing_meets_an_entropy(spark, target):
    tokens = {"a": 900, "b": 60, "c": 30, "d": 10}
    totals = spark.createDataFrame([(s, n, n / 900) for s, n in tokens.items()], "source string, tokens bigint, share double")
    a = mixing.exponent(totals, 1000.0, target, None)
    v = [(n / 900) ** a for n in tokens.values()]
    assert abs(-sum(x / sum(v) * math.log(x / sum(v)) for x in v) - target) < 1e-4
    assert mixing.exponent(totals, 1000.0, 2.0, None) == 0.0 and mixing.exponent(totals, 1000.0, -1.0, None) == mixing.MOST
    assert mixing.exponent(totals, 1000.0, None, None) == 1.0 and mixing.exponent(totals, 1000.0, None, 0.1) == 1.0


def labelled(n=240):
    r = random.Random(8)
    words = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        t = r.choices(words, k=r.randint(5, 150))
        toxic, junk = i % 3 == 0, i % 4 == 0
        if toxic:
            t[r.randrange(len(t))] = r.choice(["slur", "insult"])
        rows.append((i, " ".join(x.upper() + "!!" for x in t) if junk else " ".join(t), "s"))
        labels.append((i, int(not junk) + int(not junk and i % 2), int(toxic)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_toxicity(spark):
    rows, labels = labelled()
    docs, known = table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7777, 1, 1)], LABELS)
    net = toxicity.train(odd(spark, docs), known)
    out = toxicity.score(odd(spark, docs.unionByName(table(spark, [(-1, None, "s"), (-2, "", "s"), (None, "slur", "s")]))), net).collect()
    import zlib

    good = sum(r["predicted"] == labels[r["doc_id"]][2] for r in out if r["doc_id"] is not None and r["doc_id"] >= 0)
    assert good >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out) and len(out) == len(rows) + 3
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [True]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, net).collect()}
    assert kept == {r["doc_id"] for r in out if r["doc_id"] is not None and r["doc_id"] >= 0 and not r["predicted"]}
    assert toxicity.score(docs.limit(0), net).count() == 0
    untrained = toxicity.train(docs, known.limit(0))
    assert toxicity.score(docs, untrained).count() == len(rows)


def test_toxic_gradients():
    import numpy as np

    net, rng = toxicity.Network(3), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, at, mask, dy = rng.standard_normal((7, 16)), rng.integers(0, 7, (5, 3)), np.arange(5)[:, None] < np.array([5, 3, 4]), rng.standard_normal(3)
    y, kept = net.logits(x, at, mask, keep=True)
    g, dx = net.gradients(dy, x, at, mask, kept)
    for k in g:
        a, i = net.p[k], tuple(rng.integers(0, s) for s in net.p[k].shape)
        old = a[i]
        a[i] = old + 1e-2
        up = float((net.logits(x, at, mask) * dy).sum())
        a[i] = old - 1e-2
        down = float((net.logits(x, at, mask) * dy).sum())
        a[i] = old
        assert abs(float(g[k][i]) - (up - down) / 2e-2) < 1e-3


def test_toxic_windows_cover_texts():
    import numpy as np

    off = np.array([0, 0, 10, 74, 75, 400])
    start, size, text = toxicity.windows(off)
    for d in range(5):
        covered = {p for s, n, t in zip(start, size, text) if t == d for p in range(s, s + n)}
        assert covered == set(range(off[d], off[d + 1]))
    raw, at = utf8(pa.array(["Ab, cé-d", None, "x"]))
    index, off, *_ = toxicity.Reader()(raw, at)
    assert np.diff(off).tolist() == [3, 0, 1] and len(index) == 4


@pytest.mark.parametrize(("column", "least"), [("toxic", 0.9), ("quality", 0.95)])
def test_held_out_accuracy_on_the_tables(spark, column, least):
    """On labelled rows of the larger table that were not learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col(column).isNotNull())
    of = docs.join(held, "doc_id", "left_semi")
    if column == "toxic":
        out = toxicity.score(of, toxicity.train(docs, labels)).select("doc_id", F.col("predicted").alias("said"), "held_out")
    else:
        out = ordinal_quality.grade(of, ordinal_quality.train(docs, labels)).select("doc_id", F.col("kept").cast("int").alias("said"), F.lit(True).alias("held_out"))
    rows = out.join(held, "doc_id").select("said", column, "held_out").collect()
    right = {k: [r[0] == r[1] for r in rows if r[1] == k] for k in (0, 1)}
    assert len(rows) > 500 and all(r["held_out"] for r in rows)
    assert all(sum(x) >= least * len(x) for x in right.values()), {k: sum(x) / len(x) for k, x in right.items()}


def test_scores_equal_a_plain_network(spark):
    """The vectorised network against one word at a time, on whole texts of the table."""
    net, reader = toxicity.Network(5), toxicity.Reader()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").unionByName(table(spark, [(-1, None, "s"), (-2, "?!", "s"), (-3, "Ab " * 500, "s")]))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, net).collect():
        want = 1 / (1 + math.exp(-brute.toxic_logit(net, reader, text[r["doc_id"]])))
        assert abs(r["score"] - want) < 1e-4


def test_grades_equal_a_plain_regression(spark):
    """Features counted with dictionaries, probabilities by the formula."""
    docs, known = table(spark, labelled()[0]), spark.createDataFrame(labelled()[1], LABELS)
    model = ordinal_quality.train(docs, known)
    for r in ordinal_quality.grade(docs.where("doc_id < 40"), model).join(docs, "doc_id").collect():
        raw, x = r["text"].encode(), {}
        for i in range(len(raw) - 2):
            c = (raw[i] * 0x9E3779B1 ^ raw[i + 1] * 0x85EBCA6B ^ raw[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF
            c = ((c ^ c >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20
            x[c] = x.get(c, 0) + 1
        score = sum(model.w[c] * math.sqrt(n / (len(raw) - 2)) for c, n in x.items())
        words, letters = raw.split(), sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
        shares = (len(set(words)) / len(words), sum(65 <= b <= 90 for b in raw) / max(1, letters), sum(32 < b < 48 for b in raw) / len(raw), min(1, math.log2(len(words)) / 16))
        score += sum(model.w[ordinal_quality.TRIGRAMS + 10 * k + min(9, int(10 * s))] for k, s in enumerate(shares))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds()]
        assert abs(r["expected_grade"] - sum(above)) < 1e-3 and abs(r["tail_probability"] - above[-1]) < 1e-3


def test_samples_are_bounded(spark):
    from echofold.llm import labelled as sampling

    docs = table(spark, [(i, "x" * 100, "s") for i in range(200)] + [(500, "y" * 5000, "s")])
    known = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 2)], "doc_id bigint, g int")
    texts, grades, counts = sampling.sample(docs, known, "g", 30, 1000)
    assert {g: grades.count(g) for g in set(grades)} == {0: 10, 1: 10} | ({2: 1} if 2 in counts else {}) and len(texts) == len(grades)
    texts, grades, _ = sampling.sample(docs, known, "g", 30, 1 << 20)
    assert grades.count(0) == grades.count(1) == 30


def test_quality_grades(spark):
    rows, labels = labelled()
    docs, known = table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS)
    model = ordinal_quality.train(odd(spark, docs), known)
    assert model.grades == [0, 1, 2] and (model.thresholds()[1:] > model.thresholds()[:-1]).all()
    out = ordinal_quality.grade(odd(spark, docs.unionByName(table(spark, [(-1, None, "s"), (-2, "", "s")]))), model, least=1).collect()
    good = sum(r["kept"] == (labels[r["doc_id"]][1] >= 1) for r in out if r["doc_id"] >= 0)
    assert good >= 0.97 * len(rows) and all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in out)
    assert ordinal_quality.grade(docs, ordinal_quality.train(docs, known.limit(0))).where("kept").count() == len(rows)
    assert ordinal_quality.grade(docs.limit(0), model).count() == 0


def test_near_duplicates_of_a_hub(spark):
    """Near copies of one text that are below the threshold among themselves, more than all windows reach."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = [(5000, " ".join(base), "s")]
    for i in range(900):
        t = list(base)
        for j in r.sample(range(1, 199), 10):
            t[j] = f"x{i}_{j}"
        rows.append((i, " ".join(t), "s"))
    rows.append((6000, " ".join(t[:100]), "s"))
    got = {x["doc_id"]: x["component_id"] for x in minhash_forest.near_duplicates(table(spark, rows), 2).collect()}
    assert got == dict.fromkeys([*range(900), 5000], 0) | {6000: 6000}


def test_near_duplicates_with_few_common_minima(spark):
    """Of pairs at exactly 0.8, those whose signatures agree least are linked like the others."""
    import numpy as np

    texts = []
    for i in range(12000):
        same = " ".join(f"c{i}_{j}" for j in range(40))
        texts += [same + "".join(f" {side}{i}_{j}" for j in range(5)) for side in "lr"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sig = np.concatenate([minhash_forest._signatures(b) for b in minhash_forest._sign(1)([batch])])
    agree = ((sig[::2] ^ sig[1::2]) & np.uint64(15) == 0).sum(axis=1)
    worst = [2 * i + side for i in np.argsort(agree, kind="stable")[:40].tolist() for side in (0, 1)]
    got = minhash_forest.near_duplicates(table(spark, [(i, texts[i], "s") for i in worst]), 1).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: i - i % 2 for i in worst}


def planted(n, count, seed, damage):
    """How many of ``count`` texts with a damaged item of n words are found to hold it."""
    r, hasher, found = random.Random(seed), decontaminate.WordHasher(fold_case=True, space=decontaminate.word_breaks()), 0
    for _ in range(0, count, 50):
        items = [" ".join(f"i{r.randrange(10**9)}" for j in range(n)) for k in range(50)]
        texts = [" ".join(damage(r, item.split())) for item in items]
        text, item, _ = decontaminate.Items(list(enumerate(items)), 0.2).found(*hasher(*utf8(pa.array(texts))))
        found += sum(a == b for a, b in zip(text.tolist(), item.tolist()))
    return found


@pytest.mark.parametrize("n", [20, 40, 60, 100])
def test_items_cut_at_the_ends_of_a_document(n):
    e, tail = n // 5, [f"t{j}" for j in range(50)]
    assert planted(n, 300, 1, lambda r, w: w[e:] + tail) >= 299
    assert planted(n, 300, 2, lambda r, w: tail + w[:-e]) >= 299


@pytest.mark.parametrize("n", [30, 60, 100])
def test_items_at_the_largest_distance(n):
    """All edits spent on replaced words, at random places and at even distances."""
    replaced = lambda w, at: [f"x{j}" if j in at else v for j, v in enumerate(w)]
    assert planted(n, 1000, 3, lambda r, w: replaced(w, set(r.sample(range(n), n // 5)))) >= 997
    assert planted(n, 1000, 4, lambda r, w: replaced(w, set(range(0, n, 5)))) >= 997


def neighbours(runs, cut):
    """Pairs and pieces of regions that a window gives for runs of one first key, in batches of ``cut`` rows."""
    import numpy as np

    k0 = np.repeat(np.arange(len(runs)), runs).astype(np.int64)
    ids = np.arange(len(k0), dtype=np.int64)
    arrays = [pa.array(x) for x in (k0, ids, ids, *[np.zeros(len(k0), np.int64)] * len(minhash_forest.SKETCH))]
    rows = pa.RecordBatch.from_arrays(arrays, names=["k0", "id", "part", *minhash_forest.SKETCH])
    found = pa.Table.from_batches(minhash_forest._neighbours(minhash_forest.REACH, True)(iter([rows.slice(i, cut) for i in range(0, len(k0), cut)]))).to_pylist()
    return sorted((x["a"], x["b"]) for x in found if x["a"] is not None), {x["k0"]: x["n"] for x in found if x["k0"] is not None}


def test_a_crowd_that_is_not_linked_adds_few_pairs():
    """Where all pairs of a region are taken later on, the window names its nearest neighbours; smaller regions have all pairs."""
    reach, near = minhash_forest.REACH, minhash_forest.NEAREST
    runs = [1, 5, reach + 1, reach + 2, 400, 3]
    pairs, pieces = neighbours(runs, 10_000)
    assert all(neighbours(runs, cut) == (pairs, pieces) for cut in (1, 7, 60))
    assert len(pairs) == len(set(pairs))
    at = 0
    for k, n in enumerate(runs):
        of = {(a, b) for a, b in pairs if at <= a < at + n}
        whole = {(a, b) for a in range(at, at + n) for b in range(a + 1, at + n)}
        assert of == whole if n <= reach + 1 else pieces[k] == n and len(of) <= reach * (reach + 1) // 2 + near * (n - reach - 1)
        at += n
