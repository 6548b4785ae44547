"""Exact repeated passages by seed and extend.

Seeds: winnowing picks, from every window of ``length`` consecutive words, the GRAM-word run with the
smallest hash (the rightmost of equals). Equal windows pick equal runs, so every repeat of ``length``
words or more shares a seed. Consecutive windows mostly pick the same run, so a text has one row for
each seed occurrence: the seed's hash, and the stretch of windows that picked it (a span).

Extend: occurrences are joined on the seed. Those whose whole span is equal (seed and span: 128 bits of
hash) match as far as the seed reaches to both sides, which settles them at once. Where spans with the same
seed differ (the ends of a repeat), each occurrence is extended word by word, to the left and to the right
of the seed, along the occurrence in the smallest id, the lead; no window outside the lead's span can equal
one of its windows. What the extension covers is settled. Windows that leave the lead before they end can
still have others like them: for seeds where two documents have such windows, they are compared in groups,
by 128 bits of hash of their words, against the smallest id of the group.

Maximal repeats: settled windows of a document, of whatever seed, that overlap or touch are one passage, the
longest run of words all covered by windows that start in a smaller id; each is at least ``length`` words.

Only seeds that occur in two documents go on to the extension, only documents with such seeds are read
again, and hot seeds are handled by grouped minima and joins with one lead, never by pairs of occurrences.

Defined results: null texts have no words; texts shorter than a window lose nothing; a row without id is
kept whole and removes nothing elsewhere; rows with the same id are judged each on its own text against
smaller ids; windows are judged on the input; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import release, stored, text_batches
from .words import WordHasher, chunks, gram_hashes, mix, powers, trimmed, utf8

GRAM = 12
SPANS = "seed bigint, span bigint, doc_id bigint, row_key bigint, first int, n int, skip int, digest binary"
CONTEXTS = "seed bigint, low bigint, doc_id bigint, row_key bigint, first int, n int, skip int, before array<string>, after array<string>"
NO_CUTS = "cast(array() as array<struct<first:int,n:int>>)"


def window_picks(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each run of ``reach`` grams the place of its smallest, the rightmost of equals."""
    n = len(grams) - reach + 1
    place = np.arange(len(grams))
    size = 1
    while size * 2 <= reach:
        left, right = place[:-size], place[size:]
        place = np.where(grams[right] <= grams[left], right, left)
        size *= 2
    left, right = place[:n], place[reach - size : reach - size + n]
    return np.where(grams[right] <= grams[left], right, left)


def _seeds(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for i, j in chunks(batch, "text"):
                part = batch.slice(i, j - i)
                raw, at = utf8(part.column("text"))
                words, off = hasher(raw, at)
                ids, keys = part.column("doc_id"), part.column("row_key").to_numpy()
                digests = []
                data = raw.tobytes()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    digests.append(hashlib.sha256(b" ".join(data[a:b].split())).digest())
                n_docs = j - i
                none = pa.nulls(n_docs, pa.int64())
                yield _rows(none, none, ids, keys, np.zeros(n_docs), np.diff(off), np.zeros(n_docs), pa.array(digests, pa.binary()))
                if len(words) < length:
                    continue
                doc = np.repeat(np.arange(n_docs), np.diff(off))
                grams = gram_hashes(words, GRAM)
                pick = window_picks(grams, length - GRAM + 1)
                n = len(pick)
                whole = doc[:n] == doc[length - 1 : length - 1 + n]
                whole &= ids.is_valid().to_numpy(zero_copy_only=False)[doc[:n]]
                new = np.ones(n, dtype=bool)
                new[1:] = (pick[1:] != pick[:-1]) | (doc[1:n] != doc[: n - 1])
                start = np.flatnonzero(new & whole)
                if not len(start):
                    continue
                run_of = np.cumsum(new) - 1
                count = np.bincount(run_of[whole], minlength=run_of[-1] + 1)[run_of[start]]
                up, down = powers(0x8CB92BA72F3D8DD7, len(words))
                sums = np.zeros(len(words) + 1, dtype=np.uint64)
                np.cumsum(words * up, out=sums[1:])
                span = (sums[start + count + length - 1] - sums[start]) * down[start]
                span = mix(span + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (pick[start] - start).astype(np.uint64))
                d = doc[start]
                yield _rows(pa.array(grams[pick[start]].view(np.int64)), pa.array(span.view(np.int64)), ids.take(pa.array(d)), keys[d], start - off[d], count, pick[start] - start, pa.nulls(len(d), pa.binary()))

    return run


def _rows(seed, span, ids, keys, first, n, skip, digest) -> pa.RecordBatch:
    ints = (pa.array(np.asarray(x).astype(np.int32)) for x in (first, n, skip))
    return pa.RecordBatch.from_arrays([seed, span, ids, pa.array(keys), *ints, digest], names=["seed", "span", "doc_id", "row_key", "first", "n", "skip", "digest"])


def _ranges(start: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """start, start + step, ... of each size, one after the other."""
    return np.repeat(start, size) + step * (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


def _contexts(length: int):
    """The words of open spans on both sides of their seeds, those before it from the seed outwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch, "text", 1 << 20):
                part = batch.slice(i, j - i)
                texts = [(t.as_py() or "").encode("utf-8").split() for t in part.column("text")]
                words = pa.array([w for t in texts for w in t], pa.binary())
                off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                spans = part.column("open")
                doc = np.repeat(np.arange(j - i), spans.value_lengths().to_numpy())
                flat = spans.flatten()
                first, n, skip = (flat.field(k).to_numpy().astype(np.int64) for k in ("first", "n", "skip"))
                seed = off[doc] + first + skip
                size = {"before": skip, "after": n + length - 1 - skip - GRAM}
                at = {"before": _ranges(seed - 1, size["before"], -1), "after": _ranges(seed + GRAM, size["after"], 1)}
                sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[k])]), pa.int32()), words.take(pa.array(at[k])).cast(pa.string())) for k in ("before", "after")]
                own = [part.column(c).take(pa.array(doc)) for c in ("doc_id", "row_key")]
                yield pa.RecordBatch.from_arrays([flat.field("seed"), flat.field("low"), *own, *(flat.field(k) for k in ("first", "n", "skip")), *sides], names=[c.split()[0] for c in CONTEXTS.split(", ")])

    return run


def _common(left: str, right: str) -> Column:
    """How many words two arrays have in common from their starts on."""
    apart = F.array_position(F.zip_with(left, right, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(apart > 0, apart - 1).otherwise(F.size(left)).cast("int")


def _covered(n: int, cuts: list[dict], length: int) -> np.ndarray:
    """Which of n words lie in a settled window."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for c in cuts:
        edge[c["first"]] += 1
        edge[c["first"] + c["n"] + length - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_gone, kept_texts, digests = [], [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("cuts")):
                words = (text.as_py() or "").encode("utf-8").split()
                gone = _covered(len(words), cuts.as_py() or [], length)
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                n_words.append(len(words))
                n_gone.append(int(gone.sum()))
                kept_texts.append(kept.decode("utf-8"))
                digests.append(hashlib.sha256(kept).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(digests, pa.binary())],
                names=["doc_id", "row_key", "n_words", "n_removed", "kept_text", "digest"],
            )

    return run


class Repeats:
    """Cuts of every document with a repeat, and the digests of all whole texts.

    row_key, a hash of the text, tells rows with the same id apart.
    """

    def __init__(self, docs: DataFrame, length: int = 50):
        self.length = length
        text_batches(docs.sparkSession)
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
        self.seen = stored(self.docs.mapInArrow(trimmed(_seeds(length)), SPANS), "spans")
        spans = self.seen.where("seed is not null").drop("digest")

        # Join on seeds, of those only that occur in two documents.
        seeds = stored(spans.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed"), "seeds")
        shared = stored(spans.join(seeds.hint("merge"), "seed", "left_semi"), "shared")

        # Whole spans that are equal.
        leads = stored(shared.groupBy("seed", "span").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last"), "leads")
        tagged = stored(shared.join(leads.hint("merge"), ["seed", "span"], "left").withColumn("settled", F.coalesce(F.col("doc_id") > F.col("lead"), F.lit(False))).drop("lead", "span"), "tagged")
        settled = tagged.where("settled").select("doc_id", "row_key", "first", "n")

        # Spans that differ under the same seed are open; they are read again with their words.
        mixed = stored(tagged.where("not settled").groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "mixed")
        unsettled = tagged.where("not settled").join(mixed.hint("merge"), "seed").withColumn("is_open", F.lit(True))
        every = settled.selectExpr("cast(null as bigint) seed", "cast(null as bigint) low", "doc_id", "row_key", "first", "n", "0 skip", "false is_open").unionByName(unsettled.select("seed", "low", "doc_id", "row_key", "first", "n", "skip", "is_open"))
        per_doc = every.groupBy("doc_id", "row_key").agg(
            F.collect_list(F.when(F.col("is_open"), F.struct("seed", "low", "first", "n", "skip"))).alias("open"),
            F.collect_list(F.when(~F.col("is_open"), F.struct("first", "n"))).alias("cuts"),
        )
        self.touched = stored(self.docs.join(per_doc.hint("merge"), ["doc_id", "row_key"]), "touched")
        contexts = stored(self.touched.where("size(open) > 0").select("doc_id", "row_key", "text", "open").mapInArrow(trimmed(_contexts(length)), CONTEXTS), "contexts")

        # Extension to both sides along the lead: windows ``lo`` .. ``hi`` of the span lie in the match.
        lead = contexts.where("doc_id = low").groupBy("seed").agg(F.min_by(F.struct("before", "after"), F.struct("first", "row_key")).alias("lead"))
        lead = stored(lead.select("seed", F.col("lead.before").alias("lead_before"), F.col("lead.after").alias("lead_after")), "lead")
        extended = contexts.join(lead.hint("merge"), "seed")
        start = F.col("first") + F.col("skip")
        extended = extended.withColumn("lo", F.greatest(F.col("first"), start - _common("before", "lead_before")))
        extended = extended.withColumn("hi", F.least(F.col("first") + F.col("n") - 1, start + GRAM + _common("after", "lead_after") - length))
        extended = extended.withColumn("hi", F.greatest("hi", F.col("lo") - 1)).drop("lead_before", "lead_after")
        whole = (F.col("lo") == F.col("first")) & (F.col("hi") == F.col("first") + F.col("n") - 1)
        extended = extended.withColumns({c: F.when(~whole, F.col(c)) for c in ("before", "after")})
        extended = stored(extended, "extended")
        matched = extended.where("doc_id > low and hi >= lo").select("doc_id", "row_key", F.col("lo").alias("first"), (F.col("hi") - F.col("lo") + 1).alias("n"))

        # The other windows, in groups.
        rest = extended.where("before is not null")
        hot = stored(rest.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed"), "hot")
        steps = F.expr("filter(sequence(0, n - 1), i -> first + i < lo or first + i > hi)")
        rest = rest.join(hot.hint("merge"), "seed", "left_semi").select("seed", "doc_id", "row_key", "first", "skip", F.col("before"), F.col("after"), F.explode(steps).alias("step"))
        before = F.reverse(F.slice("before", 1, F.greatest(F.col("skip") - F.col("step"), F.lit(0))))
        after = F.slice("after", 1, F.greatest(F.col("step") + length - GRAM - F.col("skip"), F.lit(0)))
        text = F.concat_ws(" ", before, F.lit("\0"), after)
        windows = stored(rest.select("seed", F.unhex(F.md5(text)).alias("window"), "doc_id", "row_key", (F.col("first") + F.col("step")).alias("first")), "windows")
        least = stored(windows.groupBy("seed", "window").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last"), "least")
        grouped = windows.join(least.hint("merge"), ["seed", "window"]).where("doc_id > lead").select("doc_id", "row_key", "first", F.lit(1).alias("n"))
        self.more = stored(matched.unionByName(grouped).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "n")).alias("more")), "more")
        release(seeds, shared, leads, tagged, mixed, contexts, lead, extended, hot, windows, least)

    def cuts(self) -> DataFrame:
        """doc_id, row_key, text, cuts (first window and number of windows, unordered) of documents with a repeat."""
        rows = self.touched.select("doc_id", "row_key", "text", "cuts").join(self.more.hint("merge"), ["doc_id", "row_key"], "left")
        return rows.select("doc_id", "row_key", "text", F.concat("cuts", F.coalesce("more", F.expr(NO_CUTS))).alias("cuts")).where("size(cuts) > 0")

    def cut_texts(self) -> DataFrame:
        """doc_id, row_key, n_words, n_removed, kept_text, digest of the documents that lose words."""
        return self.cuts().mapInArrow(trimmed(_cut(self.length)), "doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, kept_text string, digest binary")

    def untouched(self) -> DataFrame:
        """The digests of all other documents' words."""
        cut = self.touched.select("doc_id", "row_key", F.size("cuts").alias("c")).join(self.more.select("doc_id", "row_key", F.lit(1).alias("m")).hint("merge"), ["doc_id", "row_key"], "left")
        cut = cut.where("c > 0 or m = 1").select("doc_id", "row_key")
        return self.seen.where("seed is null").select("doc_id", "row_key", F.col("n").cast("bigint").alias("n_words"), "digest").join(cut.hint("merge"), ["doc_id", "row_key"], "left_anti")


def repeat_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    found = Repeats(docs, length)
    columns = ("doc_id", "n_words", "n_removed", F.lower(F.hex("digest")).alias("kept_sha256"))
    rest = found.untouched().withColumn("n_removed", F.lit(0).cast("bigint"))
    return found.cut_texts().select(*columns).unionByName(rest.select(*columns))


def maximal_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, first (its first word, from 0), n_words, text of every maximal repeated passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cuts"))):
                words = text.encode("utf-8").split()
                edge = np.flatnonzero(np.diff(_covered(len(words), cuts, length).astype(np.int8), prepend=0, append=0))
                rows += [(doc_id, a, b - a, b" ".join(words[a:b]).decode("utf-8")) for a, b in edge.reshape(-1, 2).tolist()]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "first", "n_words", "text"])

    return Repeats(docs, length).cuts().mapInArrow(trimmed(run), "doc_id bigint, first bigint, n_words bigint, text string")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents with repeated passages taken out; texts without repeats stay as they are."""
    found = Repeats(docs, length)
    cut = found.cut_texts().select(F.col("doc_id").alias("_echofold_id"), F.col("row_key").alias("_echofold_key"), F.col("kept_text").alias("_echofold_text"))
    cut = cut.dropDuplicates(["_echofold_id", "_echofold_key"])  # of equal rows
    joined = docs.join(cut.hint("merge"), (F.col("doc_id").cast("bigint") == F.col("_echofold_id")) & (F.xxhash64("text") == F.col("_echofold_key")), "left")
    return joined.select(*[F.coalesce("_echofold_text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
