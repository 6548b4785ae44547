"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a hashed word embedding and the mean of hashed character-gram embeddings. A text
is read as overlapping windows of SPAN words, STRIDE apart, that cover it wholly; a window's states of
both directions are pooled by attention into one logit. A text's logit is the largest of its windows'.

Training takes a bounded sample of labelled rows (``max_rows`` and ``max_bytes`` of text of each label,
chosen by a hash of the id) to the driver, with all windows of their whole texts: first every window carries its text's label,
then only the window with the largest logit stands for its text. The network is a few hundred kB.

Words are runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased. Defined results: a null or
empty text, or one without words, gets the logit of an empty window; labels other than 0 and 1, and
rows of labels without id, are not learned from; a document without id is scored like any other and counts
as held out, as no label can name it; without labelled rows of both kinds all scores are the untrained
network's; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import text_batches
from .labelled import sample
from .words import WordHasher, chunks, mix, trimmed, utf8

SPAN, STRIDE = 64, 48
HIDDEN, DIM = 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
GRAMS = (3, 5, 8)
BATCH = 2048
SLICE = 1 << 14  # words whose grams are looked up at once


def word_breaks() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = False
    t[128:] = False
    return t


class Reader:
    """Texts to word indices, with hashed features of the distinct words."""

    def __init__(self):
        self.hasher = WordHasher(fold_case=True, space=word_breaks())
        self.breaks = word_breaks()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def __call__(self, raw: np.ndarray, at: np.ndarray):
        """(word index of each word, offsets of texts, word buckets, gram buckets, gram offsets)."""
        hashes, off, starts = self.hasher.located(raw, at)
        distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        if not len(distinct):
            return index, off, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        starts = starts[first]
        bound = at[np.searchsorted(at, starts, side="right")]
        ends = np.minimum(self._ends(raw, starts), bound)
        grams = np.concatenate([self._grams(raw, starts[a : a + SLICE], ends[a : a + SLICE]) for a in range(0, len(starts), SLICE)])
        sizes = (ends - starts) * len(GRAMS)
        return index, off, (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64), grams, np.concatenate([[0], np.cumsum(sizes)])

    def _ends(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        stops = np.append(np.flatnonzero(self.breaks[raw]), len(raw))
        return stops[np.searchsorted(stops, starts)]

    def _grams(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Buckets of the grams of each word, those of one place side by side."""
        sizes = ends - starts
        total = int(sizes.sum())
        word = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[word]
        low, high = starts[word], ends[word]
        out = np.empty((total, len(GRAMS)), dtype=np.int32)
        for g, n in enumerate(GRAMS):
            h = np.full(total, n, dtype=np.uint64)
            for d in range(-1, n - 1):
                p = place + d
                byte = self.lower[raw[np.clip(p, 0, len(raw) - 1)]].astype(np.uint64)
                byte[p < low], byte[p >= high] = 1, 2
                h = h * np.uint64(0x100000001B3) + byte
            out[:, g] = (mix(h) % np.uint64(GRAM_BUCKETS)).astype(np.int32)
        return out.reshape(-1)


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of the overlapping windows of all texts."""
    n = np.diff(off)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - SPAN) // STRIDE)))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = off[text] + k * STRIDE
    return start, np.minimum(SPAN, off[text + 1] - start), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters are float32 arrays in ``p``; forward keeps what backward needs if asked."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, DIM

        def init(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": init(WORD_BUCKETS, d, scale=0.02), "gram": init(GRAM_BUCKETS, d, scale=0.05),
            "x_fore": init(2 * d, 3 * h, scale=0.4), "x_back": init(2 * d, 3 * h, scale=0.4),
            "h_fore": init(h, 3 * h, scale=0.3), "h_back": init(h, 3 * h, scale=0.3),
            "b_fore": np.zeros(3 * h, np.float32), "b_back": np.zeros(3 * h, np.float32),
            "attend": init(2 * h, scale=0.3), "out": init(2 * h, scale=0.3), "bias": np.full(1, -1.0, np.float32),
        }

    def inputs(self, words: np.ndarray, grams: np.ndarray, gram_off: np.ndarray) -> np.ndarray:
        x = np.empty((len(words), 2 * DIM), dtype=np.float32)
        x[:, :DIM] = self.p["word"][words]
        for a in range(0, len(words), SLICE):
            off = gram_off[a : a + SLICE + 1]
            x[a : a + SLICE, DIM:] = np.add.reduceat(self.p["gram"][grams[off[0] : off[-1]]], off[:-1] - off[0], axis=0) / np.diff(off)[:, None]
        return x

    def _run(self, proj: np.ndarray, at: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
        steps, n = at.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states, saved = np.empty((steps, n, HIDDEN), np.float32), []
        full = mask.all(axis=1)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g, hu = proj[at[t]], h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                saved.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = new
            states[t] = h
        return states, saved

    def logits(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        fore, s1 = self._run(x @ p["x_fore"] + p["b_fore"], at, mask, p["h_fore"], False, keep)
        back, s2 = self._run(x @ p["x_back"] + p["b_back"], at, mask, p["h_back"], True, keep)
        e = fore @ p["attend"][:HIDDEN] + back @ p["attend"][HIDDEN:]
        e = np.where(mask, e, np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        o = fore @ p["out"][:HIDDEN] + back @ p["out"][HIDDEN:]
        y = (w * o).sum(axis=0) + p["bias"][0]
        return (y, (fore, back, s1, s2, w, o)) if keep else y

    def gradients(self, dy: np.ndarray, x: np.ndarray, at: np.ndarray, mask: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of sum(dy * y) for the parameters and the word inputs."""
        p, (fore, back, s1, s2, w, o) = self.p, kept
        dwo = w * dy
        de = dwo * (o - (w * o).sum(axis=0))
        g = {"bias": dy.sum(keepdims=True).astype(np.float32)}
        dx = np.zeros_like(x)
        parts = {"out": [], "attend": []}
        for states, saved, side, lo in ((fore, s1, "fore", 0), (back, s2, "back", HIDDEN)):
            parts["out"].append((states * dwo[:, :, None]).sum(axis=(0, 1)))
            parts["attend"].append((states * de[:, :, None]).sum(axis=(0, 1)))
            dstates = dwo[:, :, None] * p["out"][lo : lo + HIDDEN] + de[:, :, None] * p["attend"][lo : lo + HIDDEN]
            u = p[f"h_{side}"]
            du, dproj = np.zeros_like(u), np.zeros((*at.shape, 3 * HIDDEN), np.float32)
            dh = np.zeros((at.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c, hn in reversed(saved):
                dh = dh + dstates[t]
                m = mask[t][:, None]
                dnew = np.where(m, dh, 0)
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1)
                dhu = np.concatenate([dz, dr, dc * r], axis=1)
                dproj[t] = dg
                du += h.T @ dhu
                dh = np.where(m, 0, dh) + dnew * z + dhu @ u.T
            flat = at.reshape(-1)
            dproj = dproj.reshape(-1, 3 * HIDDEN)
            dword = np.stack([np.bincount(flat, weights=dproj[:, k], minlength=len(x)) for k in range(3 * HIDDEN)], axis=1).astype(np.float32)
            g[f"h_{side}"], g[f"b_{side}"], g[f"x_{side}"] = du, dproj.sum(axis=0), x.T @ dword
            dx += dword @ p[f"x_{side}"].T
        g["out"], g["attend"] = np.concatenate(parts["out"]), np.concatenate(parts["attend"])
        return g, dx


def _windowed(start: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(size.max())
    at = start + np.arange(steps)[:, None]
    mask = np.arange(steps)[:, None] < size
    return index[np.minimum(at, len(index) - 1)], mask


def text_logits(net: Network, raw: np.ndarray, at: np.ndarray, reader: Reader) -> np.ndarray:
    """The logit of every text."""
    index, off, words, grams, gram_off = reader(raw, at)
    out = np.full(len(at) - 1, -np.inf)
    start, size, text = windows(off)
    x = net.inputs(words, grams, gram_off)
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), BATCH):
        part = order[a : a + BATCH]
        y = net.logits(x, *_windowed(start[part], size[part], index))
        np.maximum.at(out, text[part], y)
    out[np.isneginf(out)] = net.p["bias"][0]
    return out


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        """Gradients are dense arrays, or (rows, values) of an embedding; those rows alone move then."""
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, d in g.items():
            at = slice(None)
            if isinstance(d, tuple):
                at, d = d
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * d * d
            self.p[k][at] -= np.float32(self.rate * fix) * m / (np.sqrt(v) + 1e-8)


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(rows, return_inverse=True)
    return distinct, np.stack([np.bincount(at, weights=values[:, k], minlength=len(distinct)) for k in range(values.shape[1])], axis=1).astype(np.float32)


def fit(texts: list[str], labels: list[int], epochs: int = 6, seed: int = 7, steps: int = 700, rate: float = 0.01) -> Network:
    """Train on whole texts, for ``epochs`` at least and about ``steps`` steps where texts are few.

    The last third of the epochs learns from each text's strongest window alone (of texts labelled 0, from all).
    """
    net, reader = Network(seed), Reader()
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return net
    raw, at = utf8(pa.array(texts, pa.large_string()))
    index, off, words, grams, gram_off = reader(raw, at)
    start, size, text = windows(off)
    if not len(start):
        return net
    batch = 256 if len(start) > 16_384 else 64
    epochs = max(epochs, min(80, -(-steps * batch // len(start))))
    late = epochs - max(2, epochs // 3)
    # Texts count alike, whatever their length, and so do the two labels together.
    weight = (1 / np.bincount(text, minlength=len(y)).clip(1))[text] ** 0.5
    adam, rng = Adam(net.p, rate), np.random.default_rng(seed)
    for epoch in range(epochs):
        chosen = np.arange(len(start))
        if epoch >= late:
            x = net.inputs(words, grams, gram_off)
            top = np.concatenate([net.logits(x, *_windowed(start[i : i + BATCH], size[i : i + BATCH], index)) for i in range(0, len(start), BATCH)])
            order = np.lexsort((-top, text))
            best = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            chosen = np.union1d(best, chosen[y[text] == 0])
        perm = rng.permutation(chosen)
        for i in range(0, len(perm), batch):
            part = perm[i : i + batch]
            ids, mask = _windowed(start[part], size[part], index)
            used, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(mask.shape)
            sizes = gram_off[used + 1] - gram_off[used]
            g_at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(gram_off[used], sizes)
            x = net.inputs(words[used], grams[g_at], np.concatenate([[0], np.cumsum(sizes)]))
            drop = rng.random(len(used)) < 0.3  # then the characters alone must do
            x[drop, :DIM] = 0
            logit, kept = net.logits(x, ids, mask, keep=True)
            w = weight[part] if epoch < late else np.ones(len(part))
            dy = ((sigmoid(logit) - y[text[part]]) * w / w.sum()).astype(np.float32)
            g, dx = net.gradients(dy, x, ids, mask, kept)
            dx[drop, :DIM] = 0
            g["word"] = _row_sums(words[used], dx[:, :DIM])
            g["gram"] = _row_sums(grams[g_at], np.repeat(dx[:, DIM:] / sizes[:, None], sizes, axis=0))
            norm = np.sqrt(sum(float((v[1] if isinstance(v, tuple) else v).astype(np.float64).ravel() @ (v[1] if isinstance(v, tuple) else v).astype(np.float64).ravel()) for v in g.values()))
            if norm > 1:
                g = {k: (v[0], v[1] / norm) if isinstance(v, tuple) else v / norm for k, v in g.items()}
            adam.step(g)
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, max_bytes: int = 64 << 20) -> Network:
    """Learn from at most ``max_rows`` documents, and ``max_bytes`` of text, of each label."""
    texts, marks, counts = sample(docs, labels.where("toxic in (0, 1)"), "toxic", max_rows, max_bytes)
    net = fit(texts, marks)
    if 0 < sum(marks) < len(marks):  # from the sample's odds to those of all labelled rows
        net.p["bias"] += np.float32(np.log(counts[1] / counts[0]) - np.log(sum(marks) / (len(marks) - sum(marks))))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for i, j in chunks(batch, "text", 2 << 20):
                part = batch.slice(i, j - i)
                s = sigmoid(text_logits(net, *utf8(part.column("text")), reader))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The documents, all columns, whose score is under one half; one pass, no shuffle."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for i, j in chunks(batch, "text", 2 << 20):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(text_logits(net, *utf8(part.column("text")), reader) < 0))

    return docs.mapInArrow(trimmed(run), docs.schema)
