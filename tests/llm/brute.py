"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import itertools
import math
import re
import string

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, size, fold=True):
    w = WORD.findall((text or "").translate(FOLD) if fold else text or "")
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, size=2, percent=80):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text) with distinct ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    common = {}
    for ds in index.values():
        for p in itertools.combinations(sorted(ds), 2):
            common[p] = common.get(p, 0) + 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return sorted((d, len(s), comp[d], comp[d] == d) for d, s in sets.items())


def covered(rows, window=50):
    """{doc_id: (words, which of them a window covers that starts in a smaller id)} of rows (doc_id, text)."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (w, gone)
    return out


def substring_dedup(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text) with distinct ids."""
    out = []
    for d, (w, gone) in covered(rows, window).items():
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def maximal_repeats(rows, window=50):
    """(doc_id, first, n_words, text) of the longest runs of covered words."""
    out = []
    for d, (w, gone) in covered(rows, window).items():
        at = 0
        for g, run in itertools.groupby(gone):
            n = len(list(run))
            if g:
                out.append((d, at, n, " ".join(w[at : at + n])))
            at += n
    return sorted(out)


def _bisected(low, high, before):
    """Where ``before`` stops being true on [low, high]."""
    if not before(low):
        return low
    if before(high):
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if before(mid) else (low, mid)
    return high


def mixing_weights(tokens, budget, entropy=None, repetition=None, most=64.0):
    """(exponent, {source: weight}) of {source: tokens}."""
    largest = max(tokens.values())

    def at(a):
        v = {s: (n / largest) ** a for s, n in tokens.items()}
        z = sum(v.values())
        return {s: x / z for s, x in v.items()}

    def h(a):
        return -sum(p * math.log(p) for p in at(a).values() if p > 0)

    def r(a):
        return max(p * budget / tokens[s] for s, p in at(a).items())

    a, limit = 1.0, math.inf if repetition is None else repetition * (1 + 1e-9)
    if entropy is not None:
        a = _bisected(0.0, most, lambda x: h(x) > entropy)
    if r(a) > limit or entropy is None and repetition is not None:
        a = _bisected(0.0, 1.0, lambda x: r(x) > limit) if a < 1 or entropy is None else _bisected(1.0, most, lambda x: r(x) <= limit)
    return a, at(round(a, 6))


def mixing(rows, entropy=None, repetition=None, budget=None, block_tokens=1 << 20):
    """(doc_id, source, n_tokens, pass_no, block, place) of rows (doc_id, text, source)."""

    def spot(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:10], 16)

    docs = []
    for d, t, s in rows:
        key = 0
        if d is None:
            key = xxhash.xxh64((t or "").encode(), seed=42).intdigest() if t is not None else 42
            key -= (key >> 63) << 64
        docs.append((d, s, key, max(1, len(WORD.findall(t or "")))))
    tokens = {}
    for _, s, _, n in docs:
        tokens[s] = tokens.get(s, 0) + n
    if not tokens:
        return []
    budget = sum(tokens.values()) if budget is None else budget
    share = mixing_weights(tokens, budget, entropy, repetition)[1]
    out, n_blocks = [], max(1, -(-budget // block_tokens))
    for s, total in tokens.items():
        target = round(share[s] * budget)
        for p in range(target // total + 1):
            room, spent = (total if p < target // total else target % total), 0
            mine = sorted((spot("mix", p, "" if d is None else d, k), -(1 << 63) if d is None else d, k, n, d) for d, x, k, n in docs if x == s)
            for (at, _, k), same in itertools.groupby(mine, key=lambda x: x[:3]):
                same = list(same)
                spent += sum(x[3] for x in same)
                if spent > room:
                    break
                block = min(n_blocks - 1, int((p + at / (1 << 40)) / (target / total) * n_blocks))
                out += [(d, s, n, p, block, spot("mix", f"b{p}", "" if d is None else d, k)) for *_, n, d in same]
    return out


def toxic_logit(net, reader, text):
    """The largest logit of a text's windows, word by word; ``reader`` gives the features of single words."""
    import numpy as np
    import pyarrow as pa

    from echofold.llm.toxicity import HIDDEN, SPAN, STRIDE
    from echofold.llm.words import utf8

    p = net.p
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    x = []
    for w in words:
        _, _, bucket, grams, _ = reader(*utf8(pa.array([w.decode()])))
        x.append(np.concatenate([p["word"][bucket[0]], p["gram"][grams].mean(axis=0)]))
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(seq, side):
        h, out = np.zeros(HIDDEN), []
        for v in seq:
            g, u = v @ p[f"x_{side}"] + p[f"b_{side}"], h @ p[f"h_{side}"]
            z, r = sig(g[:HIDDEN] + u[:HIDDEN]), sig(g[HIDDEN : 2 * HIDDEN] + u[HIDDEN : 2 * HIDDEN])
            c = np.tanh(g[2 * HIDDEN :] + r * u[2 * HIDDEN :])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    best, at = None, 0
    while x and (at == 0 or at + SPAN - STRIDE < len(x)):
        w = x[at : at + SPAN]
        both = [np.concatenate(s) for s in zip(states(w, "fore"), states(w[::-1], "back")[::-1])]
        e = np.array([s @ p["attend"] for s in both])
        a = np.exp(e - e.max())
        y = float((a / a.sum()) @ np.array([s @ p["out"] for s in both]) + p["bias"][0])
        best, at = y if best is None else max(best, y), at + STRIDE
    return float(p["bias"][0]) if best is None else best


def distance(item, words):
    """Least word edits between the item and any stretch of words."""
    d = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(d[j - 1] + (x != y), d[j] + 1, new[-1] + 1))
        d = new
    return min(d)
