"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= g | text) = sigmoid(threshold_g - w . x): one weight vector, ordered thresholds, for any number
of grades. x holds the square roots of the shares of hashed byte trigrams (so every text has length one)
and a few hashed marks of the text's form. The expected grade and the probability of reaching a grade come
from the same thresholds.

The fit takes a bounded sample to the driver: ``max_rows`` of each grade and ``max_bytes`` of their text,
those with the smallest hash of the id, weighted back to the grades' true counts (counted over all labelled rows).

Defined results: null and empty texts have no trigrams and get the thresholds' own grade; labels that are
null, and rows of labels without id, are not learned from; a document without id is graded like any other;
with fewer than two grades the grade is the
known one, or 0; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import text_batches
from .labelled import sample
from .words import WordHasher, chunks, trimmed, utf8

TRIGRAMS = 1 << 12
MARKS = 40
OUT = "doc_id bigint, expected_grade double, tail_probability double, kept boolean"


class Features:
    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of TRIGRAMS + MARKS features."""
        n = len(at) - 1
        x = np.zeros((n, TRIGRAMS + MARKS), dtype=np.float32)
        b = raw.astype(np.uint32)
        code = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) if len(b) > 2 else np.zeros(0, np.uint32)
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        words, off = self.hasher(raw, at)
        upper, lower, mark = (np.concatenate([[0], np.cumsum(k)]) for k in ((raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), (raw > 32) & (raw < 48)))
        for i, (a, z, p, q) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), off[:-1].tolist(), off[1:].tolist())):
            if z - a > 2:
                c = np.bincount(code[a : z - 2], minlength=TRIGRAMS)
                x[i, :TRIGRAMS] = np.sqrt(c / (z - a - 2))
            if q > p:
                fresh = len(np.unique(words[p:q])) / (q - p)
                letters = max(1, upper[z] - upper[a] + lower[z] - lower[a])
                shares = (fresh, (upper[z] - upper[a]) / letters, (mark[z] - mark[a]) / (z - a), min(1.0, np.log2(q - p) / 16))
                for k, share in enumerate(shares):
                    x[i, TRIGRAMS + 10 * k + min(9, int(10 * share))] = 1
        return x


class Regression:
    """Weights, and thresholds as a first one and positive steps."""

    def __init__(self, grades: list[int], size: int = TRIGRAMS + MARKS):
        self.grades = sorted(grades)
        self.w = np.zeros(size)
        k = max(0, len(self.grades) - 1)
        self.first, self.steps = 0.0, np.full(max(0, k - 1), 0.5)

    def thresholds(self) -> np.ndarray:
        if len(self.grades) < 2:
            return np.zeros(0)
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > g) for every grade but the last."""
        return 1 / (1 + np.exp(self.thresholds() - (x @ self.w)[:, None]))

    def expected(self, x: np.ndarray) -> np.ndarray:
        g = np.array(self.grades or [0], dtype=float)
        return g[0] + self.above(x) @ np.diff(g)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 2e-5) -> Regression:
        """Weighted maximum likelihood by Adam; y are places in ``grades``."""
        k = len(self.grades)
        if k < 2:
            return self
        weight = weight / weight.sum()
        p = [self.w, np.array([self.first]), self.steps]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        rows = np.arange(len(y))
        for step in range(1, rounds + 1):
            self.first = float(p[1][0])
            t = self.thresholds()
            score = (x @ self.w.astype(np.float32)).astype(np.float64)
            below = 1 / (1 + np.exp(np.clip(score[:, None] - t, -60, 60)))  # P(grade <= g)
            full = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], axis=1)
            slope = full * (1 - full)
            hi, lo = slope[rows, y + 1], slope[rows, y]
            like = np.maximum(full[rows, y + 1] - full[rows, y], 1e-12)
            dscore = -weight * (hi - lo) / like
            dt = np.zeros(k + 1)
            np.add.at(dt, y + 1, weight * hi / like)
            np.add.at(dt, y, -weight * lo / like)
            dt = dt[1:k]
            tail = np.cumsum(dt[::-1])[::-1]
            g = [x.T @ dscore.astype(np.float32) - decay * self.w, np.array([dt.sum()]), tail[1:] * np.exp(self.steps)]
            for a, d, mm, vv in zip(p, g, m, v):
                mm *= 0.9
                mm += 0.1 * d
                vv *= 0.999
                vv += 0.001 * d * d
                a += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-9)
        self.first = float(p[1][0])
        return self


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, grade: str = "quality", max_bytes: int = 64 << 20) -> Regression:
    """Learn from rows whose crc32(doc_id) mod 5 is not 0, at most ``max_rows`` and ``max_bytes`` of each grade."""
    texts, grades, counts = sample(docs, labels, grade, max_rows, max_bytes)
    model = Regression(list(counts))
    if not texts:
        return model
    y = np.array([model.grades.index(g) for g in grades])
    taken = np.bincount(y, minlength=len(model.grades))
    weight = np.array([counts[g] for g in model.grades])[y] / taken[y]
    features = Features()
    x = np.concatenate([features(*utf8(pa.array(texts[a : a + 64], pa.large_string()))) for a in range(0, len(texts), 64)])
    return model.fit(x, y, weight)


def grade(docs: DataFrame, model: Regression, least: int | None = None, floor: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability of reaching ``least`` (default: the top grade), kept."""
    text_batches(docs.sparkSession)
    grades = model.grades
    least = grades[-1] if least is None and grades else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for i, j in chunks(batch, "text"):
                for a in range(i, j, 512):
                    part = batch.slice(a, min(512, j - a))
                    x = features(*utf8(part.column("text")))
                    expected = model.expected(x)
                    over = [k for k, g in enumerate(grades[1:]) if g >= least] if len(grades) > 1 else []
                    tail = model.above(x)[:, over[0]] if over and least > grades[0] else np.full(len(x), float(bool(grades) and grades[-1] >= least))
                    if not grades:
                        tail = np.ones(len(x))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= floor)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(run), OUT)
