"""Exact token counts at every prefix, by dynamic programming over the vocabulary.

For a merge vocabulary the encoding of a prefix is determined by its last token: token t may end
the prefix of length i iff (u, t) is a stable pair, where u is the last token of the prefix of
length i - |t|; a pair is stable if encoding u + t gives back u, t. So one pass over a string
yields, for every prefix, its last token and its number of tokens, and truncation or budget
questions need no further encoding.

Space runs can only be merged with what follows them, so a text falls into chunks (a run of spaces
and the non-spaces after it) that are encoded independently; chunk totals are kept in a cache of bounded
bytes. Counting keeps only the last few prefixes of a chunk. With ``with_prefixes`` the count at every
prefix, in characters, is stored beside the text; ``count_at`` and ``longest_fit`` answer truncation and
budget questions from it by lookups, in SQL, without any encoding.

Defined results: null and empty texts have no tokens; texts of any length are whole; repeated rows
give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import text_batches

CACHE_BYTES = 128 << 20  # of each of two caches, by the size of its strings
RUN = 4096
ENTRY_BYTES = 120  # what an entry takes beside them
SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, USER, BYTE = 1, 4, 6


class PrefixTokens:
    """Prefix tables of one sentencepiece BPE vocabulary (identity normaliser, dummy prefix)."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("needs a BPE model with the identity normaliser and a dummy prefix")
        if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
            raise ValueError("a piece has a space after a non-space; texts cannot be cut into chunks")
        if any(p.type == USER for p in model.pieces) or not any(p.type == BYTE for p in model.pieces):
            raise ValueError("needs a model with byte pieces and without user-defined ones")
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.longest = max(map(len, self.score))
        self.stable: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.totals: dict[str, int] = {}
        self.stable_bytes = self.totals_bytes = 0

    def encode(self, text: str) -> list[str]:
        """Plain merging of a short string: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _weight(self, token: str) -> int:
        if token in self.score:
            return 1
        return len(token.encode("utf-8"))

    def _pair(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            known = self.encode(left + right) == [left, right]
            self.stable_bytes += ENTRY_BYTES + sys.getsizeof(left) + sys.getsizeof(right)
            if self.stable_bytes > CACHE_BYTES:
                self.stable.clear()
                self.stable_bytes = 0
            self.stable[left, right] = known
        return known

    def _self(self, token: str) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.encode(token) == [token]
            if token in self.score:  # other characters may be many
                self.whole[token] = known
        return known

    def _extend(self, chunk: str, count: list[int], last: list[str], base: int, stop: int) -> None:
        """Appends the prefixes of up to ``stop`` characters to those from ``base`` on."""
        score, longest = self.score, self.longest
        for i in range(base + len(count), stop + 1):
            for size in range(1, min(longest, i) + 1):
                token = chunk[i - size : i]
                if size > 1 and token not in score:
                    continue
                j = i - size
                if self._pair(last[j - base], token) if j else self._self(token):
                    last.append(token)
                    count.append(count[j - base] + self._weight(token))
                    break
            else:
                raise AssertionError(f"no stable last token in {chunk[:i]!r}")

    def runs(self, chunk: str) -> Iterator[list[int]]:
        """Tokens of every prefix of a chunk but the empty one, RUN at a time; the last few are held."""
        count, last, base = [0], [""], 0
        for stop in range(min(RUN, len(chunk)), len(chunk) + RUN, RUN):
            done = len(count)
            self._extend(chunk, count, last, base, min(stop, len(chunk)))
            yield count[done:]
            past = max(0, len(count) - self.longest)
            base += past
            del count[:past], last[:past]
            if base + len(count) > len(chunk):
                return

    def table(self, chunk: str) -> list[int]:
        """Tokens of every prefix of a chunk, the empty one first."""
        return [0, *chain.from_iterable(self.runs(chunk))]

    def total(self, chunk: str) -> int:
        known = self.totals.get(chunk)
        if known is None:
            if len(chunk) <= RUN:
                count = [0]
                self._extend(chunk, count, [""], 0, len(chunk))
                known = count[-1]
            else:
                for run in self.runs(chunk):
                    known = run[-1]
            size = ENTRY_BYTES + 2 * len(chunk)
            if size < CACHE_BYTES >> 6:
                self.totals_bytes += size
                if self.totals_bytes > CACHE_BYTES:
                    self.totals.clear()
                    self.totals_bytes = size
                self.totals[chunk] = known
        return known

    def chunks(self, text: str) -> list[str]:
        return CHUNKS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str | None) -> int:
        known = self.totals
        return sum(known[c] if c in known else self.total(c) for c in self.chunks(text or ""))

    def prefixes(self, text: str | None) -> np.ndarray:
        """Token counts of every prefix of the text, the empty one first."""
        tables, total = [np.zeros(1, np.int32)], 0
        for c in self.chunks(text or ""):
            tables.append(np.fromiter(chain.from_iterable(self.runs(c)), np.int32, len(c)) + np.int32(total))
            total = int(tables[-1][-1])
        out = np.concatenate(tables)
        return np.concatenate([out[:1], out[2:]])  # the dummy space is before the text

    def count_at(self, text: str, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        if n_chars <= 0:
            return 0
        done, total = -1, 0  # the dummy space is before the text
        for c in self.chunks(text):
            if done + len(c) >= n_chars:
                return total + self.table(c)[n_chars - done]
            done, total = done + len(c), total + self.total(c)
        return total

    def fit(self, text: str, budget: int) -> int:
        """The longest prefix, in characters, all of whose shorter prefixes also fit ``budget`` tokens."""
        done, total = -1, 0
        for c in self.chunks(text):
            if total + self.total(c) > budget or any(total + x > budget for x in (self.table(c) if total + len(c.encode()) > budget else [])):
                table = self.table(c)
                over = next(i for i, x in enumerate(table) if total + x > budget)
                return max(0, done + over - 1)
            done, total = done + len(c), total + self.total(c)
        return len(text)


def count_at(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars characters (of all, where there are fewer)."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(prefix_tokens, F.least(F.greatest(n, F.lit(0)) + 1, F.size(prefix_tokens)))


def longest_fit(prefix_tokens: Column, budget: int) -> Column:
    """The longest prefix, in characters, all of whose shorter prefixes also fit ``budget`` tokens."""
    over = F.array_position(F.transform(prefix_tokens, lambda n: n > budget), True)
    return F.when(over > 0, F.greatest(over - 2, F.lit(0))).otherwise(F.size(prefix_tokens) - 1).cast("int")


def tokenizer(model_file: str) -> PrefixTokens:
    """One per Python worker, so chunk totals are kept from task to task."""
    held = sys.modules.setdefault("_echofold_worker", types.ModuleType("_echofold_worker"))
    kept = held.__dict__.setdefault("prefix_tokens", {})
    if model_file not in kept:
        kept[model_file] = PrefixTokens(model_file)
    return kept[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; with_prefixes adds prefix_tokens, the counts of every prefix in
    characters, the empty one first."""
    text_batches(docs.sparkSession)
    extra = [("prefix_tokens", pa.list_(pa.int32()))] if with_prefixes else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model_file)
        for batch in batches:
            texts = batch.column("text")
            n_bytes, n_tokens, tables = [], [], []
            for value in texts:
                text = value.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                if with_prefixes:
                    tables.append(tok.prefixes(text))
                n_tokens.append(int(tables[-1][-1]) if with_prefixes else tok.count(text))
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            if with_prefixes:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    extra_ddl = ", prefix_tokens array<int>" if with_prefixes else ""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean{extra_ddl}")
