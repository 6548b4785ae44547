import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm import words as W


def hashed(texts, block=None):
    raw, at = W.utf8(pa.array(texts, pa.string()))
    h, off = W.WordHasher()(raw, at)
    return [h[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\xa0aAbé😀\x00", max_size=20), max_size=6))
def test_words_and_equality(texts):
    got = hashed(texts)
    want = [brute.WORD.findall(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    by_hash = {}
    for g, w in zip(got, want):
        for h, x in zip(g, w):
            assert by_hash.setdefault(h, x) == x
    assert len(set(by_hash)) == len({x for w in want for x in w})


def test_blocks_cut_at_words(monkeypatch):
    text = " ".join(f"w{i}" * (1 + i % 7) for i in range(300)) + " " + "x" * 500 + " tail"
    whole = hashed([text, None, "w1", text])
    monkeypatch.setattr(W, "BLOCK", 64)
    assert hashed([text, None, "w1", text]) == whole
    assert whole[0] == whole[3] and whole[1] == []


def test_case_folding():
    raw, at = W.utf8(pa.array(["The THE tHe É é"]))
    h, _ = W.WordHasher(fold_case=True)(raw, at)
    assert len(set(h.tolist())) == 3


def test_sliced_and_null_columns():
    a = pa.array(["a b", None, "c", "d e f"])[1:]
    raw, at = W.utf8(a)
    assert bytes(raw) == b"cd e f" and at.tolist() == [0, 0, 1, 6]


def test_grams_follow_content():
    w = np.array([1, 2, 3, 1, 2, 3, 4], dtype=np.uint64)
    g = W.gram_hashes(w, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4 and len(W.gram_hashes(w, 9)) == 0


def test_chunks_cover_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 50, "z"])], names=["t"])
    assert list(W.chunks(b, "t", 20)) == [(0, 2), (2, 3), (3, 4)]
