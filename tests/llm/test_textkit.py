import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import textkit as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\x1cé 　Z", max_size=30)), max_size=6))
def test_words(texts):
    w = K.Words(K.strings(pa.array(texts, pa.string())))
    want = [WORD.findall(t or "") for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert got == [x for own in want for x in own]
    of = {}
    for word, h in zip(got, w.hashes.tolist()):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def test_words_across_blocks():
    text = " ".join(f"word{i % 977}" for i in range(400_000)) + " " + "y" * (3 << 20) + " end"
    w = K.Words(K.strings(pa.array([text, "end"])))
    assert len(w.starts) == len(text.split()) + 1
    assert w.hashes[-1] == w.hashes[-2]
    assert len(np.unique(w.hashes)) == 979


def test_ngrams_agree_with_tuples():
    r = np.random.default_rng(0)
    ids = r.integers(0, 3, 500)
    h = K.mix(ids.astype(np.uint64))
    for n in (1, 3, 8, 35):
        g = K.ngrams(h, n)[: 500 - n + 1]
        of = {}
        for i, v in enumerate(g.tolist()):
            assert of.setdefault(tuple(ids[i : i + n]), v) == v
        assert len(set(of.values())) == len(of)


def test_hash_table():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    t = K.HashTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(np.arange(100, dtype=np.uint64)) == -1).all()
    assert len(K.HashTable(np.zeros(0, np.uint64)).find(keys)) == len(keys)


def test_hashes_of_words_made_against_polynomials():
    """Thue-Morse words agree under any polynomial modulo 2**64 from 1,024 letters on; here all words and windows differ."""
    for n in (64, 256, 1024, 4096):
        x = "".join("ab"[i.bit_count() & 1] for i in range(n))
        y = x.translate(str.maketrans("ab", "ba"))
        h = K.Words(K.strings(pa.array([f"{x} {y} {x}0 0{x}"]))).hashes
        assert len(set(h.tolist())) == 4
    w = K.mix(np.array([i.bit_count() & 1 for i in range(4096)], np.uint64))
    for n in (32, 35, 1024):
        g = K.ngrams(w, n)[: 4096 - n + 1]
        of = {}
        for i, v in enumerate(g.tolist()):
            assert of.setdefault(w[i : i + n].tobytes(), v) == v
        assert len(set(of.values())) == len(of)
