import re

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import textvec as tv

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def check(texts):
    data, offsets = tv.utf8(pa.array(texts, pa.string()))
    h, counts = tv.words(data, offsets)
    plain = [WORD.findall((t or "").encode().translate(bytes(tv.LOWER))) for t in texts]
    assert np.diff(counts).tolist() == [len(p) for p in plain]
    known = {}
    for w, x in zip((w for p in plain for w in p), h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    s, at = tv.shingles(h, counts, 5)
    sets = {}
    for p, a, b in zip(plain, at[:-1], at[1:], strict=True):
        runs = [tuple(p[i : i + 5]) for i in range(len(p) - 4)] if len(p) >= 5 else [tuple(p)] * bool(p)
        assert b - a == len(runs)
        for r, x in zip(runs, s[a:b].tolist(), strict=True):
            assert sets.setdefault(r, x) == x
    assert len(set(sets.values())) == len(sets)


def test_words_and_shingles_equal_a_plain_count():
    check(["The the THE a\tb\x0bc\n d  e", None, "", "   ", "x", "é É ß y z", "a b c d e f g", "a b c d e f g", "one two", "b a"])
    check([])
    check([None])


@pytest.mark.parametrize("chunk", [16, 64, 1000])
def test_chunks_do_not_change_hashes(monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    texts = ["".join(rng.choice(list("abCd  \n"), rng.integers(0, 90))) for _ in range(60)] + ["q" * 300 + " tail", "x y " * 200, None, "end"]
    data, offsets = tv.utf8(pa.array(texts, pa.string()))
    whole = tv.words(data, offsets)
    monkeypatch.setattr(tv, "CHUNK", chunk)
    parts = tv.words(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    check(texts)
