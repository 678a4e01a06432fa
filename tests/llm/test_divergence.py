"""The divergence audit against sums over plain counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import divergence as dv

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs, top=dv.TOP):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def prices(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + dv.SCALE * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = prices(whole), {s: prices(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, limit in ((pairs, len(pairs)), (terms, top)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, rank) for rank, x in enumerate(part[:limit], 1)]
    return sorted(out)


def got(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("min_docs", [1, 3, 30])
def test_audit_by_plain_sums(docs, corpus, min_docs):
    assert got(dv.audit(docs, min_docs)) == plain(corpus, min_docs)


def test_no_terms_are_kept(docs, corpus):
    found = got(dv.audit(docs, 10**6))
    assert found == plain(corpus, 10**6) and found and {r[4] for r in found} == {0}


def test_empty_table_and_odd_columns(spark, no_docs):
    assert got(dv.audit(no_docs)) == []
    rows = [(1, "b a A", "en", "s1"), (2, "a c é", "en", "s2"), (3, None, "en", "s3"), (4, "A", "de", "s1")]
    odd = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, `x.y` string, `b``t` string, term string")
    assert got(dv.audit(odd, 1)) == plain(rows, 1)
    assert not [r for r in plain(rows, 1) if r[0] == "de" and r[2] == "pair"]


def test_entries_are_handed_over_early_and_texts_in_pieces(docs, corpus, monkeypatch):
    every = sorted(map(tuple, dv.term_counts(docs).collect()))
    assert sorted(map(tuple, dv.term_counts(docs, entries=7).collect())) == every
    data = b"ab  cde f " + b"g" * 40 + b" h"
    for size in (1, 3, 8, 100):
        parts = list(dv._pieces(data, 0, len(data), size))
        assert b"".join(parts) == data and [t for p in parts for t in p.split()] == data.split()


def test_many_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_TERMS", 7)
    assert got(dv.audit(docs, 2)) == plain(corpus, 2)


def test_gallop():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 7), (7, 300), (500, 500)):
        pool, keys = (np.unique(rng.integers(0, 900, k)) for k in (n, m))
        assert (dv.gallop(keys, pool) == np.searchsorted(pool, keys)).all()
    clumped = np.concatenate([np.arange(1000), np.arange(10**9, 10**9 + 5)])
    assert (dv.gallop(np.array([3, 999, 10**9 + 4, 2 * 10**9]), clumped) == [3, 999, 1004, 1005]).all()


def test_prices_are_exact(spark):
    rng = random.Random(2)
    cases = [(c, size, terms) for size in (0, 10, 10**12, 5 * 10**17) for terms in (1, 77, 10**8) for c in {0, size, rng.randint(0, size)}]
    want = [1 + dv.SCALE * (c + 5) // (s + 5 * t) for c, s, t in cases]
    assert [int(dv.prices(np.array([c]), s, t)[0]) for c, s, t in cases] == want
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c long, s long, t long").select("i", dv.price("c", "s", "t").alias("p"))
    assert [r.p for r in sorted(frame.collect())] == want
    assert spark.range(1).select(dv.price("0", "0", "0").alias("p")).first().p is None
