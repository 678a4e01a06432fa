"""Queries against brute-force versions of themselves, and cases that only some inputs have: clashing names, equal rows, blocks."""

import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from tests.llm.test_operators import junk, words
from tracewright.llm import fingerprint, line_dedup, media, mixing, ngram_join, quality, toxicity
from tracewright.llm import textvec as tv

CLASHING = ("quality_text", "quality_text_", "mix_key", "mix_copy", "dedup_own", "lines", "own", "own_id", "own_mark", "gone_own", "row", "rows", "some", "mark", "known", "kept", "x.y", "own.text", "a`b", "`", " lead", "Upper Case", "é")


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"{c}!").alias(c) for c in CLASHING))


def unharmed(rows):
    return all(r[c] == f"{c}!" for r in rows for c in CLASHING)


@pytest.fixture(scope="module")
def quality_tables(spark):
    rng = random.Random(4)
    rows = [(i, junk(rng, i) if i % 4 == 0 else "\n".join(prose(rng, 12) for _ in range(rng.randint(1, 260 if i % 50 == 1 else 6))), "en", "s", 1) for i in range(160)]
    rows += [(None, None, None, None, None), (500, "", "en", "s", 0), (501, " \n\t\n", "en", "s", 4), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = [(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(160)]
    return rows, docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_filters_keep_clashing_columns(docs, quality_tables):
    _, texts, marks = quality_tables
    odd = with_clashes(docs)
    for out in (quality.good_documents(odd, quality.train(texts, marks)), line_dedup.without_repeats(odd), ngram_join.one_of_each(odd), mixing.mixed(odd)):
        assert out.columns == odd.columns
        rows = out.collect()
        assert rows and unharmed(rows)


@pytest.mark.parametrize("doc_id", [7, None])
def test_three_equal_rows_leave_one(spark, doc_id):
    text = "the first line of three equal rows\nand a second line that is long enough too"
    rows = [(doc_id, text), (doc_id, text), (doc_id, text), (8, "something else altogether, on its own"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for keep in (line_dedup.without_repeats, ngram_join.one_of_each):
        got = Counter((r.doc_id, r.text) for r in keep(docs).collect())
        assert got == Counter({(doc_id, text): 1, (8, rows[3][1]): 1, (9, None): 1, (9, ""): 1})
    lines = line_dedup.line_classes(docs).collect()
    assert len(lines) == 7 and Counter(r.keep for r in lines) == {True: 3, False: 4}


def test_very_long_line_and_text(spark):
    rng = random.Random(1)
    line = prose(rng, 30000).replace("\n", " ")
    rows = [(1, line), (2, line[:-1] + "#"), (3, line + "\n" + "\n".join(f"row {i} of a long table of numbers {i * i}" for i in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert set(kept) == {1, 3} and kept[1] == line and not kept[3].startswith(line)
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {1, 3}


def test_distances_of_many_pairs():
    from tests.llm.test_operators import plain_distance

    rng = random.Random(8)
    lines = []
    for _ in range(60):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b))] = rng.choice(["", "x", "𝟘"])
        lines += [a, "".join(b)]
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in lines]
    i, j = np.triu_indices(len(lines), 1)
    for most in (1, 15, 31):
        got = line_dedup.distances(points, i, j, most)
        some = rng.sample(range(len(i)), 400)
        assert [got[k] for k in some] == [min(plain_distance(lines[i[k]], lines[j[k]]), most + 1) for k in some]


# 4. quality: the query against chains summed one by one


def test_quality_query_by_single_chains(quality_tables):
    rows, docs, marks = quality_tables
    model = quality.train(docs, marks)
    w, trans, mean, scale = model

    def plain(text):
        found = quality.lines_of(pa.array([text or ""]))
        n = len(found.weight)
        if not n:
            return quality.EMPTY
        emit = ((found.features - mean) / scale) @ w
        forward = [emit[0]]
        for t in range(1, n):
            forward.append(np.array([np.logaddexp(*(forward[-1] + trans[:, s])) + emit[t, s] for s in (0, 1)]))
        backward = [np.zeros(2)]
        for t in range(n - 2, -1, -1):
            backward.append(np.array([np.logaddexp(*(trans[s] + emit[t + 1] + backward[-1])) for s in (0, 1)]))
        both = np.array(forward) + np.array(backward[::-1])
        good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
        return float((good * found.weight).sum() / found.weight.sum())

    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.score_documents(docs, model).collect()))
    want = sorted((r[0] is None, r[0] or 0, plain(r[1])) for r in rows)
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert [g[2] for g in got] == pytest.approx([x[2] for x in want], abs=1e-6)


def test_held_out_is_never_null(spark, quality_tables, tmp_path):
    _, docs, marks = quality_tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    for query in (quality.op4_quality, toxicity.op7_toxicity):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == docs.count()
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


# 5. fingerprints: sets of shingles, word by word


def plain_sketch(text):
    w = words(text)
    grams = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    hashes = set()
    for g in grams:
        h, at = tv.shingles(*tv.words(*tv.utf8(pa.array([g]))), 5)
        assert at[-1] == 1
        hashes.add(int(h[0]))
    low = {h for h in hashes if h * fingerprint.SCALE < 1 << 64}
    return low or ({min(hashes)} if hashes else set())


def test_fingerprint_query_by_plain_sets(docs, corpus):
    order = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: r[1])
    order = sorted(order, key=lambda r: (r[0] is None, -(r[0] or 0)))

    def like(a, b):
        if not a or not b:
            return float(len(a) == len(b))
        return len(a & b) / min(len(a), len(b))

    want = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text) // 3
        own, edited, following = (plain_sketch(t) for t in (text, text[: len(text) - n] + after[:n], after))
        form = [fingerprint.text_form(np.array(sorted(s), np.uint64)) for s in (own, edited)]
        want.append((doc, *form, round(like(own, edited), 9), round(like(own, following), 9)))
    got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprint.neighbours(docs).collect()]
    assert Counter(got) == Counter(want)


def test_merged_sketches_are_the_sketch_of_all():
    rng = np.random.default_rng(6)
    for _ in range(300):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, size)) for size in (5, rng.integers(5, 60), 0)]
        parts = fingerprint.sketches(pa.array(texts))
        hashes = np.unique(np.concatenate([tv.shingles(*tv.words(*tv.utf8(pa.array([t]))), 5)[0] for t in texts]))
        low = hashes[hashes <= fingerprint.limit(fingerprint.SCALE)]
        assert fingerprint.merge(*parts).tolist() == (low if len(low) else hashes[:1]).tolist()


# 7. toxicity: the chain by its formulas


def test_toxicity_query_by_plain_sums(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = prose(rng, 30) + (" moron scum" if i % 3 == 0 else "") + (" idiot" if i % 6 == 0 else "")
        rows.append((i, text, "en" if i % 2 else "de", "s", len(text)))
    rows += [(None, None, None, None, None), (900, "", "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    assert model.categories[-1] == "toxic" and len(model.links) == len(model.categories) == 3

    def plain(text):
        own = set(toxicity.features_of(pa.array([text or ""]))[0].tolist())
        seen = []
        for link in model.links:
            z = link.bias + sum(w for h, w in zip(link.hashes.tolist(), link.weights.tolist(), strict=True) if h in own)
            z += sum((p - 0.5) * e for p, e in zip(seen, link.earlier.tolist(), strict=True))
            seen.append(1 / (1 + math.exp(-min(max(z, -40), 40))))
        return seen

    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        assert [r.categories[c] for c in model.categories] == pytest.approx(plain(by_id[r.doc_id]), abs=1e-9)
    assert np.mean([(r.score >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300]) > 0.97


# 8. media: files and features byte by byte


def plain_area(image, size):
    """Means over a size x size grid of cells with fractional edges."""
    h, w = image.shape
    out = np.zeros((size, size))
    for r in range(size):
        for c in range(size):
            y0, y1, x0, x1 = r * h / size, (r + 1) * h / size, c * w / size, (c + 1) * w / size
            total = 0.0
            for y in range(int(y0), min(math.ceil(y1), h)):
                for x in range(int(x0), min(math.ceil(x1), w)):
                    total += image[y, x] * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
            out[r, c] = total / ((y1 - y0) * (x1 - x0))
    return out


def test_media_query_by_plain_files(spark, tmp_path):
    rng = random.Random(12)
    texts = [None, "", "short", "é" * 40, prose(rng, 40), prose(rng, 90), "x" * 64, "x" * 65, prose(rng, 20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        n = len(payload) // 64
        if n % 2:
            grey = b"".join(bytes([v, v, v, 0]) for v in range(256))
            file = b"BM" + struct.pack("<IHHI", 54 + 1024 + len(payload), 0, 0, 54 + 1024) + struct.pack("<IiiHHIIiiII", 40, 64, -n, 1, 8, 0, len(payload), 0, 0, 256, 0) + grey + payload
        else:
            file = f"P5\n64 {n}\n255\n".encode() + payload
        image = np.frombuffer(payload, np.uint8).reshape(n, 64).astype(float)
        nine = np.round(plain_area(image, 9), 6)
        bits = [nine[r, c + 1] > nine[r, c] for r in range(8) for c in range(8)] + [nine[r + 1, c] > nine[r, c] for r in range(8) for c in range(8)]
        feature = f"{int(''.join('01'[int(b)] for b in bits), 2):032x}"
        want[(doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature)] += 1
    got = media.op8_media(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:8] for r in got) == want
    for r in got:
        tile = np.load(io.BytesIO(bytes(r.tile_npy)))
        raw = (texts[r.doc_id] or "").encode()
        image = np.frombuffer(raw.ljust(r.payload_bytes, b"\0"), np.uint8).reshape(-1, 64).astype(float)
        assert tile.dtype == np.uint8 and tile.shape == (media.TILE, media.TILE)
        assert np.abs(tile - plain_area(image, media.TILE)).max() <= 0.5 + 1e-6


# 10. mixing: runs and stretches of other sizes give the same mix of sources


def test_mix_with_many_runs(docs, monkeypatch):
    sums = []
    for run in (mixing.RUN, 1):
        monkeypatch.setattr(mixing, "RUN", run)
        rows = mixing.taken(docs).collect()
        assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
        totals = Counter()
        for r in rows:
            totals[r.source] += r.taken
        sums.append(totals)
    assert sums[0] == sums[1]
