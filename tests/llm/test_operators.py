"""Every operator against a plain version of itself, on texts with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import bpe, components, fingerprint, line_dedup, lm, media, mixing, ngram_join, quality, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def key(row):
    return tuple((v is None, str(v)) for v in row)


# 1. BPE


def test_bpe_equals_the_library(docs, corpus, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary()
    ref = tokenizers.Tokenizer.from_file(path)
    want = []
    for r in corpus:
        ids = ref.encode(r[1] or "", add_special_tokens=False).ids
        text = ref.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, path).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(no_docs, path).count() == 0


def test_bpe_special_texts():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary()
    ref, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(path)
    for text in ["ΑΣ ΟΔΥΣΣΕΥΣ Σ", "İ Dž ß ẞ", "a<|endoftext|>B  c", "<|startoftext|><|endoftext|>", "x\x85y​z\x1c\x1dq", "i'LL don't 12³½Ⅷ", "é 가", "\x00\x01 a﻿b", "...!!!---", "a" * 3000, "ﬁ ŉ"]:
        ids = ref.encode(text, add_special_tokens=False)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids.ids, text
        assert own.decode(own.encode(text)) == ref.decode(ids.ids, skip_special_tokens=False)


def test_bpe_ids_and_texts(docs, corpus):
    c = bpe.Codec(bpe.vocabulary())
    got = bpe.encode_documents(docs, bpe.vocabulary()).collect()
    assert len(got) == len(corpus) and all(r.decoded == c.decode(bytes(r.ids)) for r in got)


# 2. language model


def kneser_ney(train, order):
    """The model by its formulas: a function from (history, word) to p."""
    seqs = [["<s>"] * (order - 1) + words(t) + ["</s>"] for t in train]
    grams = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    disc, ctx = {}, {}
    for n, cs in grams.items():
        k = Counter(cs.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        disc[n] = [0] + [min(max((i - (i + 1) * y * k[i + 1] / k[i]) if k[i] else i / 2, 0.05), i - 0.05) for i in (1, 2, 3)]
        ctx[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in cs.items():
            x = ctx[n][g[:-1]]
            x[0] += c
            x[min(c, 3)] += 1
    size = len({w for s in seqs for w in s[order - 1 :]})

    def p(h, w):
        out = 1 / (size + 1)
        for n in range(1, order + 1):
            hh = tuple(h[len(h) - n + 1 :]) if n > 1 else ()
            x = ctx[n].get(hh)
            if x:
                c = grams[n].get((*hh, w), 0)
                out = max(c - disc[n][min(c, 3)], 0) / x[0] + sum(disc[n][k] * x[k] for k in (1, 2, 3)) / x[0] * out
            elif n == 1:
                out = 1 / (size + 1)
        return out

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_equals_its_formulas(spark, docs, corpus, order):
    from tracewright.llm.common import documents

    texts = documents(docs)
    model = lm.train(texts.filter("doc_id % 7 != 2"), order)
    train = [r[1] for r in corpus if r[0] is not None and r[0] % 7 != 2]
    tokens = Counter(w for t in train for w in [*words(t), "</s>"])
    total, size = sum(tokens.values()), len(tokens)
    p = kneser_ney(train, order)
    want = defaultdict(list)
    for r in corpus:
        w = [*words(r[1]), "</s>"]
        seq = ["<s>"] * (order - 1) + w
        score = sum(math.log10(p(seq[i : i + order - 1], x)) for i, x in enumerate(w))
        want[r[0]].append((len(w), sum(tokens[x] > 0 for x in w), sum(math.log10((tokens[x] + 1) / (total + size + 1)) for x in w), score))
    got = defaultdict(list)
    for r in lm.score(texts, model).collect():
        assert r.train_tokens == total
        got[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
    assert got.keys() == want.keys()
    for k, rows in want.items():
        for a, b in zip(sorted(rows), sorted(got[k]), strict=True):
            assert a == pytest.approx(b, rel=1e-9)
    vocabulary = [*tokens, "<unknown>"]
    if order == 2:
        assert sum(p(["kara"], w) for w in vocabulary) == pytest.approx(1)


def test_language_model_without_rows(no_docs):
    from tracewright.llm.common import documents

    assert lm.score(documents(no_docs), lm.train(documents(no_docs))).count() == 0


# 3. line dedup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    import random

    rng = random.Random(3)
    for _ in range(4000):
        most = rng.choice([0, 1, 2, 3, 5])
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b))] = rng.choice(["", "a", "b"])
        b = "".join(b)
        assert line_dedup.distance(a, b, most) == min(plain_distance(a, b), most + 1)


def plain_classes(corpus, edits):
    """Lines by class; two lines are alike within a tenth of the shorter one's length, ``edits`` at most."""
    docs = {(r[0], r[1] or "") for r in corpus}
    places = defaultdict(list)
    for i, t in docs:
        for n, line in enumerate(t.split("\n") if t else []):
            if any(ord(c) > 32 for c in line):
                places[line].append((i, n, t))
    top = {x: x for x in places}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    lines = list(places)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            most = min(min(len(a), len(b)) // 10, edits)
            if abs(len(a) - len(b)) <= most and line_dedup.distance(a, b, most) <= most:
                top[find(a)] = find(b)
    classes = defaultdict(list)
    for line, where in places.items():
        classes[find(line)] += where
    return classes


def test_lines_send_few_probes_and_leave_little(spark, plain_docs, tmp_path, monkeypatch):
    """Probes that meet no line's own chunk are not sent, though all that meet one are; what classes were made of is dropped."""
    folder, texts = f"{tmp_path}/owned", plain_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).coalesce(1)
    lines = sorted({x for r in texts.collect() for x in r.text.split("\n")})
    cut = line_dedup.Cut(pa.array(lines))
    keys, _ = line_dedup.probes(cut, np.flatnonzero(line_dedup.allowed(cut.size) > 0), line_dedup.MOST_EDITS)
    own = {k >> 1 for k in keys.tolist() if k & 1}
    owned = line_dedup.Owned(folder, 3)
    owned.write(texts, line_dedup.MOST_EDITS)
    for part in range(3):
        some = keys[line_dedup.part_of(keys, 3) == part]
        held = owned.holds(part, some.astype(np.uint32))
        marked = np.array([k >> 1 in own for k in some.tolist()])
        assert held[marked].all() and held[~marked].mean() < 0.1
    sent = sum(len(r["keys"]) // 4 for r in line_dedup.probe_entries(texts, 3, line_dedup.MOST_EDITS, owned).collect())
    assert sent < len(keys) / 2
    monkeypatch.setattr(line_dedup, "shared_folder", lambda spark, label: f"{tmp_path}/{label}")
    line_dedup.line_classes(plain_docs.limit(30))
    left = {p.name for p in tmp_path.glob("line-dedup/*")} | {p.name for p in tmp_path.glob("line-dedup/join/*")}
    assert "classed" in left and not left & {"met", "owned", "contents", "stars", "pairs", "open"}


def test_lines_that_meet_by_chance_go_before_their_contents_are_kept(spark, tmp_path, monkeypatch):
    """Long lines with a common start meet under its chunk, but only those whose bitmaps may be alike go on; pairs of a large
    group of near copies are not told one by one."""
    import random

    from tracewright.llm import bucket_join

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz "
    lines = ["the same start of all lines " + "".join(rng.choice(letters) for _ in range(60)) for _ in range(300)]
    lines += [lines[k][:70] + "#" + lines[k][71:] for k in range(10)]
    near = "".join(rng.choice(letters) for _ in range(120))
    group = [near[:k] + rng.choice("ABCDEFGH") + near[k + 1 :] for k in range(0, 120)]
    rows = [(i, x) for i, x in enumerate([*lines, *dict.fromkeys(group)])]
    kept = {}
    write = bucket_join.Contents.write
    monkeypatch.setattr(bucket_join.Contents, "write", lambda self, contents: (kept.update({r["item"]: bytes(r["content"]).decode() for r in contents.collect()}), write(self, contents))[1])
    monkeypatch.setattr(line_dedup, "MANY", 4)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(texts).collect()}
    assert got == {i: 310 if i >= 310 else i - 300 if i >= 300 else i for i, _ in rows}
    assert {*lines[:10], *lines[300:], *group} <= set(kept.values()) and len(kept) < 200


def test_lines_that_meet_in_many_buckets_are_compared_once(spark, tmp_path, monkeypatch):
    """Variants of one line, farther apart than the edits allowed, meet under most of its chunks; each pair's contents are
    compared once, though their buckets are many."""
    import random

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = [rng.choice(letters) for _ in range(480)]
    lines = []
    for _ in range(170):
        line = list(base)
        for at in rng.sample(range(10, 470, 20), 3):
            line[at : at + 6] = [rng.choice("ABCDEFGH") for _ in range(6)]
        lines.append("".join(line))
    log, alike = f"{tmp_path}/pairs", line_dedup.alike

    def counted(edits):
        test = alike(edits)

        def run(contents, i, j):
            with open(log, "a") as f:
                f.write(f"{len(i)}\n")
            return test(contents, i, j)

        return run

    monkeypatch.setattr(line_dedup, "alike", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(docs).collect()}
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in lines]
    i, j = np.triu_indices(len(lines), 1)
    near = line_dedup.distances(points, i, j, 15) <= 15
    top = list(range(len(lines)))
    for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
        while top[x] != x:
            x = top[x]
        while top[y] != y:
            y = top[y]
        top[max(x, y)] = min(x, y)
    for k in range(len(top)):
        top[k] = top[top[k]]
    assert got == dict(enumerate(top)) and len(set(top)) > 100
    with open(log) as f:
        assert sum(map(int, f)) <= 1.5 * len(i)


def test_settled_components_leave_the_rounds(spark, tmp_path):
    links = [(k, k + 1) for k in range(40)] + [(1000, 1001 + k) for k in range(500)]
    got = {(r.node, r.component) for r in components.connected(spark.createDataFrame(links, "a long, b long"), f"{tmp_path}/cc").collect()}
    assert got == {(k, 0) for k in range(41)} | {(1000 + k, 1000) for k in range(501)}
    rounds = sorted(int(p.name) for p in tmp_path.glob("cc/*") if p.name.isdigit())
    assert len(rounds) > 2
    assert spark.read.parquet(f"{tmp_path}/cc/{rounds[-1]}").count() <= 40


def test_far_pairs_of_long_lines_end_early():
    import random

    rng = random.Random(8)
    lines = []
    for _ in range(12):
        base = [rng.choice("abcd ") for _ in range(rng.randint(60, 260))]
        for edits in (0, 3, 9, 14, 15, 16, 17, 25, 60):
            other = list(base)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 1)] = [rng.choice("abcd ")] * rng.randint(0, 1)
            lines.append("".join(other))
    points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in lines]
    i = np.repeat(np.arange(0, len(lines), 9), 9)
    j = np.arange(len(lines))
    got = line_dedup.distances(points, i, j, 15)
    assert got.tolist() == [min(plain_distance(lines[x], lines[y]), 16) for x, y in zip(i, j, strict=True)]
    assert (got == 16).any() and ((got > 9) & (got < 16)).any()


@pytest.mark.parametrize("edits", [2, line_dedup.MOST_EDITS])
def test_line_classes(docs, corpus, no_docs, edits):
    near = [(1000, "a line with some words in it, long enough\nother", "en", "s", 1), (1001, "a line with some w0rds in it, long enough\nx", "en", "s", 1), (1002, "a line with sme w0rds in it, long enogh", "en", "s", 1), (1003, "short line\nshort lane\nshrt line\nnine char\nnine chars", "en", "s", 1)]
    spark = docs.sparkSession
    more = docs.select("doc_id", "text", "lang", "source", "n_chars", "item", "part", "class", "mark").union(spark.createDataFrame([(*r, "p", "q", "r", "s") for r in near], "doc_id long, text string, lang string, source string, n_chars long, i string, p string, c string, m string"))
    got = {}
    for r in line_dedup.line_classes(more, edits).collect():
        got.setdefault((r.doc_id, r.line_no, r.mark), set()).add((r.class_doc_id, r.class_line_no, r.keep))
    classes = plain_classes([*corpus, *near], edits)
    kept = Counter()
    for members in classes.values():
        first = min(members, key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        kept[(first[0], first[1])] += 1
    assert Counter((k[0], k[1]) for k, v in got.items() for x in v if x[2]) == kept
    assert len(got) == sum(len(m) for m in classes.values())
    assert line_dedup.line_classes(no_docs).count() == 0


def test_documents_without_repeats(docs, corpus, no_docs):
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    lines = Counter(x for r in {(r.doc_id, r.text) for r in rows} for x in (r[1] or "").split("\n") if x.strip())
    assert max(lines.values()) == 1
    assert {x for r in corpus for x in (r[1] or "").split("\n") if len(x) >= 20} >= set(x for x in lines if len(x) >= 20)
    assert all(r.n_chars is None or r.n_chars == len(r.text) or (r.doc_id, r.n_chars) in {(c[0], c[4]) for c in corpus} for r in rows)
    assert line_dedup.without_repeats(no_docs).count() == 0


def test_lines_with_a_changed_word(spark, tmp_path):
    """Near copies with word-level edits meet within a tenth of their length; those beyond it do not."""
    import random

    rng = random.Random(5)
    words_ = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 11))) for _ in range(400)]
    lines = []
    for size in (3, 5, 8, 12, 20, 30, 50, 80):
        for _ in range(5):
            line = [rng.choice(words_) for _ in range(size)]
            for changed in range(5):
                near = list(line)
                for _ in range(changed):
                    at = rng.randrange(len(near))
                    near[at : at + rng.randint(0, 1)] = [rng.choice(words_)] * rng.randint(0, 1)
                lines.append(" ".join(near))
    rows = [(i, x) for i, x in enumerate(lines)]
    top = {x: x for x in lines}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    far = 0
    long = [x for x in top if len(x) >= 20]
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            most = min(max(min(len(a), len(b)) // 10, 2), 15)
            if abs(len(a) - len(b)) <= most and plain_distance(a, b) <= most:
                far += plain_distance(a, b) > 2
                top[find(a)] = find(b)
    assert far > 40
    firsts = {}
    for i, x in rows:
        firsts.setdefault(find(x), i)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_doc_id for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: firsts[find(x)] for i, x in rows if x.strip()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in line_dedup.without_repeats(docs).collect()} == {i for i, x in rows if not x.strip() or firsts[find(x)] == i}


# 4. quality


def junk(rng, i):
    return " ".join(["SHOUT!! NOW!!", "buy*** cheap$$$", "x x x x x x"][i % 3] for _ in range(rng.randint(5, 30)))


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(9)
    rows, marks = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = junk(rng, i) if bad else prose(rng, 60)
        if toxic:
            text += " moron" + rng.choice(["ic", "s", ""]) + " scum"
        rows.append((i, text, "en" if i % 2 else "de", "s", len(text)))
        marks.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*marks, (None, 1, 0), (7000, 1, None), marks[0]], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled, docs, no_docs):
    texts, marks = labelled
    model = quality.train(texts, marks)
    truth = {r.doc_id: r.quality for r in marks.collect()}
    held = [r for r in quality.score_documents(texts, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([(r.score >= quality.THRESHOLD) == truth[r.doc_id] for r in held]) > 0.95
    scores = quality.score_documents(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.score_documents(no_docs, model).count() == 0
    assert quality.train(texts, marks.filter("quality = 1")) is None
    assert {r.score for r in quality.score_documents(texts, None).collect()} == {quality.EMPTY}


def test_chain_sums_equal_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    rows = np.array([0, 3, 3, 4, 8])
    emit, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, pair = quality.chain(emit, rows, trans)
    want, pairs = np.zeros((8, 2)), np.zeros((2, 2))
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if a == b:
            continue
        paths = list(product((0, 1), repeat=b - a))
        w = np.array([math.exp(sum(emit[a + i, s] for i, s in enumerate(p)) + sum(trans[s, t] for s, t in zip(p, p[1:], strict=False))) for p in paths])
        for p, q in zip(paths, w / w.sum(), strict=True):
            for i, s in enumerate(p):
                want[a + i, s] += q
            for s, t in zip(p, p[1:], strict=False):
                pairs[s, t] += q
    assert got == pytest.approx(want) and pair == pytest.approx(pairs)


# 5. fingerprints


def test_neighbours(docs, corpus, no_docs, spark):
    got = fingerprint.neighbours(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: r[1])
    order = sorted(order, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text) // 3
        want.append((doc, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.neighbours(no_docs).count() == 0
    one = fingerprint.neighbours(spark.createDataFrame([(1, "a b c d e f", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_containment_estimates():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    big = [f"w{x}" for x in rng.integers(0, 10**9, 4000)]
    a, b = fingerprint.sketches(pa.array([" ".join(big[:1000]), " ".join(big)]))
    assert fingerprint.containment(a, b) > 0.95 and fingerprint.containment(b, a) == pytest.approx(0.25, abs=0.06)
    half = fingerprint.sketches(pa.array([" ".join(big[:2000]), " ".join(big[2000:])]))
    assert fingerprint.likeness(fingerprint.merge(*half), b) > 0.99


# 6. sharding


def test_placement(docs, no_docs):
    table = sharding.fill(sharding.SHARDS)
    counts = Counter(table)
    assert len(counts) == 32 and max(counts.values()) - min(counts.values()) <= 1
    left = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, left, strict=True) if a != 31)
    assert moved / sharding.SLOTS < 0.2
    got = sharding.place(docs, "doc_id", sharding.SHARDS)
    assert got.count() == docs.count() and sorted(got.columns) == sorted(docs.columns)
    for r in got.select("doc_id", "slot", "shard").collect():
        slot = sharding.digest60("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(no_docs, "doc_id", sharding.SHARDS).count() == 0
    for bad in (dict(slots=10), dict(shards=["a", "a"]), dict(shards=[])):
        with pytest.raises(ValueError):
            sharding.fill(bad.get("shards", ["a"]), bad.get("slots", 11))


def test_turns_claim_first_free_slots():
    def plain(shards, slots):
        lists = [[(sharding.digest60("offset:" + s) + j * (sharding.digest60("skip:" + s) % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
        owner = {}
        while len(owner) < slots:
            for k, prefer in enumerate(lists):
                if len(owner) < slots:
                    owner[next(x for x in prefer if x not in owner)] = k
        return [owner[i] for i in range(slots)]

    for shards, slots in ((["a", "b", "c"], 31), (["x"], 7), ([f"n{i}" for i in range(9)], 101)):
        assert sharding.fill(shards, slots) == plain(shards, slots)


# 7. toxicity


def test_toxicity_on_held_out_rows(labelled, docs, no_docs):
    texts, marks = labelled
    model = toxicity.train(texts, marks)
    assert model.categories[-1] == "toxic"
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    held = [r for r in toxicity.score_documents(texts, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([(r.score >= toxicity.THRESHOLD) == truth[r.doc_id] for r in held]) > 0.95
    assert toxicity.score_documents(docs, model).count() == docs.count()
    assert toxicity.score_documents(no_docs, model).count() == 0
    assert toxicity.train(texts, marks.filter("doc_id is null")).categories == ["toxic"]


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(2)
    first = rng.integers(0, 2, 400)
    sets = [np.unique(np.array([1 if f else 2, 10 + rng.integers(0, 50)], np.uint64)) for f in first]
    model = toxicity.fit_chain(sets, np.stack([first, first], 1), ["one", "two"])
    assert model.links[1].earlier[0] > 0.5
    assert np.mean((toxicity.predict(model, sets)[:, 1] > 0.5) == first) > 0.99


# 8. media


def test_payloads(docs, corpus, no_docs):
    got = media.payload_features(media.payload_images(docs)).collect()
    want = []
    for r in corpus:
        raw = (r[1] or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        padded = raw + b"\0" * (size - len(raw))
        want.append((r[0], len(raw), size, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert media.payload_features(media.payload_images(no_docs)).count() == 0


def test_formats_and_tiles(spark):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    colour = np.stack([grey, grey + 1, grey + 2], 2)
    assert (media.read_netpbm(b"P2 # c\n4 3\n255\n" + b" ".join(str(x).encode() for x in grey.ravel())) == grey).all()
    assert (media.read_netpbm(b"P5 4 3 255\n" + grey.tobytes()) == grey).all()
    assert (media.read_netpbm(b"P6\n4 3\n255\n" + colour.tobytes()) == colour).all()
    assert (media.read_netpbm(b"P3 4 3 255 " + b" ".join(str(x).encode() for x in colour.ravel())) == colour).all()
    assert (media.read_netpbm(b"P5 2 1 1000\n" + bytes([1, 0, 2, 3])) == [[256, 515]]).all()
    assert (media.read_netpbm(b"P1 3 2 101 010") == [[1, 0, 1], [0, 1, 0]]).all()
    assert (media.read_netpbm(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])) == [[1, 0, 1], [0, 1, 0]]).all()
    rows = b"".join(np.ascontiguousarray(r[:, ::-1]).tobytes() for r in colour[::-1])
    bmp = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (4).to_bytes(4, "little") + (3).to_bytes(4, "little") + bytes([1, 0, 24, 0]) + bytes(24) + rows
    assert (media.read_bmp(bmp) == colour).all()
    big = np.random.default_rng(0).integers(0, 256, (90, 60)).astype(float)
    assert media.resize(big, 9, 6) == pytest.approx(big.reshape(9, 10, 6, 10).mean((1, 3)))
    assert media.resize(big, 7, 11).mean() == pytest.approx(big.mean())
    frame = spark.createDataFrame([(1, b"P5 4 3 255\n" + grey.tobytes(), "x"), (2, None, "x"), (3, b"no image", "x"), (4, bmp, "x"), (4, bmp, "x"), (5, b"P5 4", "x"), (6, b"", "x")], "doc_id long, media binary, id string")
    got = {r.id: r for r in media.tiles(frame).collect()}
    assert np.load(io.BytesIO(got[1].tile_npy)).shape == (32, 32) and got[1].dhash == got[4].dhash
    assert got[2].error is None and got[2].dhash is None and got[3].error and got[5].error and got[6].error


# 9. n-gram join


def plain_components(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                top[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(s), (least.get(find(x)) if s else i)) for x, (i, s) in enumerate(sets)]


def test_near_duplicates(docs, corpus, no_docs):
    got = ngram_join.near_duplicates(docs).collect()
    want = plain_components([(r[0], r[1]) for r in corpus])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_chains_and_families(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):  # edits of one text, from hardly any to many
        text = list(base)
        for _ in range(i // 8):
            text[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    text = list(base)
    for i in range(200, 240):  # a chain whose ends are far apart
        text = [f"c{i}{k}" if k // 4 == (i - 200) else x for k, x in enumerate(text)]
        rows.append((i, " ".join(text)))
    shared = [f"p{k}" for k in range(70)]
    rows += [(300 + i, " ".join([*(f"q{i}-{k}" for k in range(60)), *shared])) for i in range(80)]  # a passage in common
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(frame).collect()))
    assert got == sorted(plain_components(rows))


def test_one_of_each(docs, corpus):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    by = {r[0]: r[2] for r in plain_components([(r[0], r[1]) for r in corpus])}
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and all(i in ids for i, c in by.items() if i is not None and c == i and i not in (3, 5))


def test_one_row_of_each_group(spark):
    """Repeated rows, null ids and ids with two texts: each group keeps one row, rows outside of groups stay."""
    one, two, three = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, one), (1, one), (2, one), (None, one), (2, two), (None, three), (None, three), (None, ""), (None, None), (7, "")]
    for n in (1, 4):
        kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (2, two), (None, three), (None, ""), (None, None), (7, "")], key=str)


def test_components(spark, tmp_path):
    import random

    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(1, 90)] + [(1, 1), (None, 3)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long"), str(tmp_path)).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(top)}


# 10. mixing


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


def test_mix(docs, corpus, no_docs):
    got = mixing.taken(docs, block=16).collect()
    assert len(got) == len(corpus)
    sizes, took = Counter(), Counter()
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
    goal = plain_targets(sizes)
    for r in got:
        took[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 2 * r.size
    for s, t in goal.items():
        assert abs(took[s] - t) <= 1
    again = mixing.taken(docs.repartition(2), block=16)
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again.collect())
    assert mixing.taken(no_docs).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(no_docs).count() == 0


def test_stream_follows_targets_everywhere(spark):
    goals = spark.createDataFrame([("a", 5000), ("b", 2500), ("c", 500)], "source string, goal long")
    slots = mixing.schedule(goals, 10).orderBy("slot").collect()
    assert Counter(r.source for r in slots) == {"a": 500, "b": 250, "c": 50}
    for n in (80, 200, 400):
        part = Counter(r.source for r in slots[:n])
        assert abs(part["a"] - n * 5 / 8) <= 4 and abs(part["b"] - n * 2.5 / 8) <= 4
    ranks = {s: [r["rank"] for r in slots if r.source == s] for s in "abc"}
    assert all(x == list(range(len(x))) for x in ranks.values())
