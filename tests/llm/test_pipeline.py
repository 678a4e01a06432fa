"""The pipeline's stages against plain versions, and the queries over small tables, empty ones included."""

import importlib
import sys
from collections import Counter

import pytest

from tests.llm.test_operators import junk, plain_classes, plain_components, plain_targets, words
from tracewright.llm import line_dedup, registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    import random

    rng = random.Random(2)
    rows = [*corpus, *((2000 + i, junk(rng, i), "en", "s1", 9) for i in range(40))]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    marks = [(r[0], int(r[0] < 2000), 0) for r in rows if r[0] is not None and r[1] and len(r[1]) > 40]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if name != "bpe":
            assert docs.columns == names
        if name == "quality":
            assert not [r for r in after if r.doc_id is not None and r.doc_id >= 2000]
            assert len([r for r in after if r.text and len(r.text) > 200]) > 0.9 * len([r for r in before if r.text and len(r.text) > 200 and (r.doc_id is None or r.doc_id < 2000)])
        elif name == "line_dedup":
            kept = Counter(x for r in {(r.doc_id, r.text) for r in after} for x in (r[1] or "").split("\n") if x.strip())
            assert len(kept) == len(plain_classes(before, line_dedup.MOST_EDITS)) and max(kept.values()) == 1
        elif name == "ngram_join":
            groups = plain_components([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {i for i, _, c in groups if i is None or i == c} | {i for i in Counter(g[0] for g in groups) if (i, i) in {(g[0], g[2]) for g in groups}}
        elif name == "mix":
            sizes, took = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(words(r.text))
            for r in after:
                took[r.source] += len(words(r.text))
            longest = max(len(words(r.text)) for r in before)
            assert all(abs(took[s] - t) <= longest for s, t in plain_targets(sizes).items())
        else:
            assert len(after) == len(before)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_over_empty_tables(spark, empty_folder, name):
    assert registry.QUERIES[name](spark, empty_folder).count() == 0


def test_run_over_empty_tables(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_sharding_sql(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["op6_sharding"]).fetchall()
    got = registry.QUERIES["op6_sharding"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_entry_without_the_optional_part(monkeypatch):
    import __spark_entry__

    for module in [m for m in sys.modules if m.startswith("tracewright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, "tracewright.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(__spark_entry__)
        assert bare.queries() and not any(k.startswith("op") or k == "pipeline" for k in bare.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
    assert "pipeline" in __spark_entry__.queries()
