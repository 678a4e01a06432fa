"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tracewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, partitions):
    names = ["e1_e6_symbol_fusion", "e7_disagreements", "j11_interval_containment", "t1_ranked_listing"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = [rows(registry.QUERIES[n](spark, sf_dir).toPandas()) for n in names]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert [rows(registry.QUERIES[n](spark, sf_dir).toPandas()) for n in names] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
