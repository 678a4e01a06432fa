"""Steps that must not move or meet more rows than their job needs."""

import random

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import extract, frameworks, fusion, graph, product, providers, relational
from tracewright.plans import extraction, registry


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_either_key_by_brute_force(spark):
    """Keys that repeat, lie in several groups or are null; each pair once."""
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])
    left = [(some(12), some(4), rng.choice([None, True, False])) for _ in range(60)]
    right = [(some(12), some(4)) for _ in range(30)]
    same = lambda a, b: a is not None and a == b
    want = {(a, b) for a, g, on in left for b, h in right if same(a, b) or on and same(g, h)}
    rows = spark.createDataFrame(left, "left long, group int, grouped boolean"), spark.createDataFrame(right, "right long, group int")
    for cells in (1, 3):
        got = [tuple(r) for r in relational.either_key(*rows, cells=cells, parts=5).collect()]
        assert len(got) == len(want) and set(got) == want


def test_pairs_of_either_key_are_not_compared(spark, sf_dir):
    assert plan(registry.QUERIES["j13_either_key"](spark, sf_dir)).startswith("Union")


def test_findings_meet_under_short_keys(spark):
    """No digest is shuffled; identities stay digests of the lower-cased parts."""
    rows = [("Bug", "a/B", 1, "R", "t", "info", "e1", 1, 1), ("bug", "A/b", 1, "r", "u", "risk", "e0", 0, 5), ("Bug", None, None, None, "t", "info", "e1", 1, 2)]
    found = fusion.fuse_findings(spark.createDataFrame(rows, "type string, path string, line int, rule string, title string, severity string, engine string, engine_ord int, fact_ord int"))
    text = {"bug|a/b|1|r": ("u", "risk", ["e0", "e1"], "confirmed"), "bug||0|": ("t", "info", ["e1"], "single source")}
    digests = {spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0]: v for t, v in text.items()}
    assert {r.identity: (r.title, r.severity, r.engines, r.label) for r in found.collect()} == digests
    aggregate = plan(found)[plan(found).index("Aggregate") :]
    assert "sha2" not in aggregate.lower()


def test_traversals_broadcast_few_rows_only(spark, tmp_path, monkeypatch):
    """Edges whose packed file is small are not sent to the driver, nor is a wide front."""
    spark.range(1, 400).select((F.col("id") / 3).cast("long").alias("source"), F.col("id").alias("target")).coalesce(1).write.parquet(f"{tmp_path}/edges")
    edges, seeds, plans, keep = spark.read.parquet(f"{tmp_path}/edges"), spark.range(1, 3).select(F.col("id").alias("seed")), [], graph.kept

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "kept", noted)
    monkeypatch.setattr(graph, "FEW", 1, raising=False)
    found = {(r.seed, r.node): r.depth for r in graph.reach(edges, seeds, None).collect()}
    want = {}
    for seed in (1, 2):
        for node in range(400):
            up, depth = node, 0
            while up > seed:
                up, depth = up // 3, depth + 1
            if up == seed:
                want[seed, node] = depth
    assert found == want
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_terms_by_letters_first(spark):
    """Every character that Java takes for a letter of ASCII in any case is folded to it; texts without the letters meet no pattern."""
    texts = ["use STRIPE now", "stripes", "ſtripe", "STRİPE", "strıpe", "\u212aubernetes", "é stripe!", "éstripe", "api.stripe.com", "", None, "(Redis) sentry.io", "kind: Deployment", "S3://x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in ("stripe", "Stripe", "redis", "kubernetes", "sentry.io", "é"):
        plain = F.col("t").rlike(r"(?iu)(?<![\p{L}\p{N}])\Q" + term + r"\E(?![\p{L}\p{N}])")
        assert [r[0] for r in rows.select(text.contains_term(F.col("t"), term)).collect()] == [r[0] for r in rows.select(plain).collect()]
    assert [r[0] for r in rows.select(product.services(F.col("t"))).collect()] == [["Stripe"], [], ["Stripe"], ["Stripe"], ["Stripe"], ["Kubernetes"], ["Stripe"], [], ["Stripe"], [], [], ["Redis", "Sentry"], ["Kubernetes"], []]
    points = spark.range(128, 0x3000).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert points.filter(F.col("c").rlike("(?iu)^[a-z]$") & ~text.folded(F.col("c")).rlike("^[a-z]$")).count() == 0
    assert "contains" in plan(rows.select(text.contains_term(F.col("t"), "stripe"))).lower()


def test_declared_symbols_are_those_of_all_facts(spark, sf_dir, monkeypatch):
    """Without mentioned ones, and without a look for relationships; of lines only those with a rule's words are read again."""
    lines = graph.kept(extract.numbered(extraction.code_files(spark, sf_dir).limit(60)))
    every = lambda rows: sorted(map(str, rows.collect()))
    mentioned = F.col("type").isin("environment_variable", "external_service") | (F.col("type") == "table") & ~F.col("language").eqNullSafe("SQL")
    want = every(extract.symbols(lines).filter(~mentioned))
    monkeypatch.setattr(extract, "_mentioned", None)
    assert every(extract.declared(lines)) == want
    assert 0 < frameworks.telling(lines).count() < lines.count() / 3


def test_fused_symbols_look_for_no_relationships(spark, sf_dir, monkeypatch):
    """What files mention is set aside, so it is not looked for; what they declare is the same."""
    files = extraction.code_files(spark, sf_dir).filter("project < 3").withColumn("path", F.concat(F.col("project").cast("string"), F.lit("/"), "path"))
    every = providers.default_registry().facts(files, "maximum").filter("type not in ('environment_variable', 'external_service') and (type <> 'table' or path like '%.sql')")
    own = providers.default_registry(mentioned=False).facts(files, "maximum")
    assert sorted(map(str, every.select(own.columns).collect())) == sorted(map(str, own.collect()))
    monkeypatch.setattr(extract, "facts", None)
    assert registry.QUERIES["x_providers_fused"](spark, sf_dir).columns == ["type", "label", "n"]
