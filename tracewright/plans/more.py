"""Further queries: product views, admin lists, budgets, ages."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from tracewright.functions import labels, paths, text
from tracewright.operators import findings, fusion, graph, product, relational
from tracewright.plans.base import EDGES_SQL, FILES_SQL, SYMBOLS_SQL, edges, files, query, symbols, table
from tracewright.sources import snapshots


@query("p13_stack_detection", f"""WITH {FILES_SQL}, c AS (SELECT unnest(['markup', 'scripts', 'navigation', 'styles']) AS technology, unnest([count(*) FILTER (contains(content, '<html')), count(*) FILTER (contains(content, '<script')), count(*) FILTER (contains(content, '<nav')), count(*) FILTER (ext = 'css')]) AS files FROM files) SELECT * FROM c WHERE files > 0""")
def stack(spark, sf_dir):
    c = F.col("content")
    return product.stack(files(spark, sf_dir), {"markup": c.contains("<html"), "scripts": c.contains("<script"), "navigation": c.contains("<nav"), "styles": paths.extension(F.col("path")) == "css"})


@query("p21_services", "SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['Stripe'] WHEN 1 THEN ['Redis', 'Sentry'] ELSE []::VARCHAR[] END) AS service, count(*) AS n FROM documents GROUP BY 1")
def services(spark, sf_dir):
    word = F.when(F.col("doc_id") % 4 == 0, " use stripe now").when(F.col("doc_id") % 4 == 1, " (redis) sentry.io").otherwise(" stripes rediscovered")
    return table(spark, sf_dir, "documents").select(F.explode(product.services(F.concat("text", word))).alias("service")).groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("p29_p30_packages", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'npm' WHEN 'SMALL' THEN 'PyPI' ELSE p_type END AS ecosystem, CASE WHEN p_size > 40 THEN 'risk' WHEN p_size > 20 THEN 'attention' ELSE 'info' END AS severity, count(*) AS n FROM part GROUP BY ALL")
def packages(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "Node").when(F.col("p_type") == "SMALL", "python").otherwise(F.col("p_type"))
    vendor = F.when(F.col("p_size") > 40, "Critical").when(F.col("p_size") > 20, "MODERATE").otherwise("low")
    return table(spark, sf_dir, "part").groupBy(paths.ecosystem(kind).alias("ecosystem"), labels.vendor_severity(vendor).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("p31_p32_addresses", "SELECT 'https://github.com/' || o_orderstatus || '/' || o_custkey || '.git' AS repository, 'POST' AS method, '/orders/' || o_custkey AS path, count(*) AS n FROM orders GROUP BY ALL")
def addresses(spark, sf_dir):
    url = F.concat(F.lit(" https://GitHub.com/"), "o_orderstatus", F.lit("/"), F.col("o_custkey").cast("string"), F.lit("/"))
    route = paths.split_route(F.concat(F.lit("post  /orders/"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(paths.repository_url(url).alias("repository"), route["method"].alias("method"), route["path"].alias("path")).groupBy("repository", "method", "path").agg(F.count(F.lit(1)).alias("n"))


@query("p4_p5_imports_symbols", "SELECT doc_id, './' || source || ',' || lang AS imports, 'A' || doc_id || ',run' AS names FROM documents")
def imports(spark, sf_dir):
    code = F.concat(F.lit("import x from './"), "source", F.lit("'\nconst y = require('"), "lang", F.lit("')\nexport class A"), F.col("doc_id").cast("string"), F.lit(" {}\nfunction run() {}\nfunction run() {}"))
    path = F.lit("a.ts")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.imports(path, code), ",").alias("imports"), F.array_join(text.symbols(path, code), ",").alias("names"))


@query("f12_filtered_graph", f"WITH {EDGES_SQL}, {SYMBOLS_SQL}, v AS (SELECT id FROM symbols WHERE type = 'class' AND confidence <> 'low') SELECT edge_id FROM edges WHERE confidence <> 'low' AND source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)")
def filtered(spark, sf_dir):
    nodes = symbols(spark, sf_dir).filter((F.col("type") == "class") & (F.col("confidence") != "low"))
    return graph.induced(edges(spark, sf_dir).filter("confidence != 'low'"), nodes).select("edge_id")


@query("j2_left_enrichment", "SELECT c.c_custkey, n.n_name, l.quality FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = c.c_custkey")
def left_joins(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(marks, F.col("c_custkey") == F.col("doc_id"), "left").select("c_custkey", "n_name", "quality")


@query("j9_unique_names", f"WITH {SYMBOLS_SQL}, u AS (SELECT name, min(id) AS id FROM symbols WHERE type <> 'table' GROUP BY name HAVING count(*) = 1) SELECT s.id, u.id AS target FROM symbols s JOIN u ON s.name = u.name")
def unique_names(spark, sf_dir):
    s = symbols(spark, sf_dir)
    only = s.filter("type != 'table'").groupBy("name").agg(F.min("id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return s.join(only, "name").select("id", "target")


@query("j18_j19_remap_update", f"WITH {EDGES_SQL}, m AS (SELECT p_partkey AS old, p_partkey * 10 AS new FROM part WHERE p_size > 25) SELECT e.edge_id, coalesce(a.new, e.source) AS source, coalesce(b.new, e.target) AS target FROM edges e LEFT JOIN m a ON e.source = a.old LEFT JOIN m b ON e.target = b.old")
def remap(spark, sf_dir):
    m = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") * 10).alias("new"))
    e = edges(spark, sf_dir)
    met = e.join(m.select(F.col("old").alias("source"), F.col("new").alias("s")), "source", "left").join(m.select(F.col("old").alias("target"), F.col("new").alias("t")), "target", "left")
    return met.select("edge_id", F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"))


@query("a10_feature_catalog", "WITH x AS (SELECT doc_id, unnest(CASE WHEN text LIKE '%ing%' THEN [lang, 'ing'] ELSE [lang] END) AS label FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k FROM x) SELECT label, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 8) AS evidence FROM r GROUP BY label")
def catalog(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.when(F.col("text").contains("ing"), F.array("lang", F.lit("ing"))).otherwise(F.array("lang"))).alias("label"))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # the first eight of each label: first of each run of ids, so that no window holds a whole label
    near = W.partitionBy("label", F.col("doc_id") % 64).orderBy("doc_id")
    some = labelled.withColumn("k", F.row_number().over(near)).filter("k <= 8").groupBy("label").agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 8).alias("ids"))
    return counts.join(some, "label").select("label", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("evidence"))


@query("a15_security_groups", "SELECT CASE event_type WHEN 'error' THEN 'secrets' WHEN 'purchase' THEN 'vulnerable packages' ELSE 'other' END AS bucket, count(*) FILTER (value > 50) AS confirmed, count(*) FILTER (value <= 50) AS review FROM events GROUP BY 1")
def security_groups(spark, sf_dir):
    bucket = F.when(F.col("event_type") == "error", "secrets").when(F.col("event_type") == "purchase", "vulnerable packages").otherwise("other")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("value") > 50).alias("confirmed"), F.count_if(F.col("value") <= 50).alias("review"))


@query("a19_a20_a22_run_totals", f"WITH {SYMBOLS_SQL} SELECT count(DISTINCT path) AS files_with_symbols, count(*) FILTER (confidence = 'low') AS weak, max(CASE WHEN size > 49 THEN 1 ELSE 0 END) AS limited FROM symbols")
def run_totals(spark, sf_dir):
    return symbols(spark, sf_dir).agg(F.countDistinct("path").alias("files_with_symbols"), F.count_if(F.col("confidence") == "low").alias("weak"), F.max(F.when(F.col("size") > 49, 1).otherwise(0)).alias("limited"))


@query("t9_t10_prompt_evidence", f"WITH {FILES_SQL} SELECT page_id, (CASE WHEN regexp_matches(path, '^(app|api|routes)/') THEN 0 ELSE 20 END + CASE WHEN ext IN ('md', '') THEN 20 ELSE 0 END)::BIGINT AS score FROM files ORDER BY score, path LIMIT 8")
def prompt_evidence(spark, sf_dir):
    path = F.col("path")
    score = F.when(path.rlike("^(app|api|routes)/"), 0).otherwise(20) + F.when(paths.extension(path).isin("md", ""), 20).otherwise(0)
    return files(spark, sf_dir).select("page_id", score.cast("long").alias("score"), "path").orderBy("score", "path").limit(8).select("page_id", "score")


@query("t12_e8_compaction", f"WITH {EDGES_SQL}, {SYMBOLS_SQL}, k AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY type ORDER BY id) AS n FROM symbols) WHERE n <= 100) SELECT edge_id FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def compaction(spark, sf_dir):
    """A budget of symbols for each kind, then the edges among those kept."""
    # the first of each run of ids, then the first of those: no window holds a whole kind
    near = W.partitionBy("type", F.col("id") % 64).orderBy("id")
    some = symbols(spark, sf_dir).select("type", "id").withColumn("k", F.row_number().over(near)).filter("k <= 100")
    kept = some.withColumn("n", F.row_number().over(W.partitionBy("type").orderBy("id"))).filter("n <= 100")
    return graph.induced(edges(spark, sf_dir), kept).select("edge_id")


@query("e10_incremental_gate", "SELECT count(*) AS changed, (SELECT count(*) FROM part) AS files, count(*) <= 100 AND count(*) <= 0.3 * (SELECT count(*) FROM part) AS eligible FROM part WHERE p_size = 7")
def gate(spark, sf_dir):
    counts = table(spark, sf_dir, "part").agg(F.count_if(F.col("p_size") == 7).alias("changed"), F.count(F.lit(1)).alias("files"))
    return counts.withColumn("eligible", (F.col("changed") <= 100) & (F.col("changed") <= 0.3 * F.col("files")))


@query("e13_table_keys", f"WITH {SYMBOLS_SQL} SELECT lower(name) AS name, min(id) AS key FROM symbols WHERE type = 'table' GROUP BY 1")
def table_keys(spark, sf_dir):
    return symbols(spark, sf_dir).filter("type = 'table'").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("key"))


@query("e15_route_effects", f"WITH {EDGES_SQL}, {SYMBOLS_SQL} SELECT r.id, string_agg(DISTINCT e.type || ':' || t.type, ',' ORDER BY e.type || ':' || t.type) AS effects FROM symbols r JOIN edges e ON e.source = r.id JOIN symbols t ON t.id = e.target WHERE r.type = 'route' GROUP BY 1")
def route_effects(spark, sf_dir):
    s = symbols(spark, sf_dir)
    met = s.filter("type = 'route'").select("id").join(edges(spark, sf_dir).withColumnRenamed("type", "edge"), F.col("id") == F.col("source")).join(s.select(F.col("id").alias("target"), "type"), "target")
    return met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "edge", "type"))), ",").alias("effects"))


@query("e16_static_findings", """SELECT 'duplicate_content' AS type, count(*) AS n FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'large_file', count(*) FROM documents WHERE length(text) - length(replace(text, chr(10), '')) + 1 > 30
 UNION ALL SELECT 'implementation_notes', count(*) FROM documents WHERE (length(text) - length(replace(text, 'GNU', ''))) // 3 >= 1""")
def static_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    same = findings.duplicate_content(docs.select("doc_id", F.sha2("text", 256).alias("digest"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_content").alias("type"), "n")
    big = docs.filter(text.line_count(F.col("text")) > 30).agg(F.count(F.lit(1)).alias("n")).select(F.lit("large_file").alias("type"), "n")
    notes = docs.filter(findings.occurrences(F.col("text"), "GNU") >= 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("implementation_notes").alias("type"), "n")
    return same.union(big).union(notes)


@query("p23_e19_semantic_delta", """WITH f AS (SELECT DISTINCT conv_id, turn, role || '|' || (length(text) % 10) AS fact FROM conversations), b AS (SELECT DISTINCT conv_id, fact FROM f WHERE turn % 2 = 0), a AS (SELECT DISTINCT conv_id, fact FROM f WHERE turn % 2 = 1)
 SELECT conv_id, fact, 'removed' AS change FROM b WHERE (conv_id, fact) NOT IN (SELECT (conv_id, fact) FROM a) UNION ALL SELECT conv_id, fact, 'added' FROM a WHERE (conv_id, fact) NOT IN (SELECT (conv_id, fact) FROM b)""")
def semantic_delta(spark, sf_dir):
    fact = F.concat_ws("|", "role", (F.length("text") % 10).cast("string"))
    facts = table(spark, sf_dir, "conversations").select("conv_id", "turn", fact.alias("fact"))
    before, after = (facts.filter(F.col("turn") % 2 == k).select("conv_id", "fact").distinct() for k in (0, 1))
    return relational.delta(before.withColumn("v", F.lit(1)), after.withColumn("v", F.lit(1)), ["conv_id", "fact"], "v").select("conv_id", "fact", "change")


@query("e27_e29_path_impact", f"""WITH {EDGES_SQL}, {SYMBOLS_SQL}, own AS (SELECT id FROM symbols WHERE path IN (SELECT path FROM symbols WHERE size = 7 AND id < 100)), b AS (SELECT DISTINCT source AS id FROM edges WHERE confidence IN ('high', 'medium') AND target IN (SELECT id FROM own))
 SELECT id, 'changed' AS touch FROM own UNION ALL SELECT id, 'dependent' FROM b WHERE id NOT IN (SELECT id FROM own)""")
def path_impact(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return product.impact(edges(spark, sf_dir), s, s.filter("size = 7 and id < 100").select("path"))


@query("e27_e29_path_impact_all", f"""WITH {EDGES_SQL}, {SYMBOLS_SQL}, own AS (SELECT id FROM symbols WHERE path IN (SELECT path FROM symbols WHERE size = 7)), b AS (SELECT DISTINCT source AS id FROM edges WHERE confidence IN ('high', 'medium') AND target IN (SELECT id FROM own))
 SELECT id, 'changed' AS touch FROM own UNION ALL SELECT id, 'dependent' FROM b WHERE id NOT IN (SELECT id FROM own)""")
def path_impact_all(spark, sf_dir):
    """Changed are the paths of all rows of size 7, so that they grow with the table."""
    s = symbols(spark, sf_dir)
    return product.impact(edges(spark, sf_dir), s, s.filter("size = 7").select("path"))


@query("e31_overview", "SELECT (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM events WHERE event_type = 'error') AS findings, (SELECT max(event_id) FROM events) AS latest_run, (SELECT count(DISTINCT source) FROM documents) AS systems")
def overview(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    e = t("events").agg(F.count_if(F.col("event_type") == "error").alias("findings"), F.max("event_id").alias("latest_run"))
    return t("part").agg(F.count(F.lit(1)).alias("symbols")).crossJoin(e).crossJoin(t("documents").agg(F.countDistinct("source").alias("systems")))


@query("e32_g14_deletion", f"""WITH {EDGES_SQL}, {SYMBOLS_SQL}, d AS (SELECT target AS id, count(DISTINCT source) AS n FROM edges WHERE source <> target GROUP BY 1), t AS (SELECT e.target AS id, count(DISTINCT f.source) AS n FROM edges e JOIN edges f ON f.target = e.source AND f.source <> e.target GROUP BY 1)
 SELECT s.id, CASE WHEN coalesce(d.n, 0) > 0 OR s.type = 'table' THEN 'confirmed' WHEN coalesce(t.n, 0) > 0 THEN 'possible' ELSE 'none found' END AS assessment FROM symbols s LEFT JOIN d USING (id) LEFT JOIN t USING (id)""")
def deletion(spark, sf_dir):
    e = edges(spark, sf_dir).select("source", "target")
    direct = e.filter("source != target").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("d"))
    second = e.select(F.col("source").alias("mid"), F.col("target").alias("id")).join(e.select(F.col("source").alias("far"), F.col("target").alias("mid")), "mid").filter("far != id").groupBy("id").agg(F.countDistinct("far").alias("t"))
    met = symbols(spark, sf_dir).join(direct, "id", "left").join(second, "id", "left")
    return met.select("id", product.deletion(F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0)), F.col("type") == "table").alias("assessment"))


@query("e33_lessons", "SELECT 'lesson-' || lower(event_type) AS lesson, count(*) AS steps FROM events GROUP BY event_type HAVING count(*) > 3")
def lessons(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("steps")).filter("steps > 3")
    return by.select(F.concat(F.lit("lesson-"), F.lower("event_type")).alias("lesson"), "steps")


@query("e34_admin_lists", "SELECT c.c_custkey, c.c_name, coalesce(o.n, 0) AS projects, o.latest FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS latest FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey WHERE lower(c.c_name) LIKE '%1%' ORDER BY c.c_custkey LIMIT 100")
def admin_lists(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("latest"))
    met = table(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%1%")).join(by, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("projects"), "latest").orderBy("c_custkey").limit(100)


@query("g3_alias_search", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text || ' ' || source), '(^|[^a-z])(src1|src)') OR contains(lower(text), 'src1 ing')")
def alias_search(spark, sf_dir):
    needles = product.aliases(F.lit("src1 ing"))
    both = F.lower(F.concat_ws(" ", "text", "source"))
    return table(spark, sf_dir, "documents").filter(F.exists(F.filter(needles, lambda n: n.startswith("src")), lambda n: both.contains(F.split(F.lower(n), " ")[0])) | both.rlike("(^|[^a-z])src")).select("doc_id")


@query("g6_neighbours", f"WITH {EDGES_SQL}, {SYMBOLS_SQL} SELECT e.edge_id, a.name AS source_name, b.name AS target_name, b.path AS target_path FROM edges e LEFT JOIN symbols a ON e.source = a.id LEFT JOIN symbols b ON e.target = b.id")
def neighbours(spark, sf_dir):
    s = symbols(spark, sf_dir)
    one, two = s.select(F.col("id").alias("source"), F.col("name").alias("source_name")), s.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("path").alias("target_path"))
    return edges(spark, sf_dir).join(one, "source", "left").join(two, "target", "left").select("edge_id", "source_name", "target_name", "target_path")


@query("g10_drill_down", f"WITH {SYMBOLS_SQL} SELECT type, count(*) AS n FROM symbols WHERE path = (SELECT min(path) FROM symbols) GROUP BY 1")
def drill(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return s.join(s.agg(F.min("path").alias("path")), "path").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("w2_claim_order", "SELECT user_id, min(event_id) AS claimed FROM events WHERE event_type = 'click' GROUP BY 1")
def claims(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("claimed"))


@query("s17_w8_w9_cache", "WITH k AS (SELECT o_custkey AS cache_key, max(o_orderdate) AS saved_at FROM orders GROUP BY 1), r AS (SELECT c_custkey AS cache_key FROM customer) SELECT CASE WHEN k.saved_at > (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM r LEFT JOIN k USING (cache_key) GROUP BY 1")
def cache(spark, sf_dir):
    """Kept results no older than seven days answer; others are misses."""
    orders = table(spark, sf_dir, "orders")
    kept = orders.groupBy(F.col("o_custkey").alias("cache_key")).agg(F.max("o_orderdate").alias("saved_at"))
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    hits, misses = snapshots.cache_split(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cache_key")), kept, now)
    return hits.select(F.lit("hit").alias("outcome")).union(misses.select(F.lit("miss").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s13_s20_json_records", "SELECT n_nationkey, n_name FROM nation")
def json_records(spark, sf_dir):
    """Rows out as JSON arrays of records and in again."""
    rows = table(spark, sf_dir, "nation")
    arrays = rows.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("json"))
    return snapshots.read_records(spark, arrays, "n_nationkey:int, n_name:string")


@query("s13_s20_event_records", "SELECT event_id, event_type, value FROM events")
def event_records(spark, sf_dir):
    """Events out as JSON arrays of a hundred records at most and in again."""
    arrays = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100)).agg(F.to_json(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("json"))
    return snapshots.read_records(spark, arrays, "event_id:bigint, event_type:string, value:double")


@query("s16_upsert_customers", """WITH c AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY 1)
 SELECT k, status, amount FROM c UNION ALL SELECT c_custkey, 'none', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)""")
def upsert_customers(spark, sf_dir):
    """Orders applied in order to a table of customers: a key's last change wins, keys without one stay."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("none").alias("status"), F.col("c_acctbal").alias("amount"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), "o_orderkey")
    return snapshots.upsert(current, changes, ["k"], "o_orderkey").select("k", "status", "amount")


@query("g8_top_degree_subgraph", f"""WITH {EDGES_SQL}, ends AS (SELECT source AS id, edge_id FROM edges UNION SELECT target, edge_id FROM edges), top AS (SELECT id FROM ends GROUP BY id ORDER BY count(*) DESC, id LIMIT 500)
 SELECT edge_id, source, target FROM edges WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top) ORDER BY edge_id LIMIT 700""")
def top_degree_subgraph(spark, sf_dir):
    """The edges among the nodes of most edges, 700 at most."""
    e = edges(spark, sf_dir)
    top = graph.degrees(e).orderBy(F.desc("degree"), "id").limit(500)
    return graph.induced(e, top).select("edge_id", "source", "target").orderBy("edge_id").limit(700)


@query("e2_finding_fusion", """WITH f AS (SELECT 'p' || l_partkey AS path, l_linenumber AS line, l_returnflag AS type, l_linestatus AS rule, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS s, l_suppkey % 3 AS engine FROM lineitem)
 SELECT path, line, type, list_extract(['info', 'attention', 'risk'], max(s) + 1) AS severity, string_agg(DISTINCT 'e' || engine, ',' ORDER BY 'e' || engine) AS engines, CASE WHEN count(DISTINCT engine) > 1 THEN 'confirmed' ELSE 'single source' END AS label FROM f GROUP BY path, line, type, rule""")
def finding_fusion(spark, sf_dir):
    """Findings that several engines report at one place for one rule, as one."""
    severity = F.when(F.col("l_quantity") > 40, "risk").when(F.col("l_quantity") > 20, "attention").otherwise("info")
    engine = F.concat(F.lit("e"), (F.col("l_suppkey") % 3).cast("string"))
    reported = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("rule"),
        F.col("l_linestatus").alias("title"), severity.alias("severity"), engine.alias("engine"), (F.col("l_suppkey") % 3).alias("engine_ord"), F.col("l_orderkey").alias("fact_ord"),
    )
    return fusion.fuse_findings(reported).select("path", "line", "type", "severity", F.array_join("engines", ",").alias("engines"), "label")


@query("s15_s18_publication", """WITH s AS (SELECT p_partkey AS id, p_size % 10 AS project_id, p_name AS name FROM part)
 SELECT project_id, id, CASE WHEN project_id % 3 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN project_id % 3 = 0 THEN 2 ELSE 1 END AS runs FROM s WHERE project_id <> 6 AND (project_id % 3 <> 0 OR id % 2 = 0)""")
def publication(spark, sf_dir):
    """Symbols and runs of ten projects published, every third project published anew with half of its symbols under other
    names, project 6 with none; read back through the manifest, with the number of runs that each project's history has."""
    folder = snapshots.shared_folder(spark, "publication")
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).cast("long").alias("project_id"), F.col("p_name").alias("name"))
    third = symbols.filter("project_id % 3 = 0")
    anew = third.filter("project_id != 6 and id % 2 = 0").withColumn("name", F.concat("name", F.lit("!")))
    snapshots.begin(spark, f"{folder}/graph")
    for run, (rows, projects) in enumerate(((symbols, symbols), (anew, third))):
        totals = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("symbols"))
        snapshots.publish({"symbols": rows, "totals": totals}, projects.select("project_id"), f"{folder}/graph")
        snapshots.append_run(totals.withColumn("scan_run_id", F.lit(run)), f"{folder}/history")
    runs = spark.read.parquet(f"{folder}/history").groupBy("project_id").agg(F.count(F.lit(1)).alias("runs"))
    held = snapshots.current(spark, f"{folder}/graph", "totals").select("project_id")
    return snapshots.current(spark, f"{folder}/graph", "symbols").join(held, "project_id", "left_semi").join(runs, "project_id").select("project_id", "id", "name", "runs")
