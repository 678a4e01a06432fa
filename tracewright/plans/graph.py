"""Queries over symbol graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import labels
from tracewright.operators import fusion, graph
from tracewright.plans.base import EDGES_SQL, SYMBOLS_SQL, edges, query, symbols, table

_ROOT = 42


@query("g4_a3_transitive_min_depth", f"""WITH RECURSIVE {EDGES_SQL}, walk(node, depth, visited) AS (SELECT source, 1, [source] FROM edges WHERE target = {_ROOT} UNION ALL
 SELECT e.source, w.depth + 1, list_append(w.visited, e.source) FROM walk w JOIN edges e ON e.target = w.node WHERE w.depth < 8 AND NOT list_contains(w.visited, e.source)) SELECT node, min(depth) AS depth FROM walk WHERE depth >= 2 GROUP BY node""")
def transitive(spark, sf_dir):
    return graph.transitive(edges(spark, sf_dir), _ROOT)


_SEEDS = "seeds AS (SELECT p_partkey AS seed FROM part WHERE p_size = 50)"


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size = 50").select(F.col("p_partkey").alias("seed"))


_BACK = f"""WITH RECURSIVE {EDGES_SQL}, {SYMBOLS_SQL}, {_SEEDS}, used AS (SELECT * FROM edges WHERE confidence IN ('high', 'medium')),
 walk(seed, node, depth) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, e.source, w.depth + 1 FROM walk w JOIN used e ON e.target = w.node WHERE w.depth < 6),
 seen AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL)"""


@query("g1_blast_radius", _BACK + """, ahead AS (SELECT DISTINCT s.seed, e.target AS id FROM seen s JOIN used e ON e.source = s.node),
 o AS (SELECT seed, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'external_service') AS services FROM ahead JOIN symbols USING (id) GROUP BY 1),
 i AS (SELECT seed, count(*) FILTER (depth > 0) AS dependents, count(*) FILTER (depth = 1) AS direct, max(depth) AS depth FROM seen GROUP BY 1), c AS (SELECT i.*, coalesce(tables, 0) AS tables, coalesce(services, 0) AS services FROM i LEFT JOIN o USING (seed))
 SELECT *, dependents + 3 * tables + 2 * services AS score, CASE WHEN dependents + 3 * tables + 2 * services >= 15 THEN 'high' WHEN dependents + 3 * tables + 2 * services >= 5 THEN 'medium' ELSE 'low' END AS risk FROM c""")
def blast(spark, sf_dir):
    return graph.blast(edges(spark, sf_dir), symbols(spark, sf_dir), _seeds(spark, sf_dir))


@query("g2_forward_trace", f"""WITH RECURSIVE {EDGES_SQL}, {_SEEDS}, used AS (SELECT * FROM edges WHERE confidence IN ('high', 'medium')),
 walk(seed, node, depth) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, e.target, w.depth + 1 FROM walk w JOIN used e ON e.source = w.node WHERE w.depth < 4),
 seen AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL) SELECT seed, edge_id, source, target, type, depth + 1 AS hop FROM seen JOIN used ON node = source""")
def trace(spark, sf_dir):
    return graph.trace(edges(spark, sf_dir), _seeds(spark, sf_dir))


@query("g11_neighbourhood", f"""WITH RECURSIVE {EDGES_SQL}, {_SEEDS}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
 walk(seed, node, depth) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, b, w.depth + 1 FROM walk w JOIN both_ways ON a = w.node WHERE w.depth < 3) SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL""")
def neighbourhood(spark, sf_dir):
    return graph.reach(edges(spark, sf_dir), _seeds(spark, sf_dir), 3, both=True)


@query("g5_descendants", """WITH RECURSIVE walk(seed, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey IN (1, 2, 3) UNION SELECT seed, p_partkey FROM walk JOIN part ON p_partkey > 3 AND p_partkey // 3 = node) SELECT seed, node FROM walk""")
def descendants(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    return graph.descendants(part.filter("id > 3"), part.filter("id in (1, 2, 3)").select(F.col("id").alias("seed")))


@query("g7_t4_degrees", f"""WITH {EDGES_SQL}, ends AS (SELECT source AS id, edge_id FROM edges UNION SELECT target, edge_id FROM edges)
 SELECT id, (SELECT count(*) FROM edges e WHERE e.target = d.id) AS in_degree, (SELECT count(*) FROM edges e WHERE e.source = d.id) AS out_degree, count(*) AS degree FROM ends d GROUP BY id ORDER BY degree DESC, id LIMIT 300""")
def degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(300)


@query("g8_j7_induced_subgraph", f"""WITH {EDGES_SQL}, {SYMBOLS_SQL}, top AS (SELECT id FROM symbols WHERE type IN ('class', 'method', 'table')) SELECT edge_id, source, target FROM edges WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top) AND confidence IN ('high', 'medium')""")
def induced(spark, sf_dir):
    nodes = symbols(spark, sf_dir).filter(F.col("type").isin("class", "method", "table"))
    return graph.induced(graph.confident(edges(spark, sf_dir)), nodes).select("edge_id", "source", "target")


_SEM = "CASE WHEN type = 'route' THEN 'request' WHEN type = 'table' THEN 'data' WHEN type = 'external_service' THEN 'external' WHEN type = 'component' THEN 'interface' ELSE 'code' END"


@query("g9_a12_level_of_detail", f"""WITH {SYMBOLS_SQL}, n AS (SELECT path AS grp, confidence, CASE WHEN type IN ('route', 'table', 'external_service') THEN 'medium' ELSE 'low' END AS risk, {_SEM} AS semantic FROM symbols),
 m AS (SELECT grp, semantic, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, CASE semantic WHEN 'external' THEN 5 WHEN 'data' THEN 4 WHEN 'request' THEN 3 WHEN 'interface' THEN 1 ELSE 0 END DESC) AS k FROM n GROUP BY grp, semantic)
 SELECT n.grp, count(*) AS size, CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, max(risk) AS risk, any_value(m.semantic) AS semantic FROM n JOIN m ON n.grp = m.grp AND m.k = 1 GROUP BY n.grp""")
def level_of_detail(spark, sf_dir):
    s = symbols(spark, sf_dir)
    nodes = s.withColumn("semantic", labels.semantic(F.col("type"), F.col("name"), F.col("path"))).withColumn("risk", labels.risk(F.col("type"), F.col("name"), F.col("path")))
    return graph.roll_up_nodes(nodes, F.col("path"))


@query("a13_edge_roll_up", f"""WITH {EDGES_SQL}, {SYMBOLS_SQL} SELECT a.path AS source_group, b.path AS target_group, e.type, count(*) AS n, CASE max(CASE e.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence
 FROM edges e JOIN symbols a ON e.source = a.id JOIN symbols b ON e.target = b.id WHERE a.path <> b.path GROUP BY ALL""")
def edge_roll_up(spark, sf_dir):
    return graph.roll_up_edges(edges(spark, sf_dir), symbols(spark, sf_dir), F.col("path"))


@query("g12_shortest_paths", f"""WITH RECURSIVE {EDGES_SQL}, u AS (SELECT source AS a, target AS b, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 5 END AS w FROM edges UNION SELECT target, source, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 5 END FROM edges),
 d(node, distance) AS (SELECT {_ROOT}, 0 UNION SELECT u.b, d.distance + u.w FROM d JOIN u ON u.a = d.node WHERE d.distance + u.w <= 12) SELECT node::BIGINT AS node, min(distance)::BIGINT AS distance FROM d GROUP BY node""")
def shortest(spark, sf_dir):
    """Distances up to 12 from one node."""
    return graph.distances(edges(spark, sf_dir), _ROOT, 12)


@query("g12_shortest_paths_all")
def shortest_all(spark, sf_dir):
    """Distances of all nodes that can be reached, to the fix point; without SQL (a recursion without a bound goes round
    cycles for ever), tested by brute force."""
    return graph.distances(edges(spark, sf_dir), _ROOT)


@query("g13_both_ends", f"WITH {EDGES_SQL} SELECT edge_id, CASE WHEN source = {_ROOT} THEN target ELSE source END AS other FROM edges WHERE source = {_ROOT} OR target = {_ROOT}")
def both_ends(spark, sf_dir):
    other = F.when(F.col("source") == _ROOT, F.col("target")).otherwise(F.col("source"))
    return edges(spark, sf_dir).filter((F.col("source") == _ROOT) | (F.col("target") == _ROOT)).select("edge_id", other.alias("other"))


@query("e30_table_operations", f"WITH {EDGES_SQL}, {SYMBOLS_SQL} SELECT t.name AS table_name, e.type, count(*) AS n FROM edges e JOIN symbols t ON e.target = t.id WHERE t.type = 'table' AND e.type = 'reads_table' GROUP BY ALL")
def table_operations(spark, sf_dir):
    tables = symbols(spark, sf_dir).filter("type = 'table'").select("id", F.col("name").alias("table_name"))
    used = edges(spark, sf_dir).filter(F.col("type").isin("reads_table", "creates_in_table", "updates_table", "deletes_from_table", "defines_table"))
    return used.join(tables, F.col("target") == F.col("id")).groupBy("table_name", "type").agg(F.count(F.lit(1)).alias("n"))


@query("j8_name_resolution", f"""WITH {SYMBOLS_SQL}, asked AS (SELECT p_partkey AS edge_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand || '.' || p_name) WHEN 1 THEN 'lib.' || p_brand || ' ' || p_name ELSE p_name END AS name FROM part),
 q AS (SELECT lower(qualified_name) AS k, count(*) AS n, min(id) AS id FROM symbols GROUP BY 1), m AS (SELECT lower(name) AS k, count(*) AS n, min(id) AS id FROM symbols GROUP BY 1)
 SELECT edge_id, CASE WHEN q.n IS NOT NULL THEN CASE WHEN q.n = 1 THEN q.id END WHEN m.n IS NOT NULL THEN CASE WHEN m.n = 1 THEN m.id END WHEN s.n = 1 THEN s.id END AS resolved
 FROM asked a LEFT JOIN q ON q.k = lower(a.name) LEFT JOIN m ON m.k = lower(a.name) LEFT JOIN m s ON s.k = list_extract(string_split(lower(a.name), '.'), -1)""")
def name_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    third = F.col("p_partkey") % 3
    name = F.when(third == 0, F.upper(F.concat_ws(".", "p_brand", "p_name"))).when(third == 1, F.concat(F.lit("lib."), F.col("p_brand"), F.lit(" "), F.col("p_name"))).otherwise(F.col("p_name"))
    return fusion.resolve_names(part.select(F.col("p_partkey").alias("edge_id"), name.alias("name")), symbols(spark, sf_dir)).select("edge_id", "resolved")


# Engines: the same parts as three engines see them, in other cases and with other confidence.


def facts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    engines = (("native", 0, 3, "p_name"), ("tree-sitter", 1, 1, "p_name"), ("ctags", 2, 2, "upper(p_name)"))
    out = None
    for engine, ordinal, m, name in engines:
        confidence = F.element_at(F.array(*map(F.lit, labels.CONFIDENCES)), ((F.col("p_partkey") + ordinal) % 3 + 1).cast("int"))
        one = part.filter(F.col("p_partkey") % m == 0).select(
            F.lit(engine).alias("engine"), F.lit(ordinal).alias("engine_ord"), F.col("p_partkey").alias("fact_ord"), F.lit("success").alias("status"), F.col("p_partkey").cast("string").alias("key"), F.lit("PHP").alias("language"),
            F.concat(F.lit("src/"), F.col("p_type")).alias("path"), F.expr(name).alias("name"), F.expr(f"concat(p_brand, '.', {name})").alias("qualified_name"), F.lit("class").alias("type"), F.col("p_size").alias("start_line"),
            F.col("p_size").alias("end_line"), confidence.alias("confidence"), F.lit(False).alias("documentation"),
        )
        out = one if out is None else out.unionByName(one)
    return out


FACTS_SQL = """facts AS (SELECT engine, o AS engine_ord, p_partkey AS fact_ord, 'src/' || p_type AS path, CASE WHEN engine = 'ctags' THEN upper(p_name) ELSE p_name END AS name, p_brand, p_size,
 list_extract(['low', 'medium', 'high'], ((p_partkey + o) % 3 + 1)::INT) AS confidence, CASE engine WHEN 'native' THEN 66 WHEN 'tree-sitter' THEN 88 ELSE 52 END AS rank FROM part, (VALUES ('native', 0, 3), ('tree-sitter', 1, 1), ('ctags', 2, 2)) v(engine, o, m) WHERE p_partkey % m = 0),
 ided AS (SELECT *, sha256(lower('PHP|' || path || '|' || p_brand || '.' || name || '|class|' || p_size || '|' || p_size)) AS identity, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS c,
 CASE WHEN rank + (CASE confidence WHEN 'high' THEN 8 WHEN 'low' THEN -12 ELSE 0 END) >= 76 THEN 3 WHEN rank + (CASE confidence WHEN 'high' THEN 8 WHEN 'low' THEN -12 ELSE 0 END) >= 48 THEN 2 ELSE 1 END AS alone FROM facts)"""


@query("e1_e6_symbol_fusion", f"""WITH {FACTS_SQL} SELECT identity, arg_min(name, engine_ord * 1000000000 + fact_ord) AS name, CASE max(c) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, count(*) AS facts,
 CASE WHEN count(DISTINCT engine) > 1 AND max(c) > 1 THEN 'confirmed' WHEN max(alone) = 3 THEN 'strong' WHEN max(alone) = 2 THEN 'likely' ELSE 'heuristic' END AS label FROM ided GROUP BY identity""")
def symbol_fusion(spark, sf_dir):
    return fusion.fuse_symbols(facts(spark, sf_dir)).select("identity", "name", "confidence", F.array_join("engines", ",").alias("engines"), "facts", "label")


@query("e7_disagreements", f"""WITH {FACTS_SQL}, l AS (SELECT *, sha256(lower(path || '|' || p_size || '|class|' || name)) AS fact, row_number() OVER (PARTITION BY sha256(lower(path || '|' || p_size || '|class|' || name)), engine ORDER BY fact_ord DESC) AS n FROM facts)
 SELECT fact, count(*) AS engines, count(DISTINCT confidence) AS confidences, string_agg(DISTINCT engine || ':' || confidence, ',' ORDER BY engine || ':' || confidence) AS says FROM l WHERE n = 1 GROUP BY fact HAVING count(*) > 1 AND count(DISTINCT confidence) > 1""")
def disagreements(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("external_name", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("string"))
    return fusion.disagreements(rows).select("fact", "engines", "confidences", "says")


@query("e4_relationship_fusion", f"""WITH {FACTS_SQL} SELECT sha256(lower('||' || name || '|class|' || path || '|' || p_size)) AS identity, count(*) AS facts, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines FROM facts GROUP BY 1""")
def relationship_fusion(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("external_name", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("string"))
    return fusion.fuse_relationships(rows).select("identity", "facts", F.array_join("engines", ",").alias("engines"))


@query("e5_route_fusion", f"""WITH {FACTS_SQL} SELECT sha256(lower(path || '|GET|/' || name || '|' || p_size)) AS identity, count(*) AS facts, min(engine_ord)::BIGINT AS first_engine FROM facts GROUP BY 1""")
def route_fusion(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("method", F.lit("GET")).withColumn("route", F.concat(F.lit("/"), F.col("name")))
    found = fusion.fuse_routes(rows)
    first = F.when(F.array_contains("engines", "native"), 0).when(F.array_contains("engines", "tree-sitter"), 1).otherwise(2)
    return found.select("identity", "facts", first.cast("long").alias("first_engine"))


@query("e3_package_fusion", """WITH p AS (SELECT p_partkey, lower('npm|' || p_brand || '|' || p_type) AS identity, list_extract(['detected', 'declared', 'resolved'], (p_size % 3 + 1)::INT) AS class, p_name AS lic FROM part)
 SELECT identity, CASE max(CASE class WHEN 'resolved' THEN 3 WHEN 'declared' THEN 2 ELSE 1 END) WHEN 3 THEN 'resolved' WHEN 2 THEN 'declared' ELSE 'detected' END AS classification, string_agg(DISTINCT lic, ',' ORDER BY lic) AS licenses FROM p GROUP BY 1""")
def package_fusion(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.col("p_type").alias("version"), F.lit(None).cast("string").alias("purl"), F.lit("syft").alias("engine"), F.lit(0).alias("engine_ord"), F.col("p_partkey").alias("fact_ord"),
                       F.element_at(F.array(*map(F.lit, labels.PACKAGE_CLASSES)), (F.col("p_size") % 3 + 1).cast("int")).alias("classification"), F.array("p_name").alias("licenses"), F.array("p_type").alias("locations"))
    return fusion.fuse_packages(rows).select("identity", "classification", F.array_join("licenses", ",").alias("licenses"))


@query("e2_alias_groups", """WITH RECURSIVE a AS (SELECT DISTINCT p_brand AS package, 'id' || (p_partkey % 50) AS x, 'al' || (p_partkey % 20) AS y FROM part), n AS (SELECT package, x AS a, y AS b FROM a UNION SELECT package, y, x FROM a),
 w(package, node, other) AS (SELECT package, a, a FROM n UNION SELECT w.package, w.node, n.b FROM w JOIN n ON n.package = w.package AND n.a = w.other), c AS (SELECT package, node, min(package || '|' || other) AS grp FROM w GROUP BY package, node)
 SELECT a.package, a.x || ',' || a.y AS ids, c.grp FROM a JOIN c ON c.package = a.package AND c.node = a.x""")
def alias_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ids = F.array(F.concat(F.lit("id"), (F.col("p_partkey") % 50).cast("string")), F.concat(F.lit("al"), (F.col("p_partkey") % 20).cast("string")))
    rows = part.select(F.col("p_brand").alias("package"), ids.alias("ids")).distinct()
    return fusion.alias_groups(rows).select("package", F.array_join("ids", ",").alias("ids"), F.col("group").alias("grp"))


@query("e9_e11_incremental", f"""WITH {SYMBOLS_SQL}, changed AS (SELECT DISTINCT path FROM symbols WHERE size = 7), fresh AS (SELECT id, name || '!' AS name, path FROM symbols WHERE path IN (SELECT path FROM changed))
 SELECT id, name, path FROM symbols WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT * FROM fresh""")
def incremental(spark, sf_dir):
    s = symbols(spark, sf_dir)
    changed = s.filter("size = 7").select("path").distinct()
    fresh = s.join(changed, "path", "left_semi").select("id", F.concat("name", F.lit("!")).alias("name"), "path")
    return fusion.incremental(s.select("id", "name", "path"), fresh, changed)


@query("e9_neighbour_paths", f"""WITH {EDGES_SQL}, {SYMBOLS_SQL}, e AS (SELECT a.path AS source_path, b.path AS target_path FROM edges JOIN symbols a ON source = a.id JOIN symbols b ON target = b.id), changed AS (SELECT DISTINCT path FROM symbols WHERE name = 'red ring' AND size < 10)
 SELECT path FROM changed UNION SELECT target_path FROM e WHERE source_path IN (SELECT path FROM changed) UNION SELECT source_path FROM e WHERE target_path IN (SELECT path FROM changed)""")
def neighbour_paths(spark, sf_dir):
    s = symbols(spark, sf_dir)
    one, two = s.select(F.col("id").alias("source"), F.col("path").alias("source_path")), s.select(F.col("id").alias("target"), F.col("path").alias("target_path"))
    return fusion.neighbourhood(edges(spark, sf_dir).join(one, "source").join(two, "target"), s.filter("name = 'red ring' and size < 10").select("path").distinct())


@query("e14_a9_feature_clusters", """WITH h AS (SELECT doc_id, source, f, (text LIKE '%' || w || '%')::INT + (lang || source LIKE '%' || v || '%')::INT AS families FROM documents, (VALUES ('Progress', 'ing', 'en'), ('Nation', 'tion', 'fr'), ('Query', 'que', 'es')) n(f, w, v))
 SELECT f AS feature, count(*) AS members, sum(2 * families)::BIGINT AS score, bool_or(source = 'src1') AS corroborated FROM h WHERE families >= 2 GROUP BY 1""")
def feature_clusters(spark, sf_dir):
    """Families of signals by feature, kept where two agree, clustered with score and corroboration."""
    docs = table(spark, sf_dir, "documents")
    found = [
        F.struct(F.lit(f).alias("feature"), (F.col("text").contains(w).cast("int") + F.concat("lang", "source").contains(v).cast("int")).alias("families"))
        for f, w, v in (("Progress", "ing", "en"), ("Nation", "tion", "fr"), ("Query", "que", "es"))
    ]
    hits = docs.select("source", F.explode(F.array(*found)).alias("h")).select("source", "h.*").filter("families >= 2")
    return hits.groupBy("feature").agg(F.count(F.lit(1)).alias("members"), F.sum(2 * F.col("families")).alias("score"), F.bool_or(F.col("source") == "src1").alias("corroborated"))
