"""Queries on change impact: what targets stand for, what changes touch, how risky they are.

Parts stand for symbols, eight to a file with parents within it; a change is what was done to 24 neighbouring files of
which those with a symbol of size 7 changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.functions import paths
from tracewright.operators import graph, impact
from tracewright.plans.base import EDGES_SQL, edges, query, table
from tracewright.plans.rules import _pick, pick

KINDS = ("class", "method", "function", "table", "external_service", "component", "environment_variable", "module")
FOLDERS = ("src/orders", "src/auth", "app/api", "lib/dataConfig", "web")
VERBS = ("GET", "POST", "DELETE")
#: Kinds and words of the asked targets: exact and part matches, in other cases, with and without a method.
ASKED = (("symbol", "Red Ring"), ("symbol", "brand#3.hot"), ("file", "src\\auth\\F6.ts"), ("file", "app/api/f1"), ("route", "post /r5"), ("route", "/R1"), ("table", "small bolt"), ("table", "no such table"), ("route", "GET /r10"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent, name, qualified_name, type, path, size."""
    part, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    up, file = key - 1 - size % 3, F.floor(key / 8)
    path = F.concat(pick(FOLDERS, file), F.lit("/f"), file.cast("string"), F.lit(".ts"))
    return part.select(key.alias("id"), F.when(up >= file * 8, up).alias("parent"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), pick(KINDS, size).alias("type"), path.alias("path"), size.alias("size"))


def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, route_path, path, handler: every fifth symbol handles a route."""
    s = code_symbols(spark, sf_dir).filter("id % 5 = 0")
    return s.select(pick(VERBS, F.floor(F.col("id") / 5)).alias("method"), F.concat(F.lit("/r"), F.col("id").cast("string")).alias("route_path"), "path", F.col("id").alias("handler"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change, id: the symbols of changed files."""
    s = code_symbols(spark, sf_dir)
    return s.join(s.filter("size = 7").select("path").distinct(), "path", "left_semi").select(F.floor(F.col("id") / 192).alias("change"), "id")


_CODE = f"""{EDGES_SQL}, named AS (SELECT p_partkey AS id, p_partkey - 1 - p_size % 3 AS up, p_partkey // 8 AS file, p_name AS name, p_brand || '.' || p_name AS qualified_name, {_pick(KINDS, "p_size")} AS type, p_size AS size FROM part),
 symbols AS (SELECT id, CASE WHEN up >= file * 8 THEN up END AS parent, name, qualified_name, type, {_pick(FOLDERS, "file")} || '/f' || file || '.ts' AS path, size FROM named),
 routes AS (SELECT {_pick(VERBS, "id // 5")} AS method, '/r' || id AS route_path, path, id AS handler FROM symbols WHERE id % 5 = 0)"""
_WORDS = ", ".join(f"({n}, '{k}', {'NULL' if impact._method(w)[0] is None or k != 'route' else repr(impact._method(w)[0])}, '{(impact._method(w)[1] if k == 'route' else w).replace(chr(92), '/').lower()}')" for n, (k, w) in enumerate(ASKED))
_LOW = lambda c: f"lower(replace({c}, chr(92), '/'))"


def _meets(names: tuple[str, ...]) -> tuple[str, str]:
    return " OR ".join(f"contains({_LOW(c)}, word)" for c in names), " OR ".join(f"{_LOW(c)} = word" for c in names)


def _best(name: str, kind: str, source: str, names: tuple[str, ...], take: str, also: str = "true") -> str:
    part, whole = _meets(names)
    return f"{name} AS (SELECT * FROM (SELECT a.target, {take}, {whole} AS exact, bool_or({whole}) OVER (PARTITION BY a.target) AS any_exact FROM asked a JOIN {source} x ON a.kind = '{kind}' AND ({part}) AND {also}) WHERE exact OR NOT any_exact)"


_TARGETS = f"""WITH RECURSIVE {_CODE}, asked(target, kind, method, word) AS (VALUES {_WORDS}),
 {_best("own", "symbol", "symbols", ("name", "qualified_name", "path"), "x.id, x.path")}, {_best("tabs", "table", "(SELECT * FROM symbols WHERE type = 'table')", ("name", "qualified_name", "path"), "x.id")},
 {_best("fil", "file", "(SELECT DISTINCT path FROM symbols)", ("path",), "x.path")}, {_best("way", "route", "routes", ("route_path",), "x.handler", "(a.method IS NULL OR a.method = x.method)")},
 below(target, id, path) AS (SELECT target, id, path FROM own UNION SELECT b.target, s.id, s.path FROM below b JOIN symbols s ON s.parent = b.id AND s.path = b.path)
 SELECT target, id FROM below UNION SELECT o.target, s.id FROM own o JOIN symbols s ON s.path = o.path AND s.type = 'module' UNION SELECT target, s.id FROM fil JOIN symbols s USING (path)
 UNION SELECT target, r.handler FROM fil JOIN routes r USING (path) UNION SELECT target, handler FROM way UNION SELECT target, id FROM tabs"""


@query("e27_targets", _TARGETS)
def targets(spark, sf_dir):
    """The symbols that each target stands for."""
    return impact.targets(code_symbols(spark, sf_dir), code_routes(spark, sf_dir), list(ASKED))


_TOUCHED = f"""WITH RECURSIVE {_CODE}, seeds AS (SELECT id // 192 AS change, id FROM symbols WHERE path IN (SELECT path FROM symbols WHERE size = 7)), used AS (SELECT * FROM edges WHERE confidence IN ('high', 'medium')),
 walk(seed, node, depth) AS (SELECT id, id, 0 FROM seeds UNION SELECT w.seed, e.source, w.depth + 1 FROM walk w JOIN used e ON e.target = w.node WHERE w.depth < 6),
 reached AS (SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL), met AS (SELECT change, r.* FROM reached r JOIN seeds s ON s.id = r.seed),
 found AS (SELECT DISTINCT change, 'direct' AS kind, node::VARCHAR AS key FROM met WHERE depth = 1 UNION SELECT change, 'transitive', node::VARCHAR FROM met WHERE depth >= 2
  UNION SELECT change, 'file', path FROM met JOIN symbols ON symbols.id = node UNION SELECT change, 'route', method || ' ' || route_path FROM met JOIN routes ON handler = node
  UNION SELECT change, CASE WHEN s.type = 'table' THEN 'table' ELSE 'service' END, s.id::VARCHAR FROM met JOIN used e ON e.source = node JOIN symbols s ON s.id = e.target WHERE s.type IN ('table', 'external_service', 'environment_variable')
  UNION SELECT change, 'service', id::VARCHAR FROM seeds JOIN symbols USING (id) WHERE type = 'external_service')"""


def _reached(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    links, symbols, seeds = edges(spark, sf_dir), code_symbols(spark, sf_dir), changed(spark, sf_dir)
    return impact.touched(links, seeds), links, symbols, code_routes(spark, sf_dir), seeds


@query("e28_change_boundaries", _TOUCHED + " SELECT * FROM found")
def boundaries(spark, sf_dir):
    """What each change touches, merged over its symbols."""
    return impact.boundaries(*_reached(spark, sf_dir))


@query("e28_change_chains", _TOUCHED + " SELECT change, seed, min(node) FILTER (depth = 1) AS direct, min(node) FILTER (depth >= 2) AS transitive FROM met GROUP BY ALL HAVING min(node) FILTER (depth = 1) IS NOT NULL")
def chains(spark, sf_dir):
    reached, *_, seeds = _reached(spark, sf_dir)
    return impact.chains(reached, seeds)


_TOLD = lambda n, word: f"CASE WHEN {n} > 0 THEN {n} || (CASE WHEN {n} = 1 THEN ' {word}' ELSE ' {word}s' END) END"


@query("e28_change_risk", _TOUCHED + f""", ahead AS (SELECT DISTINCT seed, e.target AS id FROM reached JOIN used e ON e.source = node), outer_ AS (SELECT seed, 3 * count(*) FILTER (type = 'table') + 2 * count(*) FILTER (type IN ('external_service', 'environment_variable')) AS s FROM ahead JOIN symbols USING (id) GROUP BY 1),
 scores AS (SELECT seed, any_value(coalesce(s, 0)) + count(*) FILTER (depth > 0) AS score FROM reached LEFT JOIN outer_ USING (seed) GROUP BY 1), worst AS (SELECT change, bool_or(score >= 15) AS high, bool_or(score >= 5 AND score < 15) AS medium FROM seeds JOIN scores ON scores.seed = seeds.id GROUP BY 1),
 c AS (SELECT change, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'file' AND regexp_matches(regexp_replace(key, '([a-z0-9])([A-Z])', '\\1/\\2', 'g'), '{paths.SENSITIVE_PATH}')) AS sensitive, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind = 'table') AS tables,
  count(*) FILTER (kind = 'service') AS services, count(*) FILTER (kind = 'direct') AS direct, count(*) FILTER (kind = 'transitive') AS transitive FROM found GROUP BY 1)
 SELECT change, files, routes, tables, services, direct, transitive, CASE WHEN sensitive > 0 OR tables > 0 OR services > 0 OR high OR routes >= 5 THEN 'high' WHEN files >= 5 OR routes > 0 OR medium THEN 'medium' WHEN files = 0 THEN 'unknown' ELSE 'low' END AS level,
 concat_ws(',', {_TOLD("sensitive", "sensitive path")}, {_TOLD("tables", "table")}, {_TOLD("services", "service")}, {_TOLD("routes", "route")}, CASE WHEN high THEN 'high blast radius' END) AS reasons FROM c JOIN worst USING (change)""")
def risk(spark, sf_dir):
    """Level and reasons of each change from what it touches and the blast radius of its symbols."""
    reached, links, symbols, routes, seeds = _reached(spark, sf_dir)
    blasts = graph.scored(reached, graph.confident(links), symbols)
    return impact.change_risks(impact.boundaries(reached, links, symbols, routes, seeds), blasts, seeds)
