"""Queries on services in context and on facts of lines under a budget, over files with varied code in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.functions import paths, text
from tracewright.operators import enrich
from tracewright.plans.base import query
from tracewright.plans.rules import _BEHAVIOUR, CODE_SQL, _pick, code_files, pick

SPEECH = (
    "fetch('https://api.stripe.com/v1')", "const API_HOST = 'https://api.openai.com'", "// fetch amazonaws.com", "/* starts", "*/ fetch('https://supabase.co')", "detector_rules = ['stripe', 'openai']", "dsn pgsql:host", "plain rediss://cache", "FROM dockerfile", "kind: deployment",
    "apiVersion: v1 client", "new s3client()", "request mongodb", "redis", "  # use mysql2", "x = '''", "requests.get('https://sentry.io')", "cloudflare endpoint", "axios.post('/api/a', b)", "if (a) return db.from('orders').select()", "INSERT INTO items VALUES", "<a onClick={x}>", "see vercel.json", "UPDATE users SET a", "delete from users; drop table b",
)


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with two more lines each: project, id, path, content."""
    n = F.col("page_id")
    content = F.when((n % 29).isin(0, 6), F.col("content")).otherwise(F.concat_ws("\n", "content", pick(SPEECH, n * 3 + 1), pick(SPEECH, F.floor(n / 3)), pick(SPEECH, n)))
    return code_files(spark, sf_dir).select("project", n.alias("id"), "path", content.alias("content"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_more = f"concat_ws(chr(10), content, {_pick(SPEECH, 'page_id * 3 + 1')}, {_pick(SPEECH, 'page_id // 3')}, {_pick(SPEECH, 'page_id')})"
_LINES = f"""{CODE_SQL}, spoken AS (SELECT project, page_id AS id, path, lower(base) AS base, {_BEHAVIOUR} AS behaves, string_split(CASE WHEN page_id % 29 IN (0, 6) THEN content ELSE {_more} END, chr(10)) AS ls FROM code WHERE runtime),
 lined AS (SELECT project, id, path, base, behaves, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS nth FROM spoken)"""
_N = lambda mark: f"(len(line) - len(replace(line, {_quoted(mark)}, ''))) // {len(mark)}"
_BEFORE = lambda what: f"coalesce(sum({what}) OVER (PARTITION BY id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_IN = f"CASE WHEN path ILIKE '%.py' THEN {_BEFORE(_N(chr(34) * 3) + ' + ' + _N(chr(39) * 3))} % 2 = 1 ELSE {_BEFORE(_N('/*'))} > {_BEFORE(_N('*/'))} END"
_ROWS = ", ".join(f"('{s}', {n}, '{w}', {str(enrich.is_endpoint(w)).lower()})" for s, n, w in enrich.NEEDLES)


@query("p21_service_uses", f"""WITH {_LINES}, needles(service, n, needle, address) AS (VALUES {_ROWS}), o AS (SELECT *, {_IN} AS inside FROM lined),
 m AS (SELECT id, path, service, n, needle, nth, (regexp_matches(line, '\\S') AND NOT regexp_matches(line, {_quoted(enrich.COMMENT)}) AND NOT (regexp_matches(line, {_quoted(text.DETECTOR[0])}) AND regexp_matches(line, {_quoted(text.DETECTOR[1])}))
   AND regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}])\\Q' || needle || '\\E($|[^\\p{{L}}\\p{{N}}])') AND behaves
   AND ((needle <> 'apiVersion:' AND regexp_matches(line, '(?i){enrich.AHEAD}[^\\r\\n]{{0,140}}\\Q' || needle || '\\E|\\Q' || needle || '\\E[^\\r\\n]{{0,140}}{enrich.AFTER}'))
    OR (address AND NOT inside AND (regexp_matches(line, {_quoted(enrich.CALL)}) OR regexp_matches(line, {_quoted(enrich.HOST)})))))
   OR (needle = 'vercel.json' AND base = 'vercel.json') OR (needle = 'dockerfile' AND (base = 'dockerfile' OR base LIKE 'docker-compose%')) AS hit
  FROM o JOIN needles ON contains(lower(line), lower(needle)) WHERE NOT regexp_matches(base, {_quoted(enrich.LOCKED)})),
 firsts AS (SELECT id, path, service, n, needle, min(nth) AS line FROM m GROUP BY ALL HAVING bool_or(hit))
 SELECT id, path, service, min_by(line, n) AS line, string_agg(needle, '|' ORDER BY n) AS needles FROM firsts GROUP BY ALL""")
def service_uses(spark, sf_dir):
    """Services that running code or a deployment file tells of."""
    found = enrich.service_uses(spoken(spark, sf_dir).select("id", "path", "content"))
    return found.select("id", "path", "service", "line", F.array_join("needles", "|").alias("needles"))


# budgets small enough that projects of twelve files meet them
_EDGES, _SYMBOLS = ((30, 8), (10, 14), (-1, 20)), ((8, 2), (-1, 3))
_STEPS = lambda value, steps: "CASE " + " ".join(f"WHEN {value} > {b} THEN {m}" for b, m in steps) + " END"
_UNION = " UNION ".join(
    [f"SELECT *, '{k}' AS kind, '{r}' AS relationship, unnest(regexp_extract_all(line, {_quoted(p)}, 1)) AS target FROM plain" for k, r, p in text.TABLE_FACTS]
    + [f"SELECT *, '{k}', '{r}', regexp_extract(line, {_quoted(text.BUILDER_TABLE)}, 1) FROM plain WHERE regexp_extract(line, {_quoted(text.BUILDER_TABLE)}, 1) <> '' AND regexp_matches(line, {_quoted(p)})" for k, r, p in text.BUILDER_FACTS]
    + [f"SELECT *, '{k}', '{r}', NULL FROM lined WHERE behaves AND regexp_matches(line, {_quoted(p)})" for k, r, p in text.CONTROL_FACTS]
    + ["SELECT *, 'ui event', 'handles_ui_event', 'ui:' || lower(unnest(regexp_extract_all(line, '(?i)\\b(onClick|onSubmit|onChange|addEventListener)\\b', 1))) FROM lined WHERE behaves"]
    + ["""SELECT *, 'request', 'http_request', 'http:' || (CASE WHEN regexp_extract(line, c, 2) <> '' THEN upper(regexp_extract(line, c, 2)) WHEN regexp_extract(line, m, 1) <> '' THEN upper(regexp_extract(line, m, 1)) ELSE 'GET' END) || ' ' ||
      (CASE WHEN regexp_extract(line, c, 1) <> '' THEN regexp_extract(line, c, 1) ELSE regexp_extract(line, c, 3) END) FROM (SELECT * FROM lined WHERE behaves AND regexp_matches(line, c))"""]
)
_CALLED, _VERB = r"(?i)\bfetch\s*\(\s*['\"`]([^'\"`]+)|\baxios\.(get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)", r"(?i)method\s*:\s*['\"]([A-Z]+)"
_UNION = _UNION.replace("(line, c", f"(line, {_quoted(_CALLED)}").replace("(line, m", f"(line, {_quoted(_VERB)}")
_ORDER = "path, line_no, kind, relationship, target NULLS FIRST"


@query("e12_derived_facts", f"""WITH {_LINES}, plain AS (SELECT * FROM lined WHERE (behaves OR path ILIKE '%.sql') AND NOT regexp_matches(line, '(?i)^\\s*(import|export)\\b')),
 every AS ({_UNION}), f AS (SELECT DISTINCT project, id, path, nth AS line_no, kind, relationship, target, CASE WHEN relationship LIKE '%table' THEN lower(target) END AS name FROM every),
 sizes AS (SELECT project, sum(id % 7) AS edges, count(*) AS symbols FROM spoken GROUP BY 1), limits AS (SELECT project, {_STEPS("edges", _EDGES)} AS e, {_STEPS("symbols", _SYMBOLS)} AS s FROM sizes),
 fresh AS (SELECT project, name, row_number() OVER (PARTITION BY project ORDER BY path, line_no, kind, relationship, target) AS k FROM (SELECT DISTINCT ON (project, name) * FROM f WHERE name IS NOT NULL AND name <> 'users' ORDER BY project, name, path, line_no, kind, relationship, target)),
 able AS (SELECT f.*, k IS NOT NULL AS derived, e, row_number() OVER (PARTITION BY f.project ORDER BY {_ORDER}, id) AS place FROM f JOIN limits l USING (project) LEFT JOIN fresh ON fresh.project = f.project AND fresh.name = f.name AND k <= l.s WHERE f.name IS NULL OR f.name = 'users' OR k IS NOT NULL)
 SELECT project, id, path, line_no, kind, relationship, target, derived, place FROM able WHERE place <= e""")
def derived(spark, sf_dir):
    """Facts of lines that become edges of their project, under budgets of edges and of new tables."""
    files = spoken(spark, sf_dir)
    sizes = files.filter(paths.is_runtime(F.col("path"))).groupBy("project").agg(F.sum(F.col("id") % 7).alias("edges"), F.count(F.lit(1)).alias("symbols"))
    known = files.select("project", F.lit("Users").alias("name")).distinct()
    found = enrich.derived(enrich.line_facts(files), sizes, known, _EDGES, _SYMBOLS)
    return found.withColumnsRenamed({"line": "line_no", "place_": "place"})
