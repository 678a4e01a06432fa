"""What changed in meaning between two versions: each document stands for a file in a version before and one after.

Its number picks path and four blocks; in the version after, two of three files take other blocks, some have moved, gone or
come. Five files make a project. The SQL builds the same files and applies the rules line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.functions import paths
from tracewright.operators import semantic as S
from tracewright.plans.base import case_rules, query, table
from tracewright.plans.extraction import _all, _choose, _pick, _re

BLOCKS = (
    "Route::get('/a/#', [A::class, 'show']);\nrouter.POST( \"/b\", save)",
    "@app.delete('/c/#')\n@router.options('/none')\napp.head('/h')",
    "export async function GET(req) { }\nexport function PUT(req) { }",
    "CREATE TABLE IF NOT EXISTS `Users#` (id int);\nalter table public.Users# ADD COLUMN  age int;",
    "  DROP TABLE old#;\n\tRENAME COLUMN a TO b\nDROP \"c#\"",
    "const k = process.env.KEY_# + process.env.MODE;\nenv('APP_NAME'); getenv(\"HOME_DIR\"); os.environ.get('PORT_#')",
    "if (session.user) { authorize(x#); }\n$f = $_FILES['a']; upload($f);",
    "subprocess.run(['ls'])\nshell_exec('ls #');   os.system('x')",
    "token = 'github_pat_abcdefghijklmnopqrstuvwxyz#'\n-----BEGIN RSA PRIVATE KEY-----",
    "plain text # without facts\n\n// authority and uploads are other words",
    "import.meta.env.VITE_URL\r\napp.get(\"/a/1\", x)",
)
PATHS = ("src/auth/login#.php", "db/schema#.sql", "src/app/api/u#/[id]/route.ts", "pages\\api/[...all#]/index.js", "lib/util#.py", "tests/test#.py", "docs/page#.md", "src/api/server#.ts", "ui/component#.tsx")
MANIFESTS = (
    ("p#/package.json", '{"name": "x", "dependencies": {"React": "18.#", "left-pad": "1.0"}, "devDependencies": {"react": "18.#", "vite": "5"}}'),
    ("p#/Composer.json", '{"require": {"php": "8.#", "a/b": "^1"}, "require-dev": {"PHPUnit": "9"}}'),
    ("p#/requirements-dev.txt", "Flask==2.#\nrequests == 1\n# comment\nnumpy>=1"),
    ("p#/go.mod", "module x\n\tgithub.com/A/b v1.#\nrequire c v2"),
    ("p#/Cargo.toml", 'serde = "1.#"\n[deps]\nRand=0.8;'),
    ("q#/package.json", '{"dependencies": {"broken": '),
    ("q#/composer.json", "[]"),
)
SHIFT = "CASE WHEN after AND n % 3 <> 0 THEN n + 5 ELSE n END"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, ref, path, content) before and after."""
    n, r, after, m = (F.col(c) for c in ("n", "r", "after", "m"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n")).withColumn("after", F.explode(F.array(F.lit(False), F.lit(True))))
    docs = docs.filter(F.when(after, n % 13 != 1).otherwise(n % 17 != 2)).withColumn("r", F.floor(n / 5)).withColumn("m", F.expr(SHIFT))
    named = lambda text, number: F.replace(text, F.lit("#"), number.cast("string"))
    moved = F.when(after & (n % 11 == 3), "moved/").otherwise("")
    path = F.when(n % 5 == 4, named(_pick([p for p, _ in MANIFESTS], r), n)).otherwise(named(_pick(PATHS, n * 5 + r), n))
    blocks = F.concat_ws("\n", *(_pick(BLOCKS, m * 7 + r * (j + 1) + j * j) for j in range(4)))
    content = F.when(n % 5 == 4, named(_pick([c for _, c in MANIFESTS], r), m % 10)).otherwise(named(blocks, m % 4))
    return docs.select(F.floor(n / 5).cast("long").alias("project"), F.when(after, "after").otherwise("before").alias("ref"), F.concat(moved, path).alias("path"), content.alias("content"))


def _versions_sql() -> str:
    blocks = " || chr(10) || ".join(_choose(BLOCKS, f"m * 7 + r * {j + 1} + {j * j}") for j in range(4))
    return f"""d AS (SELECT *, {SHIFT} AS m FROM (SELECT doc_id AS n, doc_id // 5 AS r, unnest([false, true]) AS after FROM documents) WHERE CASE WHEN after THEN n % 13 <> 1 ELSE n % 17 <> 2 END),
  v AS (SELECT n // 5 AS project, CASE WHEN after THEN 'after' ELSE 'before' END AS ref, (CASE WHEN after AND n % 11 = 3 THEN 'moved/' ELSE '' END) ||
      CASE WHEN n % 5 = 4 THEN replace({_choose([p for p, _ in MANIFESTS], "r")}, '#', n::VARCHAR) ELSE replace({_choose(PATHS, "n * 5 + r")}, '#', n::VARCHAR) END AS path,
      CASE WHEN n % 5 = 4 THEN replace({_choose([c for _, c in MANIFESTS], "r")}, '#', (m % 10)::VARCHAR) ELSE replace({blocks}, '#', (m % 4)::VARCHAR) END AS content FROM d),
  c AS (SELECT * FROM v SEMI JOIN (SELECT project, path FROM v GROUP BY ALL HAVING max(content) FILTER (ref = 'before') IS DISTINCT FROM max(content) FILTER (ref = 'after')) x USING (project, path)),
  l AS (SELECT project, ref, path, lower(regexp_extract(path, '[^/]*$')) AS base, replace(path, chr(92), '/') AS slashed, i AS line, t AS text, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS trimmed
    FROM (SELECT *, unnest(regexp_split_to_array(content, '\\r\\n|\\n')) AS t, unnest(range(1, len(regexp_split_to_array(content, '\\r\\n|\\n')) + 1)) AS i FROM c))"""


def _facts_sql() -> str:
    got = lambda pattern, k: f"regexp_extract(text, {_re(pattern)}, {k})"
    rows = lambda kind, identity, name, value, where, place=0, of="l": (
        f"SELECT project, ref, path, line, {place} AS place, '{kind}' AS kind, {identity} AS identity, {name} AS name, {value} AS value FROM {of} WHERE {where}"
    )
    has = lambda pattern: f"regexp_matches(text, {_re(pattern)})"
    parts = [rows("routes", f"'route|' || upper({got(p, 1)}) || ' ' || {got(p, 2)}", f"upper({got(p, 1)})", got(p, 2), has(p), k) for k, p in enumerate(S.ROUTES)]
    where = f"'/api/' || regexp_replace(regexp_extract(slashed, {_re(S.FILE_ROUTE)}, 1), {_re(S.FILE_PARAMETER)}, '{{\\1}}', 'g')"
    parts.append(rows("routes", f"'route|' || {got(S.FILE_METHOD, 1)} || ' ' || {where}", got(S.FILE_METHOD, 1), where, f"{has(S.FILE_METHOD)} AND regexp_matches(slashed, {_re(S.FILE_ROUTE)})", 2))
    squeezed = "regexp_replace(trimmed, '\\s+', ' ', 'g')"
    parts.append(rows("schema", f"'schema|' || upper({got(S.TABLE, 1)}) || ' table ' || {got(S.TABLE, 2)}", f"upper({got(S.TABLE, 1)})", got(S.TABLE, 2), has(S.TABLE), 3))
    parts.append(rows("schema", f"'schema|' || {squeezed}", got(S.COLUMN, 1), f"substr(trimmed, 1, {S.STATEMENT})", has(S.COLUMN), 4))
    for boundary, pattern in S.BOUNDARIES:
        parts.append(rows("security", f"'security|{boundary}|' || {squeezed}", f"'{boundary}'", "'<redacted>'" if boundary == S.SECRET else f"substr(trimmed, 1, {S.PREVIEW})", has(pattern), 5))
    parts.append(rows("dependencies", f"'dependency|' || {got(S.LINE_DEPENDENCY, 1)} || '@' || {got(S.LINE_DEPENDENCY, 2)}", got(S.LINE_DEPENDENCY, 1), got(S.LINE_DEPENDENCY, 2), f"{has(S.LINE_DEPENDENCY)} AND regexp_matches(base, {_re(S.LINE_MANIFEST)})", 6))
    parts.append(rows("environment", "'environment|' || e", "e", "''", "true", 7, f"(SELECT *, unnest({_all(S.ENVIRONMENT, 1, 'text')}) AS e FROM l)"))
    manifest = f"lower(regexp_extract(path, '[^/]*$')) IN {S.JSON_MANIFESTS!r} AND json_valid(content)"
    for k, group in enumerate(S.JSON_GROUPS):
        of = f"(SELECT project, ref, path, 1 AS line, unnest(map_entries(CAST(json_extract(content, '$.\"{group}\"') AS MAP(VARCHAR, VARCHAR)))) AS e FROM (SELECT * FROM c WHERE {manifest}))"
        parts.append(rows("dependencies", "'dependency|' || e.key || '@' || e.value", "e.key", "e.value", "true", k, of))
    areas = f"(SELECT project, ref, path, 1 AS line, {case_rules(paths.AREAS, 'lower(path)', paths.OTHER_AREA)} AS area FROM c)"
    parts.append(
        f"SELECT project, ref, min(path), 1, 0, 'architecture', 'architecture|' || area, area, array_to_string(list_sort(list(DISTINCT path))[1:{S.AREA_PATHS}], chr(10)) FROM {areas} WHERE area NOT IN {S.NO_AREAS!r} GROUP BY project, ref, area"
    )
    return f"{_versions_sql()}, f AS (" + "\n    UNION ALL ".join(parts) + ")"


_DELTA_SQL = f"""{_facts_sql()}, k AS (SELECT project, kind, sha256(lower(identity)) AS identity, bool_or(ref = 'before') AS was, bool_or(ref = 'after') AS now,
    max(row(path, line, place, name, value)) AS last FROM f GROUP BY ALL),
  e AS (SELECT project, kind, CASE WHEN now THEN 'added' ELSE 'removed' END AS change, identity, last[1] AS path, last[2] AS line, last[4] AS name, last[5] AS value FROM k WHERE was <> now)"""


@query("p23_e19_version_facts", f"WITH {_DELTA_SQL} SELECT project, kind, change, identity, path, line::INT AS line, name, value FROM e")
def version_facts(spark, sf_dir):
    return S.delta(versions(spark, sf_dir), "before", "after")


@query("e22_changed_kinds", f"WITH {_DELTA_SQL} SELECT project, kind, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, kind <> 'architecture' AND kind <> 'environment' AS may_break FROM e GROUP BY project, kind")
def changed_kinds(spark, sf_dir):
    return S.changed_kinds(S.delta(versions(spark, sf_dir), "before", "after"))
