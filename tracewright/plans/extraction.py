"""Symbols, relationships, routes and roles out of source files.

Each document stands for a file: its number picks the language, the path and four blocks of code, twenty files make a project,
every fifth file is a manifest or a single file component. The SQL builds the same files and applies the rules by joins
over lines, where the operators sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.operators import extract as X, frameworks as W, fusion, providers
from tracewright.operators.graph import kept
from tracewright.operators.sweep import numbered
from tracewright.plans.base import query, table

PHP = (
    "namespace App\\Http;\nuse Foo\\Bar, Baz as Qux;",
    "abstract class A# extends Base implements I, \\J\n{\n  use Traits\\T;\n  private ?string $x = null;\n  public const K = 1;\n  public function run#(int $a) {\n    $y = new Item#(); $this->go(helper($y));\n    if (true) { getenv('KEY_A'); }\n    while ($a) { $a = next($a); }\n  }\n  abstract function stub();\n}",
    "function free#() { return other(); }\nlonely(free#());",
    "final class B#\n{\n  protected function read()\n  {\n    $q = $db->query(\"SELECT a FROM t1 WHERE x\");\n    $db->run('INSERT INTO Log (a) VALUES (1)');\n    DB::table('users')->update($q);\n  }\n  const LIMIT = 5;\n}\n$after = make();",
    "Route::get('/a#', [C::class, 'read'])->name('a.show')->middleware(['auth', 'log']);\nRoute::post('b//#', 'C@store')->middleware('web');\nRoute::resource('c', D::class);",
    "// class Nothing { new Gone(\n$url = 'https://api.example.com/v1/x';\n$client->post('http://Hooks.example.org:8080/y.');\n'https://not.example.com/plain'",
    "class M# extends Model {\n  public function handle() { return env(\"APP_MODE\"); }\n  public static function make() {\n    return array_map(function ($z) { return inner($z); }, $_ENV['HOME_DIR']);\n  }\n}",
    "if (is_post()) {\n  Route::any('/any', [X\\Y::class, 'run7']);\n}\nUPDATE accounts SET a = 1\nDROP TABLE IF EXISTS `old_t`",
    "interface Z# {\n  function one();\n}\nenum Suit# { case A; }\ntrait Loud#\n{\n  private static readonly int $v;\n}",
)
SCRIPT = (
    "import x from './y#'\nconst q = require(\"z\");\nimport 'side-effect'",
    "export class B# extends C.D {\n  m() { call(process.env.KEY_#A); }\n}\nrun(import.meta.env.MODE)",
    "export default async function Comp#(a) { return <Foo.Bar x/> }\nif (ready) { start#() }",
    "const useIt# = (a: b) => go();\nconst load = async id => fetch('https://Api.example.com/u');",
    "export interface I# {\n  name: string\n}\nexport enum E# { A }\ntype T# = string\nlet v = plain(1)",
    "function GET(req) { return json(db.items) }\nexport async function POST(req) { 'use server'; save(req) }",
    "<Route path=\"/home/#\" element={<Comp# />} />\n<Route exact path='about//us' element={ <Nope/> }>",
    "app.get('/items/#', list.all#)\nrouter.post(\"/items\", useIt#)\nfunction all#(a) { return a }\napp.delete('/x', all#)",
    "const store = defineStore('cart#', {})\nconst routes = [{ path: '/v#', name: 'v' }, { path: '/w' }]",
    "function helper#(x) {\n  switch (x) { case 1: return <List.Item<A> /> }\n}\nvar Big# = function(x) { }",
)
PYTHON = (
    "import os\nfrom a.b import c\nfrom fastapi import FastAPI",
    "@dec\nclass K#(Base, Other):\n    x = f(1)\n    def m(self):\n        return self.g.h(os.getenv(\"ENV_A\"))\n\n    def _n(self): pass\nclass _P#(BaseModel):\n    pass",
    "def top#(a):\n    def inner():\n        z(os.environ['ENV_B'])\n    inner()\ncall('https://Svc.example.com/a')",
    "@app.get('/f//#')\n@other\nasync def get_f#(x):\n    return x\n@router.delete(\"d#\", tags=[Depends(a)])\nx = 1",
    "from django.db import models\nclass Row#(models.Model):\n    def save(self):\n        super().save()\nurlpatterns = [path('rows/<int:id>/', views.top#, name='row'), re_path(r'^k/', Row#)]",
    "import flask\n@bp.route('/login/#', methods=['POST', 'GET'])\ndef login#():\n    pass\n@app.put('/put')\n\n\n\n\ndef too_far(): pass",
    "path('x', missing.view)\n@app.route(\"/plain\")\ndef plain#(): return helper(environ.get('ENV_C'))",
    "class Outer#:\n    class Inner#:\n        def deep(self): return 1\n    def after(self):\n        if x:\n            y()\n\n        w()\nlast()",
)
SQL = (
    "CREATE TABLE IF NOT EXISTS \"Shop.Items#\" (\n  id INT PRIMARY KEY,\n  `name` VARCHAR(20) NOT NULL,\n  PRIMARY KEY (id),\n  FOREIGN KEY (id) REFERENCES Other(id)\n);",
    "create or replace view v# as\nselect a b",
    "CREATE TABLE t# (\n  total NUMERIC (10, 2),\n  CONSTRAINT fk FOREIGN KEY (a) REFERENCES `Shop.Items#`(id)\n)\nENGINE",
    "CREATE TABLE one_line (a INT);\nmore text\n) ENGINE=x\nloose text",
    "CREATE FUNCTION f#()\nCREATE TRIGGER g AFTER\n-- id INT",
)
VUE = ("<template>\n  <Card/>\n</template>", "<script>\nimport a from 'b'\nexport default function Shown#() { use(a) }\n</script>")
MANIFESTS = (
    ("package.json", '{"dependencies": {"react": "19", "next": "15"}}'), ("composer.json", '{"require": {"laravel/framework": "12"}}'), ("sub/package.json", '{"devDependencies": {"vue": "3"}}'), ("package.json", '{"dependencies": {"react": null}}'), ("composer.json", "not json"),
)
PATHS = {
    "PHP": ("src/a#.php", "public/p#.php", "routes/web.php", "app/Http/Controllers/c#.php", "app/Models/m#.php", "app/Http/Middleware/h#.php", "public/index.php", "views/v#.blade.php"),
    "TypeScript": ("app/(shop)/items/[id]/page.tsx", "app/api/r#/route.ts", "pages/api/users/[...all].ts", "src/c#.tsx", "pages/p#/index.js", "lib/store.ts"),
    "Python": ("app/main#.py", "tests/test_#.py", "shop#/urls.py"),
    "SQL": ("db/s#.sql",),
}
BLOCKS = {"PHP": PHP, "TypeScript": SCRIPT, "Python": PYTHON, "SQL": SQL, "Vue": VUE}
KINDS = ("PHP", "TypeScript", "Python", "SQL")


def _pick(values, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, path, language, content; n is the document's number."""
    n = F.col("n")
    fifth, round_ = n % 5, F.floor(n / 5)
    single = round_ % 6 == 5
    named = lambda text: F.replace(text, F.lit("#"), n.cast("string"))
    language, path, content = F.lit("JSON"), _pick([p for p, _ in MANIFESTS], round_), _pick([c for _, c in MANIFESTS], round_)
    path = F.concat(F.regexp_replace(n.cast("string"), "$", "/"), path)
    language, path = F.when(single, "Vue").otherwise(language), F.when(single, named(F.lit("ui/View#.vue"))).otherwise(path)
    content = F.when(single, named(_pick(VUE, n))).otherwise(content)
    for k, kind in enumerate(KINDS):
        blocks = F.concat_ws("\n", *(_pick(BLOCKS[kind], n * 7 + round_ * (j + 1) + j * j) for j in range(4)))
        language, path, content = F.when(fifth == k, kind).otherwise(language), F.when(fifth == k, named(_pick(PATHS[kind], round_))).otherwise(path), F.when(fifth == k, named(blocks)).otherwise(content)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"))
    return docs.select(F.floor(n / 20).cast("long").alias("project"), path.alias("path"), language.alias("language"), content.alias("content"))


def _q(text: str) -> str:
    """An SQL string; line ends are written as a function's."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


def _choose(values, number: str) -> str:
    return f"list_extract([{', '.join(map(_q, values))}], (({number}) % {len(values)} + 1)::INT)"


def _files_sql() -> str:
    blocks = {k: " || chr(10) || ".join(_choose(BLOCKS[k], f"n * 7 + r * {j + 1} + {j * j}") for j in range(4)) for k in KINDS}
    case = lambda of, last: "CASE " + " ".join(f"WHEN n % 5 = {i} THEN {of(k)}" for i, k in enumerate(KINDS)) + f" WHEN r % 6 = 5 THEN {last[0]} ELSE {last[1]} END"
    path = case(lambda k: _choose(PATHS[k], "r"), ("'ui/View#.vue'", "n || '/' || " + _choose([p for p, _ in MANIFESTS], "r")))
    content = case(lambda k: blocks[k], (_choose(VUE, "n"), _choose([c for _, c in MANIFESTS], "r")))
    language = case(lambda k: f"'{k}'", ("'Vue'", "'JSON'"))
    return f"""f AS (SELECT n // 20 AS project, replace({path}, '#', n::VARCHAR) AS path, {language} AS language, CASE WHEN n % 5 = 4 AND r % 6 <> 5 THEN {_choose([c for _, c in MANIFESTS], "r")} ELSE replace({content}, '#', n::VARCHAR) END AS content
    FROM (SELECT doc_id AS n, doc_id // 5 AS r FROM documents)),
  l AS (SELECT project, path, language, i AS line_no, line, trim(line) AS t, CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END AS indent
    FROM (SELECT project, path, language, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM f))"""


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _all(pattern: str, group: int = 1, of: str = "line") -> str:
    return f"regexp_extract_all({of}, {_re(pattern)}, {group})"


def _one(pattern: str, group: int = 1, of: str = "t") -> str:
    return f"nullif(regexp_extract({of}, {_re(pattern)}, {group}), '')"


def _facts(rows: str, source: str, kind: str, targets: str, confidence: str, where: str = "true") -> str:
    return f"SELECT project, path, line_no, {source} AS source, '{kind}' AS type, target, '{confidence}' AS confidence FROM (SELECT *, unnest({targets}) AS target FROM {rows} WHERE {where}) WHERE target <> ''"


_HOST = f"list_transform({_all(X.URL, 0)}, lambda u: lower(regexp_extract(u, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)))"
_NOT = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"

# JavaScript and TypeScript: the last declaration before a line, by an as-of join
_JS_MADE = f"coalesce({_one(X.JS_FUNCTION)}, {_one(X.JS_ARROW)})"
_JS_SQL = f"""{_files_sql()}, js AS (SELECT *, coalesce({_one(X.JS_CLASS)}, {_JS_MADE}, {_one(X.JS_TYPE)}) AS name,
    CASE WHEN {_one(X.JS_CLASS)} IS NOT NULL THEN 'class' WHEN {_JS_MADE} IS NOT NULL THEN CASE WHEN {_JS_MADE} LIKE 'use%' THEN 'hook' WHEN regexp_matches({_JS_MADE}, '^[A-Z]') THEN 'component' ELSE 'function' END
      WHEN contains(t, 'interface ') THEN 'interface' WHEN contains(t, 'enum ') THEN 'enum' ELSE 'type' END AS type FROM l WHERE language IN {_NOT(X.SCRIPTS)}),
  jd AS (SELECT project, path, line_no, type, name, path || '#' || name AS qualified_name, regexp_matches(t, '^export\\s+') AS exported FROM js WHERE name IS NOT NULL),
  ja AS (SELECT js.*, coalesce(jd.qualified_name, js.path) AS source FROM js ASOF LEFT JOIN jd ON js.project = jd.project AND js.path = jd.path AND js.line_no >= jd.line_no),
  je AS (
    {_facts("ja", "source", "extends", f"[regexp_extract(t, {_re(X.JS_EXTENDS)}, 1)]", "high", "type = 'class' AND name IS NOT NULL")}
    UNION {_facts("ja", "path", "imports", f"[coalesce({_one(X.JS_IMPORT, 1)}, {_one(X.JS_IMPORT, 2)}, {_one(X.JS_IMPORT, 3)})]", "high")}
    UNION {_facts("ja", "source", "calls", f"list_filter({_all(X.JS_CALL)}, lambda c: c NOT IN {_NOT(X.JS_NOT_CALLS)} AND NOT contains(t, 'function ' || c))", "low")}
    UNION {_facts("ja", "source", "renders", _all(X.JS_RENDER), "high")}
    UNION {_facts("ja", "source", "reads_env", _all(X.JS_ENV), "high")}
    UNION {_facts("ja", "source", "calls_service", _HOST, "medium")})"""

# SQL: the table begun before a line, unless one ended since
_SQL_SQL = f"""{_files_sql()}, s AS (SELECT *, {_one(X.SQL_TABLE)} AS made, {_one(X.SQL_OTHER, 2)} AS other, lower({_one(X.SQL_OTHER)}) AS other_kind FROM l WHERE language = 'SQL'),
  ev AS (SELECT project, path, line_no, made FROM s WHERE made IS NOT NULL OR regexp_matches(t, {_re(X.SQL_END)})),
  so AS (SELECT s.*, CASE WHEN s.made IS NULL THEN ev.made END AS open FROM s ASOF LEFT JOIN ev ON s.project = ev.project AND s.path = ev.path AND s.line_no > ev.line_no),
  sc AS (SELECT *, CASE WHEN open IS NOT NULL AND upper({_one(X.SQL_COLUMN)}) NOT IN {_NOT(X.SQL_NOT_COLUMNS)} THEN {_one(X.SQL_COLUMN)} END AS col FROM so),
  sd AS (SELECT project, path, line_no, CASE WHEN made IS NOT NULL THEN 'table' ELSE other_kind END AS type, coalesce(made, other) AS name, CASE WHEN made IS NOT NULL THEN 'table' ELSE other_kind END || ':' || lower(coalesce(made, other)) AS qualified_name, true AS exported FROM sc WHERE coalesce(made, other) IS NOT NULL
    UNION ALL SELECT project, path, line_no, 'column', col, open || '.' || col, false FROM sc WHERE col IS NOT NULL),
  se AS (SELECT project, path, line_no, path AS source, 'defines' AS type, qualified_name AS target, 'high' AS confidence FROM sd WHERE type <> 'column'
    UNION {_facts("so", "'table:' || lower(open)", "foreign_key_to", f"['table:' || lower({_one(X.SQL_FOREIGN)})]", "high", "open IS NOT NULL")})"""

# Python: the last scope before a line that no line in between has left
_PY_NAME = f"CASE WHEN t NOT LIKE '@%' THEN coalesce({_one(X.PY_CLASS)}, {_one(X.PY_DEF)}) END"
_PY_SQL = f"""{_files_sql()}, p AS (SELECT *, {_PY_NAME} AS name, CASE WHEN {_one(X.PY_CLASS)} IS NOT NULL THEN 'class' ELSE 'function' END AS kind FROM l WHERE language = 'Python'),
  ps AS (SELECT s.*, coalesce((SELECT min(x.line_no) - 1 FROM p x WHERE x.project = s.project AND x.path = s.path AND x.line_no > s.line_no AND x.indent <= s.indent), (SELECT max(x.line_no) FROM p x WHERE x.project = s.project AND x.path = s.path)) AS last FROM p s WHERE name IS NOT NULL),
  pa AS (SELECT p.project, p.path, p.line_no, max(s.line_no) AS holder FROM p JOIN ps s ON p.project = s.project AND p.path = s.path AND p.line_no > s.line_no AND p.line_no <= s.last GROUP BY ALL),
  pq AS (SELECT s.*, h.name AS h, h.kind AS hk, CASE WHEN s.kind = 'function' AND h.kind = 'class' THEN 'method' ELSE s.kind END AS type, CASE WHEN s.kind = 'function' AND h.kind = 'class' THEN h.name || '.' || s.name ELSE s.path || '#' || s.name END AS qualified_name
    FROM ps s LEFT JOIN pa a ON a.project = s.project AND a.path = s.path AND a.line_no = s.line_no LEFT JOIN ps h ON h.project = a.project AND h.path = a.path AND h.line_no = a.holder),
  po AS (SELECT p.*, coalesce(q.qualified_name, p.path) AS source FROM p LEFT JOIN pa a ON a.project = p.project AND a.path = p.path AND a.line_no = p.line_no LEFT JOIN pq q ON q.project = a.project AND q.path = a.path AND q.line_no = a.holder WHERE p.name IS NULL AND p.t NOT LIKE '@%'),
  pd AS (SELECT project, path, line_no, type, name, qualified_name, type <> 'method' AND name NOT LIKE '\\_%' ESCAPE '\\' AS exported, last FROM pq),
  pe AS (
    {_facts("pq", "qualified_name", "extends", f"regexp_split_to_array(regexp_extract(t, {_re(X.PY_CLASS)}, 2), '\\s*,\\s*')", "high", "kind = 'class'")}
    UNION {_facts("po", "path", "imports", f"[coalesce({_one(X.PY_IMPORT, 1)}, {_one(X.PY_IMPORT, 2)})]", "high")}
    UNION {_facts("po", "source", "calls", f"list_filter({_all(X.PY_CALL)}, lambda c: c NOT IN {_NOT(X.PY_NOT_CALLS)})", "low")}
    UNION {_facts("po", "source", "reads_env", f"list_concat({_all(X.PY_ENV, 1)}, {_all(X.PY_ENV, 2)})", "high")}
    UNION {_facts("po", "source", "calls_service", _HOST, "medium")})"""

# PHP: depth by sums, ends by the first line that closes the scope's level, owners by the last scope still open
_PHP_END = lambda level: f"(SELECT min(x.line_no) FROM h x WHERE x.project = s.project AND x.path = s.path AND x.line_no > s.line_no AND x.after <= {level} AND x.before > {level})"
_PHP_LAST = "(SELECT max(x.line_no) FROM h x WHERE x.project = s.project AND x.path = s.path)"
_PHP_SHUT = "contains(s.t, '{') AND s.after <= s.before"
_PHP_BARE = """regexp_replace(regexp_replace(line, '//.*$', ''), '''[^'']*''|"[^"]*"', '', 'g')"""
_PHP_CALLS = f"list_filter({_all('(?:^|[^>:A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)[ ]*[(]', 1, of='regexp_replace(line, chr(92) || chr(40), chr(40) || chr(32), chr(103))')}, lambda c: lower(c) NOT IN {_NOT(X.PHP_NOT_CALLS)})"
_PHP_SQL = f"""{_files_sql()}, h0 AS (SELECT *, len(regexp_extract_all({_PHP_BARE}, '[{{]')) AS o, len(regexp_extract_all({_PHP_BARE}, '[}}]')) AS c FROM l WHERE language = 'PHP'),
  h AS (SELECT *, sum(o - c) OVER w AS after, sum(o - c) OVER w - o + c AS before, coalesce(last_value(trim({_one(X.PHP_NAMESPACE)}) IGNORE NULLS) OVER w || chr(92), '') AS space,
    {_one(X.PHP_CLASS, 2)} AS class, {_one(X.PHP_FUNCTION, 2)} AS func FROM h0 WINDOW w AS (PARTITION BY project, path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  hc AS (SELECT s.*, CASE WHEN {_PHP_SHUT} THEN s.line_no ELSE coalesce({_PHP_END("s.before")}, {_PHP_LAST}) END AS last FROM h s WHERE class IS NOT NULL),
  hi AS (SELECT h.*, CASE WHEN h.class IS NOT NULL THEN h.class ELSE k.class END AS holder, CASE WHEN h.class IS NOT NULL THEN h.space || h.class ELSE k.space || k.class END AS holder_q
    FROM h LEFT JOIN (SELECT h.project, h.path, h.line_no, max(c.line_no) AS at FROM h JOIN hc c ON c.project = h.project AND c.path = h.path AND h.line_no > c.line_no AND h.line_no <= c.last GROUP BY ALL) a ON a.project = h.project AND a.path = h.path AND a.line_no = h.line_no
    LEFT JOIN hc k ON k.project = a.project AND k.path = a.path AND k.line_no = a.at),
  hf AS (SELECT s.*, space || coalesce(holder || '::', '') || func AS q, CASE WHEN s.t LIKE '%;' OR {_PHP_SHUT} THEN s.line_no ELSE coalesce({_PHP_END("s.before")}, {_PHP_LAST}) END AS last FROM hi s WHERE func IS NOT NULL),
  ho AS (SELECT h.*, coalesce(own.q, CASE WHEN h.class IS NOT NULL THEN h.space || h.class END, r.q, h.holder_q, h.path) AS source
    FROM hi h LEFT JOIN hf own ON own.project = h.project AND own.path = h.path AND own.line_no = h.line_no
    LEFT JOIN (SELECT h.project, h.path, h.line_no, max(f.line_no) AS at FROM h JOIN hf f ON f.project = h.project AND f.path = h.path AND h.line_no > f.line_no AND h.line_no <= f.last AND f.t NOT LIKE '%;' GROUP BY ALL) a ON a.project = h.project AND a.path = h.path AND a.line_no = h.line_no
    LEFT JOIN hf r ON r.project = a.project AND r.path = a.path AND r.line_no = a.at),
  hd AS (SELECT project, path, line_no, lower({_one(X.PHP_CLASS)}) AS type, class AS name, space || class AS qualified_name, true AS exported, last FROM hc
    UNION ALL SELECT project, path, line_no, CASE WHEN holder IS NULL THEN 'function' ELSE 'method' END, func, q, holder IS NULL, last FROM hf
    UNION ALL SELECT project, path, line_no, 'property', '$' || {_one(X.PHP_PROPERTY, 2)}, holder || '::$' || {_one(X.PHP_PROPERTY, 2)}, false, line_no FROM hi WHERE holder IS NOT NULL AND {_one(X.PHP_PROPERTY, 2)} IS NOT NULL
    UNION ALL SELECT project, path, line_no, 'constant', {_one(X.PHP_CONSTANT, 2)}, holder || '::' || {_one(X.PHP_CONSTANT, 2)}, false, line_no FROM hi WHERE holder IS NOT NULL AND {_one(X.PHP_CONSTANT, 2)} IS NOT NULL),
  hx AS (SELECT *, regexp_extract(t, {_re(X.PHP_CLASS)}, 3) AS tail, list_transform(regexp_split_to_array(regexp_extract(t, {_re(X.PHP_USE)}, 1), '\\s*,\\s*'), lambda u: trim(regexp_replace(trim(u), '(?i)\\s+as\\s+.+$', ''), chr(92))) AS used, NOT contains(lower(line), 'function ') AS plain FROM ho),
  he AS (
    {_facts("hx", "space || class", "extends", f"[regexp_extract(tail, {_re(X.PHP_EXTENDS)}, 1)]", "high", "class IS NOT NULL")}
    UNION {_facts("hx", "space || class", "implements", f"list_transform(regexp_split_to_array(trim(regexp_extract(tail, {_re(X.PHP_IMPLEMENTS)}, 1)), '\\s*,\\s*'), lambda n: trim(n, chr(92) || ' '))", "high", "class IS NOT NULL")}
    UNION {_facts("hx", "path", "imports", "used", "high", "holder IS NULL")}
    UNION {_facts("hx", "holder_q", "uses_trait", "used", "high", "holder IS NOT NULL")}
    UNION {_facts("hx", "source", "instantiates", _all(X.PHP_NEW), "high")}
    UNION {_facts("hx", "source", "calls", _all(X.PHP_MEMBER_CALL), "medium", "plain")}
    UNION {_facts("hx", "source", "calls", _PHP_CALLS, "low", "plain")}
    UNION {_facts("hx", "source", "reads_env", f"list_concat({_all(X.PHP_ENV, 1)}, {_all(X.PHP_ENV, 2)})", "high")}
    {" ".join("UNION " + _facts("hx", "source", "uses_table", _all(p), "medium") for p in X.PHP_TABLES)}
    UNION {_facts("hx", "source", "uses_table", _all(X.PHP_BUILDER), "high")}
    UNION {_facts("hx", "source", "calls_service", _HOST, "medium", f"lower(path) NOT LIKE '%.blade.php' AND (contains(line, '=>') OR regexp_matches(line, {_re(X.PHP_SENDS)}))")})"""

_NAMED = "SELECT project, path, line_no AS start_line, type, qualified_name, exported"
_EDGE_COLUMNS = ("project", "path", "line_no", "source", "type", "target", "confidence")


def _extracted(spark, sf_dir, rules) -> tuple[DataFrame, DataFrame]:
    lines = kept(numbered(code_files(spark, sf_dir)))
    symbols, edges = zip(*(rule(lines) for rule in rules), strict=True)
    joined = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(joined(parts[1:]))
    return joined(symbols), joined(edges)


@query("x1_x3_symbols", f"WITH {_PHP_SQL}, {_PY_SQL.removeprefix(_files_sql() + ', ')} {_NAMED}, last AS end_line FROM hd UNION ALL {_NAMED}, last FROM pd")
def symbols(spark, sf_dir):
    """What PHP and Python files declare, with the lines on which scopes end."""
    found, _ = _extracted(spark, sf_dir, (X.php_facts, X.python_facts))
    return found.select("project", "path", "start_line", "type", "qualified_name", "exported", "end_line")


@query("x1_x3_relationships", f"WITH {_PHP_SQL}, {_PY_SQL.removeprefix(_files_sql() + ', ')} SELECT * FROM he UNION ALL SELECT * FROM pe")
def relationships(spark, sf_dir):
    """What lines of PHP and Python files use, calls included, and the symbol that they are in."""
    return _extracted(spark, sf_dir, (X.php_facts, X.python_facts))[1].select(*_EDGE_COLUMNS)


@query("x2_x4_symbols", f"WITH {_JS_SQL}, {_SQL_SQL.removeprefix(_files_sql() + ', ')} {_NAMED} FROM jd UNION ALL {_NAMED} FROM sd")
def script_symbols(spark, sf_dir):
    """What scripts, single file components and SQL files declare."""
    found, _ = _extracted(spark, sf_dir, (X.script_facts, X.sql_facts))
    return found.select("project", "path", "start_line", "type", "qualified_name", "exported")


@query("x2_x4_relationships", f"WITH {_JS_SQL}, {_SQL_SQL.removeprefix(_files_sql() + ', ')} SELECT * FROM je UNION ALL SELECT * FROM se")
def script_relationships(spark, sf_dir):
    return _extracted(spark, sf_dir, (X.script_facts, X.sql_facts))[1].select(*_EDGE_COLUMNS)



@query("x_providers_fused", f"""WITH {_PHP_SQL}, {_PY_SQL.removeprefix(_files_sql() + ', ')}, {_JS_SQL.removeprefix(_files_sql() + ', ')}, {_SQL_SQL.removeprefix(_files_sql() + ', ')}
 SELECT type, 'likely' AS label, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT project || '/' || path AS path, line_no, type, qualified_name FROM hd UNION ALL SELECT project || '/' || path, line_no, type, qualified_name FROM pd UNION ALL SELECT project || '/' || path, line_no, type, qualified_name FROM jd UNION ALL SELECT project || '/' || path, line_no, type, qualified_name FROM sd)
   UNION ALL SELECT project || '/' || path, 1, 'module', path FROM f GROUP BY ALL) GROUP BY 1""")
def fused(spark, sf_dir):
    """From files through the registry's engines to fused symbols; mentioned services, variables and tables set aside."""
    files = code_files(spark, sf_dir).withColumn("path", F.concat(F.col("project").cast("string"), F.lit("/"), "path"))
    found = fusion.fuse_symbols(providers.default_registry(mentioned=False).facts(files, "maximum"))
    declared = ~F.col("type").isin("environment_variable", "external_service") & ~((F.col("type") == "table") & ~F.col("path").endswith(".sql"))
    return found.filter(declared).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))


# Frameworks: gates by project, routes with handlers, roles

_HAS = lambda manifest, dependency: f"(regexp_extract(path, '[^/]*$') = '{manifest}' AND json_valid(content) AND (" + " OR ".join(f"""json_extract_string(CASE WHEN json_valid(content) THEN content END, '$."{g}"."{dependency}"') IS NOT NULL""" for g in W.DEPENDENCY_GROUPS) + "))"
_SHOWS = {
    "composer": _HAS("composer.json", "laravel/framework"), "laravel": f"{_HAS('composer.json', 'laravel/framework')} OR regexp_matches(path, {_re(W.LARAVEL_FILE)})", "react": _HAS("package.json", "react"), "next": _HAS("package.json", "next"), "vue": _HAS("package.json", "vue"),
    **{k: f"language = 'Python' AND regexp_matches(content, {_re(p)})" for k, p in (("fastapi", W.FASTAPI), ("django", W.DJANGO), ("flask", W.FLASK))},
}
_WEB = lambda of: f"regexp_replace('/' || regexp_replace({of}, '^/+', ''), '/+', '/', 'g')"
_FILE_ROUTE = """CASE WHEN regexp_matches(path, '(?i)^app/(.+/)?(?:page|route)\\.(?:jsx?|tsx?)$') THEN regexp_extract(path, '(?i)^app/(.+/)?(?:page|route)\\.(?:jsx?|tsx?)$', 1)
   WHEN regexp_matches(path, '(?i)^pages/(?:api/)?(.+)\\.(?:jsx?|tsx?)$') THEN regexp_extract(path, '(?i)^pages/(?:api/)?(.+)\\.(?:jsx?|tsx?)$', 1) END"""
for _pattern, _to in ((r"\([^/]+\)/", ""), (r"\[\.\.\.([A-Za-z0-9_]+)\]", r":\1*"), (r"\[([A-Za-z0-9_]+)\]", r":\1"), (r"(?i)/(?:index)$", ""), (r"/+$", "")):
    _FILE_ROUTE = f"regexp_replace({_FILE_ROUTE}, '{_pattern}', '{_to}', 'g')"
_L = lambda p, group: _one(p, group, "line")
_FRAMEWORK_SQL = f"""{_PHP_SQL}, {_PY_SQL.removeprefix(_files_sql() + ', ')}, {_JS_SQL.removeprefix(_files_sql() + ', ')},
  g AS (SELECT project, {", ".join(f"bool_or({v}) AS {k}" for k, v in _SHOWS.items())} FROM f GROUP BY 1),
  sy AS (SELECT 'PHP' AS language, project, path, line_no, type, name, qualified_name FROM hd UNION ALL SELECT 'Python', project, path, line_no, type, name, qualified_name FROM pd UNION ALL SELECT l.language, jd.project, jd.path, jd.line_no, type, name, qualified_name FROM jd JOIN (SELECT DISTINCT project, path, language FROM l) l USING (project, path)),
  lg AS (SELECT * FROM l JOIN g USING (project)), fg AS (SELECT *, {_FILE_ROUTE} AS served FROM f JOIN g USING (project)),
  near AS (SELECT lg.*, (SELECT min_by(regexp_extract(x.line, {_re(W.PY_HANDLER)}, 1), x.line_no) FROM l x WHERE x.project = lg.project AND x.path = lg.path AND x.line_no BETWEEN lg.line_no + 1 AND lg.line_no + {W.REACH} AND regexp_matches(x.line, {_re(W.PY_HANDLER)})) AS near FROM lg WHERE language = 'Python'),
  raw AS (
    SELECT project, path, 'Plain PHP' AS framework, CASE WHEN regexp_matches(content, {_re(W.POSTED)}) THEN 'ANY' ELSE 'GET' END AS method, CASE WHEN lower(regexp_extract(path, {_re(W.PUBLIC_FILE)}, 1)) = 'index' THEN '/' ELSE '/' || regexp_extract(path, {_re(W.PUBLIC_FILE)}, 1) || '.php' END AS route_path, 1 AS line_no, path AS handler, NULL AS name, '' AS middleware, 0 AS ord
      FROM fg WHERE NOT composer AND language = 'PHP' AND regexp_matches(path, {_re(W.PUBLIC_FILE)})
    UNION ALL SELECT project, path, 'Laravel', upper(m), {_WEB("r")}, line_no, (SELECT min_by(qualified_name, (s.path, s.line_no)) FROM sy s WHERE s.project = x.project AND s.language = 'PHP' AND s.type = 'method' AND s.name = x.called), {_L(W.LARAVEL_NAME, 1)},
      array_to_string(list_sort(coalesce(CASE WHEN {_L(W.LARAVEL_MIDDLEWARE, 1)} IS NOT NULL THEN regexp_extract_all({_L(W.LARAVEL_MIDDLEWARE, 1)}, '[''"]([^''"]+)[''"]', 1) END, CASE WHEN {_L(W.LARAVEL_MIDDLEWARE, 2)} IS NOT NULL THEN [{_L(W.LARAVEL_MIDDLEWARE, 2)}] END, [])), '|'), 0
      FROM (SELECT *, regexp_extract(line, {_re(W.LARAVEL_ROUTE)}, 1) AS m, regexp_extract(line, {_re(W.LARAVEL_ROUTE)}, 2) AS r, {_one(W.LARAVEL_METHOD, 2, f"regexp_extract(line, {_re(W.LARAVEL_ROUTE)}, 3)")} AS called FROM lg WHERE laravel AND language = 'PHP' AND regexp_matches(line, {_re(W.LARAVEL_ROUTE)})) x
    UNION ALL SELECT project, path, 'React Router', 'GET', {_WEB(_L(W.REACT_ROUTE, 1))}, line_no, (SELECT min_by(qualified_name, s.line_no) FROM sy s WHERE s.project = lg.project AND s.path = lg.path AND s.type = 'component' AND s.name = {_L(W.REACT_ELEMENT, 1)}), NULL, '', 0
      FROM lg WHERE react AND language = 'TypeScript' AND regexp_matches(line, {_re(W.REACT_ROUTE)})
    UNION ALL SELECT fg.project, fg.path, 'Next.js', upper(name), {_WEB("served")}, 1, qualified_name, NULL, '', sy.line_no FROM fg JOIN sy USING (project, path) WHERE next AND fg.language = 'TypeScript' AND served IS NOT NULL AND regexp_matches(path, {_re(W.NEXT_HANDLER)}) AND upper(name) IN {_NOT(W.NEXT_METHODS)}
    UNION ALL SELECT project, path, 'Next.js', 'GET', {_WEB("served")}, 1, (SELECT min_by(qualified_name, line_no) FROM sy s WHERE s.project = fg.project AND s.path = fg.path AND s.type IN ('component', 'function')), NULL, '', 0 FROM fg WHERE next AND language = 'TypeScript' AND served IS NOT NULL
      AND NOT (regexp_matches(path, {_re(W.NEXT_HANDLER)}) AND EXISTS (SELECT 1 FROM sy s WHERE s.project = fg.project AND s.path = fg.path AND upper(name) IN {_NOT(W.NEXT_METHODS)}))
    UNION ALL SELECT project, path, 'Vue Router', 'GET', {_WEB(_L(W.VUE_ROUTE, 1))}, line_no, NULL, NULL, '', 0 FROM lg WHERE vue AND regexp_matches(line, {_re(W.VUE_ROUTE)})
    UNION ALL SELECT project, path, 'FastAPI', upper({_L(W.FASTAPI_ROUTE, 1)}), {_WEB(_L(W.FASTAPI_ROUTE, 2))}, line_no, (SELECT min_by(qualified_name, s.line_no) FROM sy s WHERE s.project = near.project AND s.path = near.path AND s.type = 'function' AND s.name = near.near), NULL, '', 0 FROM near WHERE fastapi AND regexp_matches(line, {_re(W.FASTAPI_ROUTE)})
    UNION ALL SELECT project, path, 'Flask', coalesce(upper({_L(W.FLASK_ROUTE, 3)}), upper(nullif(regexp_extract(regexp_extract(line, {_re(W.FLASK_ROUTE)}, 2), {_re(W.FLASK_METHOD)}, 1), '')), 'ANY'), {_WEB(f"coalesce({_L(W.FLASK_ROUTE, 1)}, {_L(W.FLASK_ROUTE, 4)}, '/')")}, line_no,
      (SELECT min_by(qualified_name, s.line_no) FROM sy s WHERE s.project = near.project AND s.path = near.path AND s.type = 'function' AND s.name = near.near), NULL, '', 0 FROM near WHERE flask AND path NOT LIKE 'tests/%' AND regexp_matches(line, {_re(W.FLASK_ROUTE)})
    UNION ALL SELECT project, path, 'Django', 'ANY', {_WEB(f"regexp_extract(line, {_re(W.DJANGO_ROUTE)}, 2)")}, line_no, (SELECT min_by(qualified_name, (s.path, s.line_no)) FROM sy s WHERE s.project = lg.project AND s.language = 'Python' AND s.type IN ('function', 'class') AND s.name = regexp_extract({_L(W.DJANGO_ROUTE, 3)}, '[^.]*$')), {_L(W.DJANGO_NAME, 1)}, '', 0
      FROM lg WHERE django AND language = 'Python' AND regexp_matches(line, {_re(W.DJANGO_ROUTE)})
    UNION ALL SELECT project, path, 'Express-style', upper({_L(W.EXPRESS_ROUTE, 1)}), {_L(W.EXPRESS_ROUTE, 2)}, line_no, (SELECT min_by(qualified_name, s.line_no) FROM sy s WHERE s.project = lg.project AND s.path = lg.path AND s.line_no <= lg.line_no AND s.name = regexp_extract({_L(W.EXPRESS_ROUTE, 3)}, '[^.]*$')), NULL, '', 0
      FROM lg WHERE language IN {_NOT(X.SCRIPTS)} AND regexp_matches(line, {_re(W.EXPRESS_ROUTE)})),
  rt AS (SELECT project, path, framework, method, route_path, line_no, handler, name, middleware FROM (SELECT *, row_number() OVER (PARTITION BY project, path, method, route_path, line_no ORDER BY list_position([{", ".join(f"'{w}'" for w in W.ORDER)}], framework) DESC, ord DESC) AS n FROM raw) WHERE n = 1)"""


def _routed(spark, sf_dir):
    """Files, lines, declared symbols and offered routes, the symbols written once as every framework asks for them."""
    files = code_files(spark, sf_dir)
    lines = kept(numbered(files))
    symbols = kept(X.declared(lines))
    return files, lines, symbols, W.offered(files, lines, symbols)


@query("x5_j12_routes", f"WITH {_FRAMEWORK_SQL} SELECT * FROM rt")
def routes(spark, sf_dir):
    """Routes of eight frameworks and Express-style calls, with the symbols that handle them."""
    _, _, symbols, found = _routed(spark, sf_dir)
    named = symbols.select("project", F.col("key").alias("handler_key"), F.col("qualified_name").alias("handler"))
    return W.routes(found).join(named, ["project", "handler_key"], "left").select("project", "path", "framework", "method", "route_path", "line_no", "handler", "name", F.array_join(F.array_sort("middleware"), "|").alias("middleware"))


@query("x5_roles", f"""WITH {_FRAMEWORK_SQL}, hn AS (SELECT DISTINCT project, path, handler AS qualified_name, framework = 'Next.js' AS every FROM raw WHERE framework IN ('FastAPI', 'Flask') OR framework = 'Next.js' AND regexp_matches(path, {_re(W.NEXT_HANDLER)}) AND upper(split_part(handler, '#', 2)) IN {_NOT(W.NEXT_METHODS)}),
  sig AS (SELECT sy.*, l.t, g.*, f.content, f.served, hn.qualified_name IS NOT NULL AND (hn.every OR sy.line_no = min(sy.line_no) OVER (PARTITION BY sy.project, sy.path, sy.type, sy.qualified_name)) AS handles FROM sy JOIN l USING (project, path, line_no) JOIN g USING (project) JOIN fg f USING (project, path) LEFT JOIN hn ON hn.project = sy.project AND hn.path = sy.path AND hn.qualified_name = sy.qualified_name),
  roles AS (SELECT project, path, line_no, qualified_name, CASE WHEN handles THEN 'route_handler' WHEN language = 'PHP' AND laravel AND type = 'class' AND path LIKE '%Http/Controllers/%' THEN 'controller' WHEN language = 'PHP' AND laravel AND type = 'class' AND (contains(content, 'extends Model') OR path LIKE '%Models/%') THEN 'model'
    WHEN language = 'PHP' AND laravel AND type = 'method' AND name = 'handle' AND path LIKE '%Http/Middleware/%' THEN 'middleware' WHEN language = 'TypeScript' AND next AND served IS NOT NULL AND regexp_matches(content, {_re(W.NEXT_SERVER)}) AND type IN ('function', 'component') THEN 'server_action'
    WHEN language = 'Python' AND fastapi AND type = 'class' AND regexp_matches(t, {_re(W.SCHEMA)}) THEN 'schema' WHEN language = 'Python' AND django AND type = 'class' AND regexp_matches(t, {_re(W.DJANGO_MODEL)}) THEN 'model' END AS role FROM sig)
 SELECT project, path, line_no AS start_line, role, qualified_name FROM roles WHERE role IS NOT NULL
 UNION ALL SELECT project, path, 1, 'component', path || '#' || regexp_extract(path, '([^/]*)\\.vue$', 1) FROM fg WHERE vue AND language = 'Vue' AND NOT EXISTS (SELECT 1 FROM sy s WHERE s.project = fg.project AND s.path = fg.path AND s.type = 'component')
 UNION ALL SELECT project, path, line_no, 'store', 'pinia:' || regexp_extract(line, {_re(W.VUE_STORE)}, 1) FROM lg WHERE vue AND regexp_matches(line, {_re(W.VUE_STORE)})""")
def roles(spark, sf_dir):
    """Symbols to which a framework gives another type, and those that it adds."""
    files, lines, symbols, found = _routed(spark, sf_dir)
    columns = ("project", "path", "start_line", "role", "qualified_name")
    added = W.added_symbols(files, lines, symbols).withColumnRenamed("type", "role").select(*columns)
    return W.retagged(files, symbols, found).filter("role is not null").select(*columns).unionByName(added)
