"""Sweeps and framework rules on small files, and cases that the registered files lack."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import extract, frameworks, sweep

SCHEMA = "project long, path string, language string, content string"


def frame(spark, *files):
    return spark.createDataFrame([(f if len(f) == 4 else (1, *f)) for f in files], SCHEMA).repartition(3)


def test_ends_and_owners_by_a_stack(spark):
    """Random well-formed scopes: ends and owners equal those of a stack."""
    rng = random.Random(6)
    lines, stack, want, ended = [], [], {}, {}
    for n in range(1, 301):
        want[n] = stack[-1][1] if stack else None
        if rng.random() < 0.35 and len(stack) < 8:
            stack.append((n, f"s{n}"))
            lines.append((1, "f", n, "open {", len(stack) - 1, len(stack)))
        elif stack and rng.random() < 0.6:
            drop = rng.randint(1, len(stack))
            for start, _ in stack[-drop:]:
                ended[start] = n
            lines.append((1, "f", n, "}" * drop, len(stack), len(stack) - drop))
            del stack[-drop:]
        else:
            lines.append((1, "f", n, "x", len(stack), len(stack)))
    rows = spark.createDataFrame(lines, "project long, path string, line_no int, line string, before int, after int").withColumn("top", F.col("before") - 1).repartition(4)
    scopes = rows.filter("line = 'open {'").select("project", "path", "line_no", F.col("before").alias("level"), F.struct(F.concat(F.lit("s"), F.col("line_no").cast("string")).alias("name")).alias("scope"), F.lit(False).alias("shut"))
    found = sweep.ends(scopes, rows, "after", "top")
    assert {r.line_no: r.end for r in found.collect()} == {r.line_no: ended.get(r.line_no) for r in scopes.collect()}
    assert {r.line_no: r.o and r.o["name"] for r in sweep.owners(rows, found, "o").collect()} == want


def test_braces_that_stand_apart_or_in_strings(spark):
    code = "<?php\nclass A\n{\n  function one()\n  {\n    $s = '}'; // }\n    two(\"{\");\n  }\n  abstract function gone();\n  function three() { four(); }\n}\nfive();\n"
    symbols, edges = extract.facts(sweep.numbered(frame(spark, ("a.php", "PHP", code))))
    assert {(r.type, r.qualified_name, r.start_line, r.end_line) for r in symbols.collect()} == {("module", "a.php", 1, 13), ("class", "A", 2, 11), ("method", "A::one", 4, 8), ("method", "A::gone", 9, 9), ("method", "A::three", 10, 10)}
    assert {(r.source, r.target, r.line_no) for r in edges.collect()} == {("A::one", "two", 7), ("a.php", "five", 12)}


def test_indents_and_decorators(spark):
    code = "class A:\n    @prop\n    def b(self):\n\n        c()\n  \n    def d(self): pass\n\tx()\ne()\n"
    symbols, edges = extract.facts(sweep.numbered(frame(spark, ("a.py", "Python", code))))
    assert {(r.type, r.qualified_name, r.start_line, r.end_line) for r in symbols.collect()} == {("module", "a.py", 1, 10), ("class", "a.py#A", 1, 8), ("method", "A.b", 3, 6), ("method", "A.d", 7, 7)}
    assert {(r.source, r.target, r.line_no) for r in edges.collect()} == {("A.b", "c", 5), ("a.py#A", "x", 8), ("a.py", "e", 9)}


def test_nothing_to_extract(spark):
    symbols, edges = extract.facts(sweep.numbered(frame(spark, ("a.php", "PHP", None), ("b.py", "Python", ""), ("c.md", "Markdown", "class A {}"))))
    assert {(r.type, r.path) for r in symbols.collect()} == {("module", p) for p in ("a.php", "b.py", "c.md")} and edges.isEmpty()
    none = spark.createDataFrame([], SCHEMA)
    lines = sweep.numbered(none)
    symbols, edges = extract.facts(lines)
    assert symbols.isEmpty() and edges.isEmpty() and frameworks.offered(none, lines, symbols).isEmpty()


def test_same_path_in_two_projects(spark):
    files = [(k, "a.ts", "TypeScript", f"export class C{k} {{\n  m() {{ run() }}") for k in (1, 2)]
    _, edges = extract.facts(sweep.numbered(frame(spark, *files)))
    assert {(r.project, r.source) for r in edges.collect()} == {(k, f"a.ts#C{k}") for k in (1, 2)}


def routed(spark, *files):
    files = frame(spark, *files)
    lines = sweep.numbered(files)
    symbols = extract.symbols(lines)
    found = frameworks.offered(files, lines, symbols)
    names = {r.key: r.qualified_name for r in symbols.collect()}
    routes = {(r.framework, r.method, r.route_path, names.get(r.handler_key)) for r in frameworks.routes(found).collect()}
    return routes, {(r.qualified_name, r.role) for r in frameworks.retagged(files, symbols, found).filter("role is not null").collect()}, {(r.type, r.qualified_name) for r in frameworks.added_symbols(files, lines, symbols).collect()}


@pytest.mark.parametrize("known", [True, False])
def test_next_and_react(spark, known):
    manifest = '{"dependencies": {"next": "15", "react": "19"}}' if known else '{"dependencies": {"next": null}}'
    routes, roles, _ = routed(
        spark, ("package.json", "JSON", manifest), ("app/(g)/shop/[id]/page.tsx", "TypeScript", "export default function Page() { return <A/> }"), ("app/api/x/route.ts", "TypeScript", "export function get(r) {}\nexport const POST = (r) => r"),
        ("pages/docs/[...all].js", "JavaScript", "'use server'\nfunction act() {}"), ("src/r.tsx", "TypeScript", "function Home() {}\n<Route path='h//x' element={<Home/>} />"),
    )
    want = {("Next.js", "GET", "/shop/:id", "app/(g)/shop/[id]/page.tsx#Page"), ("Next.js", "GET", "/api/x", "app/api/x/route.ts#get"), ("Next.js", "POST", "/api/x", "app/api/x/route.ts#POST"), ("Next.js", "GET", "/docs/:all*", "pages/docs/[...all].js#act"), ("React Router", "GET", "/h/x", "src/r.tsx#Home")}
    assert routes == (want if known else set())
    assert roles == ({("app/api/x/route.ts#get", "route_handler"), ("app/api/x/route.ts#POST", "route_handler"), ("pages/docs/[...all].js#act", "server_action")} if known else set())


def test_python_frameworks(spark):
    code = "from fastapi import FastAPI\nfrom flask import Flask\nfrom django.db import models\n@app.get('/a')\n@other\ndef near(): pass\n@router.post('/b', deps=[Depends(x)])\n\n\n\n\ndef far(): pass\nclass M(models.Model):\n    pass\nclass S(BaseModel):\n    pass\npath('p/', v.far)\n@app.route('/f', methods=[\"PUT\"])\ndef put(): pass\n"
    routes, roles, _ = routed(spark, ("m.py", "Python", code), ("tests/t.py", "Python", "@app.route('/no')\ndef no(): pass"))
    assert routes == {("Flask", "GET", "/a", "m.py#near"), ("FastAPI", "POST", "/b", None), ("Django", "ANY", "/p/", "m.py#far"), ("Flask", "PUT", "/f", "m.py#put")}
    assert roles == {("m.py#near", "route_handler"), ("m.py#put", "route_handler"), ("m.py#M", "model"), ("m.py#S", "schema")}


def test_php_and_vue(spark):
    laravel = (1, "composer.json", "JSON", '{"require": {"laravel/framework": "12"}}')
    files = [(p, "public/index.php", "PHP", "<?php is_post ();") for p in (1, 2)] + [
        (1, "routes/web.php", "PHP", "Route::get('/u', [UserController::class, 'show'])->name('u')->middleware(['a','b']);"), (1, "app/Http/Controllers/UserController.php", "PHP", "class UserController {\n  function show() {}\n}"),
        (1, "app/Http/Middleware/Log.php", "PHP", "class Log {\n  function handle() {}\n}"), (1, "app/User.php", "PHP", "class User extends Model {}"),
        (3, "package.json", "JSON", '{"devDependencies": {"vue": "3"}}'), (3, "ui/Card.vue", "Vue", "<template/>"), (3, "ui/Own.vue", "Vue", "export default function Own() {}"), (3, "s.ts", "TypeScript", "const s = defineStore('cart', {})\n{ path: 'x' }"),
    ]
    routes, roles, added = routed(spark, laravel, *files)
    assert routes == {("Plain PHP", "ANY", "/", "public/index.php"), ("Laravel", "GET", "/u", "UserController::show"), ("Vue Router", "GET", "/x", None)}
    assert roles == {("UserController", "controller"), ("Log::handle", "middleware"), ("User", "model")}
    assert added == {("component", "ui/Card.vue#Card"), ("store", "pinia:cart")}
