"""Routes and roles that web frameworks give to files and symbols.

A framework's rules apply in projects that show it: through a manifest's dependency, a route file, or a phrase in a Python
file. Handlers are symbols: the next function after a decorator (within four lines), or the first symbol of a name in the
project by path and line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions import paths
from tracewright.operators.extract import SCRIPTS, _every, _one
from tracewright.operators.graph import kept
from tracewright.operators.sweep import FILE

# What shows a framework, and how its routes and roles look.
DEPENDENCY_GROUPS = ("dependencies", "devDependencies", "require", "require-dev")
LARAVEL_FILE = r"(?i)^routes/(?:web|api|console)\.php$"
LARAVEL_ROUTE = r"(?i)Route::(get|post|put|patch|delete|options|any|match|resource|apiResource)\s*\(\s*['\"]([^'\"]+)['\"]\s*,?\s*(.*)$"
LARAVEL_METHOD = r"([A-Za-z_][A-Za-z0-9_]*(?:\\[A-Za-z_][A-Za-z0-9_]*)*)::class\s*,\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]"
LARAVEL_NAMED = r"['\"]([A-Za-z_][A-Za-z0-9_]*(?:\\[A-Za-z_][A-Za-z0-9_]*)*)@([A-Za-z_][A-Za-z0-9_]*)['\"]"
LARAVEL_MIDDLEWARE = r"->middleware\s*\(\s*(?:\[([^]]+)\]|['\"]([^'\"]+)['\"])"
LARAVEL_NAME = r"->name\s*\(\s*['\"]([^'\"]+)['\"]"
PUBLIC_FILE = r"(?i)^public/([^/]+)\.php$"
POSTED = r"\$_POST|is_post\s*\("
REACT_ROUTE = r"(?i)<Route\b[^>]*\bpath=['\"]([^'\"]+)['\"][^>]*>"
REACT_ELEMENT = r"\belement=\{?\s*<([A-Z][A-Za-z0-9_]*)"
NEXT_HANDLER = r"(?i)/(?:route|api/[^/]+)\.(?:jsx?|tsx?)$"
NEXT_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")
NEXT_SERVER = r"['\"]use server['\"]\s*;?"
VUE_STORE = r"defineStore\s*\(\s*['\"]([^'\"]+)['\"]"
VUE_ROUTE = r"\bpath\s*:\s*['\"]([^'\"]+)['\"]"
FASTAPI = r"\b(?:from\s+fastapi\s+import|FastAPI\s*\()"
FASTAPI_ROUTE = r"(?i)@(?:app|router)\.(get|post|put|patch|delete|options|head)\s*\(\s*['\"]([^'\"]+)['\"]([^)]*)\)"
PY_HANDLER = r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"
SCHEMA = r"class\s+\w+\s*\([^)]*(?:BaseModel|SQLModel)"
DJANGO = r"\b(?:django\.|from\s+django|DJANGO_SETTINGS_MODULE)"
DJANGO_ROUTE = r"\b(path|re_path)\s*\(\s*[rR]?['\"]([^'\"]*)['\"]\s*,\s*([A-Za-z_][A-Za-z0-9_.]*)"
DJANGO_NAME = r"\bname\s*=\s*['\"]([^'\"]+)['\"]"
DJANGO_MODEL = r"class\s+\w+\s*\([^)]*models\.Model"
FLASK = r"\b(?:from\s+flask\s+import|import\s+flask\b|Flask\s*\()"
FLASK_ROUTE = r"(?i)@(?:app|blueprint|bp)\.route\s*\(\s*['\"]([^'\"]+)['\"]([^)]*)\)|@(?:app|blueprint|bp)\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)['\"]"
FLASK_METHOD = r"(?i)methods\s*=\s*\[\s*['\"]([A-Z]+)"
EXPRESS_ROUTE = r"(?i)\b(?:app|router)\.(get|post|put|patch|delete|options|head|all)\(\s*['\"]([^'\"]+)['\"]\s*,\s*([A-Za-z_$][A-Za-z0-9_$.]*)?"
REACH = 4

ROUTE_COLUMNS = (*FILE, "framework", "method", "route_path", "line_no", "handler_key", "handler_name", "name", "middleware", "confidence")


def _depends(manifest: str, dependency: str) -> Column:
    stated = [F.get_json_object("content", f"$['{group}']['{dependency}']").isNotNull() for group in DEPENDENCY_GROUPS]
    return (paths.base_name(F.col("path")) == manifest) & reduce(Column.__or__, stated)


def detected(files: DataFrame) -> DataFrame:
    """(project, framework) for each framework that a project shows; checkpointed, as every rule asks for it."""
    python = F.col("language") == "Python"
    signs = {
        "laravel/framework": _depends("composer.json", "laravel/framework"), "Laravel": _depends("composer.json", "laravel/framework") | F.col("path").rlike(LARAVEL_FILE), "React": _depends("package.json", "react"),
        "Next.js": _depends("package.json", "next"), "Vue": _depends("package.json", "vue"), "FastAPI": python & F.col("content").rlike(FASTAPI), "Django": python & F.col("content").rlike(DJANGO), "Flask": python & F.col("content").rlike(FLASK),
    }
    seen = files.groupBy("project").agg(*(F.coalesce(F.bool_or(sign), F.lit(False)).alias(name) for name, sign in signs.items()))
    return kept(seen.select("project", F.explode(F.array_compact(F.array(*(F.when(F.col(f"`{n}`"), F.lit(n)) for n in signs)))).alias("framework")))


def _in(rows: DataFrame, frameworks: DataFrame, name: str) -> DataFrame:
    return rows.join(frameworks.filter(F.col("framework") == name).select("project"), "project", "left_semi")


def _route(rows: DataFrame, framework: str, method: Column, route: Column, **more: Column) -> DataFrame:
    given = {"order": F.lit(0), "line_no": F.col("line_no"), "handler_key": F.lit(None).cast("string"), "handler_name": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "middleware": F.array().cast("array<string>"), "confidence": F.lit("high")} | more
    return rows.select(*FILE, F.lit(framework).alias("framework"), F.upper(method).alias("method"), route.alias("route_path"), *(given[c].alias(c) for c in (*ROUTE_COLUMNS[5:], "order")))


def _first(symbols: DataFrame, kinds: tuple[str, ...], by: list[str]) -> DataFrame:
    """The first symbol of each name by path, line and key: (by..., found)."""
    return symbols.filter(F.col("type").isin(*kinds)).groupBy(*by).agg(F.min_by("key", F.struct("path", "start_line", "key")).alias("found"))


def _next_def(lines: DataFrame) -> DataFrame:
    """Lines with the function that the next def within reach declares (null if there is none)."""
    later = W.partitionBy(*FILE).orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, -1)
    named = F.when(F.col("line").rlike(PY_HANDLER), F.struct(F.regexp_extract("line", PY_HANDLER, 1).alias("name"), F.col("line_no").alias("at")))
    near = F.last(named, ignorenulls=True).over(later)
    return lines.withColumn("near", near).withColumn("near", F.when(F.col("near.at") <= F.col("line_no") + REACH, F.col("near.name")))


def _decorated(lines: DataFrame, symbols: DataFrame, framework: str, method: Column, route: Column) -> DataFrame:
    """Routes of decorator lines; the handler is a function of that name in the file."""
    handlers = _first(symbols, ("function",), [*FILE, "name"]).withColumnRenamed("name", "near")
    return _route(lines.join(handlers, [*FILE, "near"], "left"), framework, method, route, handler_key=F.col("found"), handler_name=F.col("near"))


def telling(lines: DataFrame) -> DataFrame:
    """Lines that a rule of ``offered`` may read: those that look like a route, and the defs that follow decorators."""
    line, language = F.col("line"), F.col("language")
    rules = {("PHP",): (LARAVEL_ROUTE,), ("Python",): (FASTAPI_ROUTE, FLASK_ROUTE, DJANGO_ROUTE, PY_HANDLER), ("JavaScript", "TypeScript"): (REACT_ROUTE,), SCRIPTS: (EXPRESS_ROUTE,)}
    return lines.filter(reduce(Column.__or__, (language.isin(*names) & line.rlike(p) for names, patterns in rules.items() for p in patterns)) | line.rlike(VUE_ROUTE))


def offered(files: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes as each framework's rules offer them: ROUTE_COLUMNS and order, in which a framework names several of one identity."""
    known = detected(files)
    lines = kept(telling(lines))
    php, python, scripts = (lines.filter(F.col("language").isin(*names)) for names in (("PHP",), ("Python",), ("JavaScript", "TypeScript")))
    line, web = F.col("line"), paths.web_path
    out = []

    public = files.filter((F.col("language") == "PHP") & F.translate("path", "\\", "/").rlike(PUBLIC_FILE)).join(known.filter("framework = 'laravel/framework'").select("project"), "project", "left_anti")
    page = F.regexp_extract(F.translate("path", "\\", "/"), PUBLIC_FILE, 1)
    module = F.sha2(F.concat_ws("|", "path", F.lit("module"), "path", F.lit("1")), 256)
    out.append(_route(public, "Plain PHP", F.when(F.coalesce("content", F.lit("")).rlike(POSTED), "ANY").otherwise("GET"), F.when(F.lower(page) == "index", "/").otherwise(F.concat(F.lit("/"), page, F.lit(".php"))), line_no=F.lit(1), handler_key=module, handler_name=paths.base_name(F.col("path"))))

    laravel = _in(php.filter(line.rlike(LARAVEL_ROUTE)), known, "Laravel").withColumn("tail", F.regexp_extract("line", LARAVEL_ROUTE, 3))
    laravel = laravel.withColumn("called", _one(LARAVEL_METHOD, 2, "tail")).join(_first(symbols.filter("language = 'PHP'"), ("method",), ["project", "name"]).withColumnRenamed("name", "called"), ["project", "called"], "left")
    listed, single = _one(LARAVEL_MIDDLEWARE, 1, "line"), _one(LARAVEL_MIDDLEWARE, 2, "line")
    names = F.regexp_extract_all(listed, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))
    middleware = F.when(listed.isNotNull(), F.when(F.size(names) > 0, names).otherwise(F.array(listed))).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))
    handler = F.coalesce("called", _one(LARAVEL_NAMED, 2, "tail"))
    out.append(_route(laravel, "Laravel", F.regexp_extract("line", LARAVEL_ROUTE, 1), web(F.regexp_extract("line", LARAVEL_ROUTE, 2)), handler_key=F.col("found"), handler_name=handler, name=_one(LARAVEL_NAME, 1, "line"), middleware=F.array_distinct(middleware)))

    react = _in(scripts.filter(line.rlike(REACT_ROUTE)), known, "React").withColumn("element", _one(REACT_ELEMENT, 1, "line"))
    react = react.join(_first(symbols, ("component",), [*FILE, "name"]).withColumnRenamed("name", "element"), [*FILE, "element"], "left")
    out.append(_route(react, "React Router", F.lit("GET"), web(F.regexp_extract("line", REACT_ROUTE, 1)), handler_key=F.col("found"), handler_name=F.col("element")))

    served = _in(files.filter(F.col("language").isin("JavaScript", "TypeScript")), known, "Next.js").withColumn("route", paths.file_route(F.translate("path", "\\", "/"))).filter("route is not null").withColumn("handling", F.col("path").rlike(NEXT_HANDLER))
    own = symbols.filter(F.col("language").isin("JavaScript", "TypeScript")).select(*FILE, F.col("name").alias("symbol"), "type", "key", "start_line")
    verbs = served.filter("handling").join(own.filter(F.upper("symbol").isin(*NEXT_METHODS)), [*FILE])
    out.append(_route(verbs, "Next.js", F.col("symbol"), F.col("route"), line_no=F.lit(1), handler_key=F.col("key"), handler_name=F.col("symbol"), order=F.col("start_line")))
    plain = served.join(verbs.select(*FILE).distinct(), [*FILE], "left_anti")
    shown = own.filter(F.col("type").isin("component", "function")).groupBy(*FILE).agg(F.min_by(F.struct("key", "symbol"), F.struct("start_line", "key")).alias("shown"))
    out.append(_route(plain.join(shown, [*FILE], "left"), "Next.js", F.lit("GET"), F.col("route"), line_no=F.lit(1), handler_key=F.col("shown.key"), handler_name=F.col("shown.symbol")))

    vue = _in(lines.filter(line.rlike(VUE_ROUTE)), known, "Vue")
    out.append(_route(vue, "Vue Router", F.lit("GET"), web(F.regexp_extract("line", VUE_ROUTE, 1)), confidence=F.lit("medium")))

    near = _next_def(python)
    fast = _in(near.filter(line.rlike(FASTAPI_ROUTE)), known, "FastAPI")
    out.append(_decorated(fast, symbols, "FastAPI", F.regexp_extract("line", FASTAPI_ROUTE, 1), web(F.regexp_extract("line", FASTAPI_ROUTE, 2))))
    flask = _in(near.filter(line.rlike(FLASK_ROUTE) & paths.is_runtime(F.col("path"))), known, "Flask")
    method = F.coalesce(_one(FLASK_ROUTE, 3, "line"), F.regexp_extract(F.regexp_extract("line", FLASK_ROUTE, 2), FLASK_METHOD, 1))
    out.append(_decorated(flask, symbols, "Flask", F.when(method != "", method).otherwise("ANY"), web(F.coalesce(_one(FLASK_ROUTE, 1, "line"), _one(FLASK_ROUTE, 4, "line"), F.lit("/")))))

    django = _in(python.filter(line.rlike(DJANGO_ROUTE)), known, "Django").withColumn("view", F.regexp_extract("line", DJANGO_ROUTE, 3)).withColumn("called", F.regexp_extract(F.regexp_replace("view", r"\.+$", ""), r"([^.]*)$", 1))
    django = django.join(_first(symbols.filter("language = 'Python'"), ("function", "class"), ["project", "name"]).withColumnRenamed("name", "called"), ["project", "called"], "left")
    out.append(_route(django, "Django", F.lit("ANY"), web(F.regexp_extract("line", DJANGO_ROUTE, 2)), handler_key=F.col("found"), handler_name=F.col("view"), name=_one(DJANGO_NAME, 1, "line")))

    express = lines.filter(F.col("language").isin(*SCRIPTS) & line.rlike(EXPRESS_ROUTE)).withColumn("called", F.regexp_extract(F.regexp_replace(F.regexp_extract("line", EXPRESS_ROUTE, 3), r"\.+$", ""), r"([^.]*)$", 1))
    before = symbols.select(*FILE, F.col("name").alias("called"), "key", "start_line")
    met = express.join(before, [*FILE, "called"], "left").groupBy(*FILE, "line_no", "line", "called").agg(F.min_by("key", F.when(F.col("start_line") <= F.col("line_no"), F.struct("start_line", "key"))).alias("found"))
    out.append(_route(met, "Express-style", F.regexp_extract("line", EXPRESS_ROUTE, 1), F.regexp_extract("line", EXPRESS_ROUTE, 2), handler_key=F.col("found"), handler_name=F.when(F.col("called") != "", F.col("called"))))
    return kept(reduce(DataFrame.unionByName, out))


#: The order in which frameworks speak; of one identity the last route stays.
ORDER = ("Express-style", "Plain PHP", "Laravel", "React Router", "Next.js", "Vue Router", "FastAPI", "Django", "Flask")


def routes(found: DataFrame) -> DataFrame:
    """Of the offered routes one for each (path, method, route, line): ROUTE_COLUMNS."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("framework"))
    identity = (*FILE, "method", "route_path", "line_no")
    rest = [c for c in ROUTE_COLUMNS if c not in identity]
    last = found.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.struct(place, "order", F.coalesce("handler_key", F.lit("")))).alias("r"))
    return last.select(*identity, "r.*").select(*ROUTE_COLUMNS)


def retagged(files: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols with the type that their framework gives them, and role (null where it gives none).

    ``found`` are the offered routes: functions that FastAPI, Flask or a Next.js route file names as handlers become route handlers.
    """
    known = detected(files).groupBy("project").agg(F.collect_set("framework").alias("frameworks"))
    texts = files.select(*FILE, F.coalesce("content", F.lit("")).contains("extends Model").alias("extends_model"), F.coalesce("content", F.lit("")).rlike(NEXT_SERVER).alias("server"), paths.file_route(F.translate("path", "\\", "/")).isNotNull().alias("served"))
    handlers = found.filter(F.col("framework").isin("FastAPI", "Flask") | (F.col("framework") == "Next.js") & F.upper("handler_name").isin(*NEXT_METHODS) & F.col("path").rlike(NEXT_HANDLER)).select("project", F.col("handler_key").alias("key"), F.lit(True).alias("handles")).filter("key is not null").distinct()
    rows = symbols.join(known, "project", "left").join(texts, [*FILE], "left").join(handlers, ["project", "key"], "left")
    shows = lambda name: F.coalesce(F.array_contains("frameworks", name), F.lit(False))
    php, python, script = F.col("language") == "PHP", F.col("language") == "Python", F.col("language").isin("JavaScript", "TypeScript")
    kind, path, signature = F.col("type"), F.col("path"), F.coalesce("signature", F.lit(""))
    role = (
        F.when(F.coalesce("handles", F.lit(False)), "route_handler")
        .when(php & shows("Laravel") & (kind == "class") & path.rlike(r"(?i)(^|/)Http/Controllers?/"), "controller").when(php & shows("Laravel") & (kind == "class") & (F.col("extends_model") | path.rlike(r"(?i)(^|/)Models?/")), "model")
        .when(php & shows("Laravel") & (kind == "method") & (F.col("name") == "handle") & path.rlike(r"(?i)(^|/)Http/Middleware/"), "middleware")
        .when(script & shows("Next.js") & F.col("served") & F.col("server") & kind.isin("function", "component"), "server_action")
        .when(python & shows("FastAPI") & (kind == "class") & signature.rlike(SCHEMA), "schema").when(python & shows("Django") & (kind == "class") & signature.rlike(DJANGO_MODEL), "model")
    )
    return rows.withColumn("role", role).withColumn("type", F.coalesce("role", "type")).select(*symbols.columns, "role")


def added_symbols(files: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a framework adds in Vue projects: a component for each single file that declares none, and stores."""
    known = detected(files)
    single = _in(files.filter("language = 'Vue'"), known, "Vue").join(symbols.filter("type = 'component'").select(*FILE).distinct(), [*FILE], "left_anti")
    name = F.regexp_replace(paths.base_name(F.col("path")), r"\.[^.]*$", "")
    components = single.select(*FILE, F.lit("component").alias("type"), name.alias("name"), F.concat("path", F.lit("#"), name).alias("qualified_name"), F.lit(1).alias("start_line"))
    stores = _in(lines.filter(F.col("line").rlike(VUE_STORE)), known, "Vue").select(*FILE, F.lit("store").alias("type"), F.explode(F.slice(_every(VUE_STORE), 1, 1)).alias("name"), "line_no")
    return components.unionByName(stores.select(*FILE, "type", "name", F.concat(F.lit("pinia:"), "name").alias("qualified_name"), F.col("line_no").alias("start_line")))
