"""Columns that classify source paths: language, role, runtime standing, change area, routes and hosts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names, patterns and their order decide results and are stated as they are.
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "php": "PHP", "py": "Python", "vue": "Vue",
    "svelte": "Svelte", "sql": "SQL", "json": "JSON", "yml": "YAML", "yaml": "YAML", "css": "CSS", "scss": "CSS", "html": "HTML",
    "md": "Markdown", "go": "Go", "rb": "Ruby",
}
TEXT_EXTENSIONS = ("php", "js", "jsx", "ts", "tsx", "py", "rb", "go", "java", "cs", "rs", "vue", "svelte", "json", "yml", "yaml", "toml", "sql", "md", "html", "css", "scss", "sh", "env")
TEXT_FILES = ("Dockerfile", "Procfile", "Makefile", ".env.example")
CODE_EXTENSIONS = ("php", "js", "jsx", "ts", "tsx", "py", "rb", "go", "java", "cs")
CONFIG_FILES = ("package.json", "composer.json", "requirements.txt", "Dockerfile", "vercel.json", "docker-compose.yml")
SUMMARIES = {
    "route": "This file defines a page or route that users can reach in the application.",
    "api endpoint": "This file exposes server-side work that another part of the application can call.",
    "middleware": "This file runs before selected requests and can protect, redirect, or reshape them.",
    "authentication": "This file participates in identifying users or keeping them signed in.",
    "data model": "This file describes, queries, or changes data that the application depends on.",
    "configuration": "This file tells tooling or hosting platforms how the project should run.",
    "ui component": "This is a reusable piece of the user interface that other screens can include.",
}
PLAIN_SUMMARY = "This is a source file that contributes application behavior or presentation."
SUPPORT = (
    r"(^|/)(?:tests?|specs?|fixtures?|benchmarks?|docs?|examples?|tools?|scripts?|reports?|snapshots?|generators?|loadgenerators?|storage|vendor|node_modules|analysis|analyzers?|detectors?|\.playwright-cli)(/|$)",
    r"(^|/)config/(?:security|rules?)(/|$)|(^|/)(?:rules?|generated|output|artifacts?)(/|$)",
    r"(?:^|/)(?:readme|changelog|license)(?:\.[^/]+)?$|\.(?:md|css|scss|html|blade\.php|snap|snapshot|log)$",
)
BEHAVIOR = r"(?i)\.(?:php|js|jsx|mjs|cjs|ts|tsx|py|rb|go|java|cs|rs|vue|svelte)$"
AREAS = (
    ("Authentication and access", r"(?:auth|login|session|middleware|guard)"),
    ("Data and schema", r"(?:migration|schema|prisma|database|\.sql$|model)"),
    ("Configuration and dependencies", r"(?:package\.json|composer\.json|requirements|\.env|docker|vercel|config|lock)"),
    ("API and server behavior", r"(?:api|route|controller|endpoint)"),
    ("User interface", r"(?:component|page|view|\.css$|\.scss$)"),
    ("Tests", r"(?:test|spec)"),
    ("Documentation", r"(?:readme|\.md$|docs)"),
)
OTHER_AREA = "Application code"
SENSITIVE_AREA = r"(?:auth|login|session|middleware|guard|migration|schema|prisma|database|\.sql$|\.env|docker|vercel|config)"
SENSITIVE_PATH = r"(?i)(?:^|[/._-])(?:auth|authentication|authorization|login|session|middleware|guard|migrations?|schema|database|config|configuration|\.env)(?:[/._-]|$)"
INTENT = (
    ("Authentication and access", r"(?i)auth|login|oauth|session|password|permission"),
    ("Data and schema", r"(?i)database|schema|table|column|migration|data"),
    ("Configuration and dependencies", r"(?i)dependenc(?:y|ies)|package|config|deploy|docker|environment"),
    ("API and server behavior", r"(?i)api|route|endpoint|webhook|server"),
    ("User interface", r"(?i)ui|frontend|component|page|button|form|style"),
    ("Tests", r"(?i)test|spec|coverage"),
    ("Documentation", r"(?i)readme|docs|documentation"),
)
ECOSYSTEMS = {
    "javascript": "npm", "node": "npm", "npm": "npm", "php": "Packagist", "composer": "Packagist", "python": "PyPI", "pypi": "PyPI",
    "go-module": "Go", "golang": "Go", "go": "Go", "rust": "crates.io", "cargo": "crates.io", "java": "Maven", "maven": "Maven",
}
LOCK_FILES = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|poetry\.lock|Pipfile\.lock|Cargo\.lock|go\.sum|gradle\.lockfile)$"
MANIFESTS = r"(?i)(?:^|/)(?:package\.json|composer\.json|requirements[^/]*\.txt|pyproject\.toml|Pipfile|Cargo\.toml|go\.mod|pom\.xml|build\.gradle)$"


def first_of(rules, default: str | None) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, holds in rules:
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return out.otherwise(F.lit(default))


def names_of(rules) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def slashes(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def readable(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS) | base_name(path).isin(*TEXT_FILES)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    ext = extension(path)
    return F.when(base_name(path) == "Dockerfile", "Docker").when(ext == "", "Configuration").otherwise(F.coalesce(F.try_element_at(known, ext), F.upper(ext)))


def role(path: Column, content: Column) -> Column:
    low, ext = slashes(path), extension(path)
    prose = ext == "md"
    rules = [
        ("route", low.rlike(r"(^|/)(app|pages)/.+(page|route)\.(tsx?|jsx?)$") | low.contains("routes/")),
        ("api endpoint", (~prose & content.rlike(r"(?i)@(app|router)\.(get|post|put|patch|delete)")) | low.contains("api/")),
        ("middleware", low.contains("middleware")),
        (
            "authentication",
            low.contains("auth")
            | (ext.isin(*CODE_EXTENSIONS) & content.rlike(r"(?i)(?:password_(?:hash|verify)|session_start\s*\(|\bBearer\s+|supabase\.auth\.(?:signIn|signUp|getUser|onAuthStateChange)|nextauth/|firebase\.auth\(\))")),
        ),
        ("data model", low.contains("model") | low.contains("schema") | (~prose & content.rlike(r"(?i)(CREATE TABLE|prisma|sequelize|mongoose)"))),
        ("configuration", base_name(path).isin(*CONFIG_FILES)),
        ("ui component", low.rlike(r"(^|/)(components?|ui)/")),
    ]
    return first_of(rules, "source")


def summary(role_: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SUMMARIES.items() for x in pair]), role_), F.lit(PLAIN_SUMMARY))


def is_runtime(path: Column) -> Column:
    low = slashes(path)
    return ~(low.rlike(SUPPORT[0]) | low.rlike(SUPPORT[1]) | low.rlike(SUPPORT[2]))


def is_runtime_behavior(path: Column) -> Column:
    return is_runtime(path) & path.rlike(BEHAVIOR)


def area(path: Column) -> Column:
    return first_of([(n, F.lower(path).rlike(p)) for n, p in AREAS], OTHER_AREA)


def change_risk(path: Column, status: Column) -> Column:
    return F.when(status.startswith("D"), "Removed file").when(F.lower(path).rlike(SENSITIVE_AREA), "Sensitive area")


def is_sensitive(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"([a-z0-9])([A-Z])", "$1/$2").rlike(SENSITIVE_PATH)


def expected_areas(intent: Column) -> Column:
    text = F.trim(F.substring(intent, 1, 500))
    named = names_of([(n, text.rlike(p)) for n, p in INTENT])
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(named) == 0, F.array(F.lit(OTHER_AREA))).otherwise(named)


def web_path(path: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, "^/+", "")), "/+", "/")


def file_route(path: Column) -> Column:
    """The web path that a page or route file serves; null for other files."""
    app = F.regexp_extract(path, r"(?i)^app/(.+/)?(?:page|route)\.(?:jsx?|tsx?)$", 1)
    pages = F.regexp_extract(path, r"(?i)^pages/(?:api/)?(.+)\.(?:jsx?|tsx?)$", 1)
    raw = F.when(path.rlike(r"(?i)^app/(.+/)?(?:page|route)\.(?:jsx?|tsx?)$"), app).when(path.rlike(r"(?i)^pages/(?:api/)?(.+)\.(?:jsx?|tsx?)$"), pages)
    for pattern, to in ((r"\([^/]+\)/", ""), (r"\[\.\.\.([A-Za-z0-9_]+)\]", ":$1*"), (r"\[([A-Za-z0-9_]+)\]", ":$1"), (r"(?i)/(?:index)$", ""), (r"/+$", "")):
        raw = F.regexp_replace(raw, pattern, to)
    return web_path(raw)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), url)


def repository_url(url: Column) -> Column:
    """The clone address of a public repository page, or null where the address is not a plain one."""
    url = F.trim(url)
    path = F.regexp_extract(url, r"(?i)^https://github\.com(?::443)?/+([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)/*$", 1)
    return F.when(path != "", F.concat(F.lit("https://github.com/"), path, F.when(path.endswith(".git"), "").otherwise(".git")))


def split_route(target: Column) -> Column:
    """Method (null where absent) and path of 'POST /x'."""
    method = F.upper(F.regexp_extract(target, r"(?i)^\s*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ANY)\s+(\S.*)$", 1))
    path = F.regexp_extract(target, r"(?i)^\s*(?:(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|ANY)\s+)?(.*?)\s*$", 1)
    return F.struct(F.when(method != "", method).alias("method"), path.alias("path"))


def ecosystem(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ECOSYSTEMS.items() for x in pair]), F.lower(kind)), F.substring(kind, 1, 80))


def package_class(locations: Column) -> Column:
    return F.when(F.exists(locations, lambda p: p.rlike(LOCK_FILES)), "resolved").when(F.exists(locations, lambda p: p.rlike(MANIFESTS)), "declared").otherwise("detected")


def folded(path: Column) -> Column:
    """A relative path with '.' and '..' steps resolved."""
    steps = F.split(F.translate(path, "\\", "/"), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.array_join(kept, "/")


#: Endings tried in this order when an import names no file.
IMPORT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".php", ".py", ".json", ".css", "/index.ts", "/index.tsx", "/index.js", "/index.php")


def import_candidates(source: Column, target: Column) -> Column:
    """Paths that a relative import may mean, best first; empty for imports of other kinds."""
    folder = F.regexp_extract(source, r"^(.*)/[^/]*$", 1)
    base = folded(F.concat(folder, F.lit("/"), target))
    return F.when(target.startswith("."), F.array(*(F.concat(base, F.lit(e)) for e in IMPORT_ENDINGS))).otherwise(F.array().cast("array<string>"))
