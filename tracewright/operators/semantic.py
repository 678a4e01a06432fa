"""What changed in meaning between two versions of a project: routes, schema, dependencies, security, environment, areas.

Versions are rows of (project, ref, path, content). Only files that differ between the two refs count; a renamed file is one
path that went and one that came. A fact is known by the hash of its kind and wording, wherever it stands, so a fact that
moves is no change. Of facts with one identity in a version the last by path, line and place in the line is told.

Null contents are files that are not there. Empty ones state no facts but their area. Work is one pass over the lines of
changed files and one shuffle of their facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions import paths, text

# Results depend on these patterns.
ROUTES = (
    r"(?i)(?:Route::|\b(?:app|router)\.)(get|post|put|patch|delete|options|head)\s*\(\s*['\"]([^'\"]+)",
    r"(?i)@(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*['\"]([^'\"]+)",
)
FILE_ROUTE = r"(?i)(?:^|/)(?:app|pages)/api/(.+?)/(?:route|index)\.(?:js|ts|tsx|jsx)$"
FILE_METHOD = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)"
FILE_PARAMETER = r"\[(?:\.\.\.)?([^\]]+)\]"
TABLE = r"(?i)\b(CREATE|ALTER|DROP)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?[`\"\[]?([A-Za-z_][A-Za-z0-9_.]*)"
COLUMN = r"(?i)\b(?:ADD|DROP|RENAME|ALTER)\s+(?:COLUMN\s+)?[`\"\[]?([A-Za-z_][A-Za-z0-9_]*)"
ENVIRONMENT = r"(?:process\.env\.|import\.meta\.env\.|getenv\s*\(\s*['\"]|env\s*\(\s*['\"]|os\.(?:getenv|environ\.get)\s*\(\s*['\"])([A-Z][A-Z0-9_]+)"
SECRET = "Secret-shaped value"
BOUNDARIES = (
    ("Authentication boundary", r"(?i)\b(?:auth|authorize|session|jwt|password_verify|middleware)\b"),
    ("Process execution", r"(?i)\b(?:exec|shell_exec|system|proc_open|child_process|subprocess|os\.system)\b"),
    ("Upload boundary", r"(?i)\b(?:upload|multipart|\$_FILES|move_uploaded_file)\b"),
    (SECRET, r"(?:github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
)
JSON_MANIFESTS = ("package.json", "composer.json")
JSON_GROUPS = ("dependencies", "devDependencies", "require", "require-dev")
LINE_MANIFEST = r"^(?:requirements[^/]*\.txt|go\.mod|cargo\.toml)$"
LINE_DEPENDENCY = r"^\s*([A-Za-z0-9_./-]+)\s*(?:==|=|\s+v)([^\s;]+)"
NO_AREAS = ("Documentation", "Tests")
PREVIEW, STATEMENT, AREA_PATHS = 180, 240, 12

_FACT = "array<struct<kind: string, identity: string, name: string, value: string>>"


def _lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _fact(kind: str, identity: Column, name: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), identity.alias("identity"), name.alias("name"), value.alias("value"))


def _base(path: Column) -> Column:
    return _lower(paths.base_name(path))


def line_facts(path: Column, line: Column) -> Column:
    """The facts that one line of a file states, in order, as (kind, identity, name, value)."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    squeezed = F.regexp_replace(trimmed, r"\s+", " ")

    def route(method: Column, where: Column) -> Column:
        return _fact("routes", F.concat(F.lit("route|"), method, F.lit(" "), where), method, where)

    found = [F.when(line.rlike(p), route(F.upper(F.regexp_extract(line, p, 1)), F.regexp_extract(line, p, 2))) for p in ROUTES]
    slashed = F.translate(path, "\\", "/")
    where = F.concat(F.lit("/api/"), F.regexp_replace(F.regexp_extract(slashed, FILE_ROUTE, 1), FILE_PARAMETER, r"{$1}"))
    found.append(F.when(slashed.rlike(FILE_ROUTE) & line.rlike(FILE_METHOD), route(F.regexp_extract(line, FILE_METHOD, 1), where)))
    operation, name = F.upper(F.regexp_extract(line, TABLE, 1)), F.regexp_extract(line, TABLE, 2)
    found.append(F.when(line.rlike(TABLE), _fact("schema", F.concat(F.lit("schema|"), operation, F.lit(" table "), _lower(name)), operation, name)))
    found.append(F.when(line.rlike(COLUMN), _fact("schema", F.concat(F.lit("schema|"), _lower(squeezed)), F.regexp_extract(line, COLUMN, 1), F.substring(trimmed, 1, STATEMENT))))
    for boundary, pattern in BOUNDARIES:
        shown = F.lit("<redacted>") if boundary == SECRET else F.substring(trimmed, 1, PREVIEW)
        found.append(F.when(line.rlike(pattern), _fact("security", F.concat(F.lit(f"security|{boundary}|"), squeezed), F.lit(boundary), shown)))
    name, version = F.regexp_extract(line, LINE_DEPENDENCY, 1), F.regexp_extract(line, LINE_DEPENDENCY, 2)
    listed = _base(path).rlike(LINE_MANIFEST) & line.rlike(LINE_DEPENDENCY)
    found.append(F.when(listed, _fact("dependencies", F.concat(F.lit("dependency|"), _lower(name), F.lit("@"), version), name, version)))
    names = F.regexp_extract_all(line, F.lit(ENVIRONMENT), F.lit(1))
    environment = F.transform(names, lambda n: _fact("environment", F.concat(F.lit("environment|"), n), n, F.lit("")))
    return F.concat(F.array_compact(F.array(*found)).cast(_FACT), environment.cast(_FACT))


def manifest_facts(path: Column, content: Column) -> Column:
    """The dependencies that a JSON manifest states; none of other or broken files."""
    schema = "struct<" + ", ".join(f"`{g}`: map<string, string>" for g in JSON_GROUPS) + ">"
    read = F.when(_base(path).isin(*JSON_MANIFESTS), F.from_json(content, schema))
    entries = [F.coalesce(F.map_entries(read[g]), F.array().cast("array<struct<key: string, value: string>>")) for g in JSON_GROUPS]
    version = lambda e: F.coalesce(e["value"], F.lit(""))
    return F.transform(
        F.concat(*entries), lambda e: _fact("dependencies", F.concat(F.lit("dependency|"), _lower(e["key"]), F.lit("@"), version(e)), e["key"], version(e))
    ).cast(_FACT)


def changed(versions: DataFrame, before: str, after: str) -> DataFrame:
    """The rows of both refs whose file is not the same in the two."""
    both = versions.filter(F.col("ref").isin(before, after) & F.col("content").isNotNull())
    digest = F.sha2("content", 256)
    one = both.groupBy("project", "path").agg(F.max(F.when(F.col("ref") == before, digest)).alias("b"), F.max(F.when(F.col("ref") == after, digest)).alias("a"))
    return both.join(one.filter(~F.col("b").eqNullSafe(F.col("a"))).select("project", "path"), ["project", "path"], "left_semi")


def facts(files: DataFrame) -> DataFrame:
    """(project, ref, path, line, place, kind, identity, name, value) of files; identity is a hash."""
    keys = ("project", "ref", "path")
    lines = files.select(*keys, F.posexplode(text.lines(F.col("content"))).alias("n", "text"))
    of_lines = lines.select(*keys, (F.col("n") + 1).alias("line"), F.posexplode(line_facts(F.col("path"), F.col("text"))).alias("place", "fact"))
    of_manifests = files.select(*keys, F.lit(1).alias("line"), F.posexplode(manifest_facts(F.col("path"), F.col("content"))).alias("place", "fact"))
    # an area has the first of its paths as its place and up to twelve as its value; ranks above are cut before the shuffle
    area = paths.area(F.col("path"))
    placed = files.select(*keys, area.alias("area")).filter(~F.col("area").isin(*NO_AREAS)).distinct()
    rank = F.row_number().over(Window.partitionBy("project", "ref", "area").orderBy("path"))
    kept = placed.withColumn("rank", rank).filter(F.col("rank") <= AREA_PATHS).groupBy("project", "ref", "area").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    of_areas = kept.select(
        "project", "ref", F.col("paths")[0].alias("path"), F.lit(1).alias("line"), F.lit(0).alias("place"),
        _fact("architecture", F.concat(F.lit("architecture|"), "area"), F.col("area"), F.concat_ws("\n", "paths")).alias("fact"),
    )
    rows = reduce(DataFrame.unionByName, (of_lines, of_manifests, of_areas))
    return rows.select(*keys, "line", "place", "fact.kind", F.sha2(_lower(F.col("fact.identity")), 256).alias("identity"), "fact.name", "fact.value")


def delta(versions: DataFrame, before: str, after: str, most: int | None = None) -> DataFrame:
    """(project, kind, change, identity, path, line, name, value): facts that only one of two refs states, added or removed.
    With ``most``, so many of a project, kind and change, by where they are stated first."""
    at = F.struct("path", "line", "place")
    one = facts(changed(versions, before, after)).groupBy("project", "kind", "identity").agg(
        F.bool_or(F.col("ref") == before).alias("was"), F.bool_or(F.col("ref") == after).alias("is"), F.min(at).alias("first"), F.max_by(F.struct("path", "line", "name", "value"), at).alias("last")
    )
    one = one.filter("was <> is").withColumn("change", F.when(F.col("is"), "added").otherwise("removed"))
    if most is not None:
        order = Window.partitionBy("project", "kind", "change").orderBy("first", "identity")
        one = one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return one.select("project", "kind", "change", "identity", "last.path", "last.line", "last.name", "last.value")


def changed_kinds(changes: DataFrame) -> DataFrame:
    """(project, kind, added, removed, may_break): kinds with changes; all but the architecture may break callers."""
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed")]
    return changes.groupBy("project", "kind").agg(*counts).withColumn("may_break", F.col("kind").isin("routes", "schema", "dependencies", "security"))
