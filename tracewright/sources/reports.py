"""JSON reports of analysis tools as tables of findings, packages and symbols.

Each loader takes a frame with a string column ``json`` (one report, or one line of a line-wise report, a row) and, where
several reports are told apart, a column ``report``; without one, equal texts are one report. Other columns are ignored.

Reports are read as VARIANT: null, empty and broken ones, and entries of another shape than the tool's, give no rows; fields
of another type than expected count as absent. Results carry all entries, without a cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions import labels, paths, text
from tracewright.operators.graph import kept

SEMGREP = "results array<struct<check_id:string, path:string, start:struct<line:long>, extra:struct<severity:string, message:string>>>"
GRYPE = (
    "matches array<struct<vulnerability:struct<id:string,severity:string,fix:struct<versions:array<string>,state:string>>, "
    "artifact:struct<name:string,version:string,type:string,locations:array<struct<path:string>>>, relatedVulnerabilities:array<struct<id:string>>>>"
)

def _rows(reports: DataFrame, schema: str, field: str | None):
    parsed = F.from_json("json", schema)
    return reports.select(F.explode(parsed if field is None else parsed[field]).alias("r"))


def semgrep(reports: DataFrame) -> DataFrame:
    return _rows(reports, SEMGREP, "results").select(
        F.lit("semgrep").alias("engine"), labels.vendor_severity(F.col("r.extra.severity")).alias("severity"), F.lit("static_rule").alias("type"), F.col("r.check_id").alias("rule"), F.col("r.path").alias("path"), F.col("r.start.line").alias("line"),
        text.redact(F.col("r.extra.message")).alias("title"),
    )


def _documents(reports: DataFrame) -> DataFrame:
    """(report, doc): the texts that are JSON."""
    report = F.col("report") if "report" in reports.columns else F.sha2("json", 256)
    return reports.select(report.alias("report"), F.try_parse_json("json").alias("doc")).filter("doc IS NOT NULL")


def _inside(node: Column, where: str) -> Column:
    return F.try_variant_get(node, where, "variant")


def _string(node: Column, where: str, default: str | None = None) -> Column:
    got = F.try_variant_get(node, where, "string")
    return got if default is None else F.coalesce(got, F.lit(default))


def _line(node: Column, *places: str) -> Column:
    return F.greatest(F.lit(1), F.coalesce(*(F.try_variant_get(node, p, "int") for p in places), F.lit(1)))


def _list(node: Column, where: str) -> Column:
    return F.coalesce(F.try_variant_get(node, where, "array<variant>"), F.array().cast("array<variant>"))


def _object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string, variant>").isNotNull()


def _nested(node: Column) -> Column:
    return _object(node) | F.try_variant_get(node, "$", "array<variant>").isNotNull()


def _children(frame: DataFrame, node: str) -> DataFrame:
    """The frame with (pos, key, value) of each child of a list or an object; other values have none."""
    return frame.lateralJoin(frame.sparkSession.tvf.variant_explode(F.col(node).outer()))


def _relative(path: Column, root: str) -> Column:
    """A path with plain slashes below the root, or without leading dots and slashes."""
    slashed, prefix = F.translate(path, "\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(F.lower(slashed), F.lit(prefix.lower())), F.substring(slashed, len(prefix) + 1, 1 << 30)).otherwise(F.regexp_replace(slashed, "^[./]+", ""))


def gitleaks(reports: DataFrame, root: str = "") -> DataFrame:
    """Secrets by rule and place, one row an entry; the secret itself is never read."""
    rows = _children(_documents(reports), "doc").filter(_nested(F.col("value")))
    v = F.col("value")
    path, commit = _relative(_string(v, "$.File", ""), root), _string(v, "$.Commit", "")
    fingerprint = F.sha2(F.concat_ws("|", _string(v, "$.RuleID", ""), path, _string(v, "$.StartLine", ""), commit), 256)
    return rows.select(
        F.lit("gitleaks").alias("engine"), F.lit("risk").alias("severity"), F.lit("possible_exposed_secret").alias("type"), F.substring(_string(v, "$.RuleID", "gitleaks"), 1, 120).alias("rule"),
        path.alias("path"), _line(v, "$.StartLine").alias("line"), _line(v, "$.EndLine", "$.StartLine").alias("line_end"), F.when(commit.rlike("^(?i)[a-f0-9]{7,64}$"), commit).alias("commit"),
        text.redact(F.substring(F.coalesce(_string(v, "$.Description"), _string(v, "$.RuleID"), F.lit("secret")), 1, 160)).alias("title"), fingerprint.alias("fingerprint"), "report",
    )


def _walked(reports: DataFrame) -> DataFrame:
    """(report, place, path, node) of every list and object of the reports, to any depth, but for what lies in advisories.

    The path is that of the nearest source round a node. One job a level of the deepest report; a level is written to the
    checkpoint folder, so a text is written as often as it is deep.
    """
    source = F.coalesce(_string(F.col("node"), "$.source.path"), _string(F.col("node"), "$.source.file"), F.col("path"))
    level, levels = _documents(reports).select("report", F.array().cast("array<string>").alias("place"), F.lit("").alias("path"), F.col("doc").alias("node")), []
    while True:
        level = kept(level.filter(_nested(F.col("node"))).withColumn("path", source))
        if levels and level.isEmpty():
            return reduce(DataFrame.union, levels)
        levels.append(level)
        step = F.coalesce("key", F.lpad(F.col("pos").cast("string"), 10, "0"))
        below = _children(level, "node").filter("key IS NULL OR key <> 'vulnerabilities'")
        level = below.select("report", F.array_append("place", step).alias("place"), "path", F.col("value").alias("node"))


def osv(reports: DataFrame, root: str = "") -> DataFrame:
    """Advisories of packages wherever a report nests them, one row a report, advisory, ecosystem, package and version.

    Advisories told several times (upper or lower case) keep the fields of the first place, keys of an object by name, with
    the fixed versions and aliases of all.
    """
    found = _walked(reports).select("report", "place", "path", _inside(F.col("node"), "$.package").alias("package"), _inside(F.col("node"), "$.vulnerabilities").alias("listed"))
    found = _children(found.filter(_nested(F.col("package")) & _nested(F.col("listed"))), "listed").filter(_nested(F.col("value")))
    v, p = F.col("value"), F.col("package")
    fixes = F.try_variant_get(v, "$.affected", "array<struct<ranges: array<struct<events: array<struct<fixed: string>>>>>>")
    none = F.array().cast("array<string>")
    fixes = F.flatten(F.transform(fixes, lambda a: F.coalesce(F.flatten(F.transform(a["ranges"], lambda r: F.coalesce(F.transform(r["events"], lambda e: F.substring(e["fixed"], 1, 100)), none))), none)))
    aliases = F.slice(F.transform(F.filter(_list(v, "$.aliases"), lambda a: F.schema_of_variant(a) == "STRING"), lambda a: a.cast("string")), 1, 20)
    one = found.select(
        "report", F.struct(F.array_append("place", F.coalesce("key", F.lpad(F.col("pos").cast("string"), 10, "0"))).alias("place")).alias("at"),
        F.nullif(_relative(F.col("path"), root), F.lit("")).alias("path"), F.substring(_string(v, "$.id", "OSV-UNKNOWN"), 1, 100).alias("id"),
        F.substring(_string(p, "$.name", "unknown"), 1, 255).alias("name"), F.substring(_string(p, "$.ecosystem", "unknown"), 1, 80).alias("ecosystem"), F.substring(_string(p, "$.version", "unknown"), 1, 160).alias("version"),
        F.upper(F.coalesce(_string(v, "$.database_specific.severity"), _string(v, "$.severity_text"), F.lit("UNKNOWN"))).alias("told"), F.coalesce(fixes, none).alias("fixed"), aliases.alias("aliases"),
    )
    key = [F.lower(c).alias(f"_{c}") for c in ("id", "ecosystem", "name", "version")]
    first = F.min_by(F.struct("path", "id", "name", "ecosystem", "version", "told"), "at")

    def joined(column: str) -> Column:
        told = F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column])
        return F.array_distinct(F.array_compact(F.flatten(told))).alias(column)

    merged = one.groupBy("report", *key).agg(first.alias("f"), joined("fixed"), joined("aliases"))
    # critical, high, moderate and medium only; other words are information
    severity = F.when(F.col("f.told").isin("CRITICAL", "HIGH", "MODERATE", "MEDIUM"), labels.vendor_severity(F.col("f.told"))).otherwise("info")
    return merged.select(
        F.lit("osv-scanner").alias("engine"), severity.alias("severity"), "f.path", F.concat_ws("|", paths.ecosystem(F.col("f.ecosystem")), "f.name", "f.version").alias("package"),
        F.array_distinct(F.concat(F.array("f.id"), "aliases")).alias("ids"), F.col("fixed").alias("fixed_versions"), "f.id", "f.name", "f.ecosystem", "f.version", "report",
    )


def grype(reports: DataFrame) -> DataFrame:
    r = _rows(reports, GRYPE, "matches")
    related = F.coalesce(F.transform("r.relatedVulnerabilities", lambda x: x.id), F.array().cast("array<string>"))
    return r.select(
        F.lit("grype").alias("engine"), labels.vendor_severity(F.col("r.vulnerability.severity")).alias("severity"), F.try_element_at(F.col("r.artifact.locations.path"), F.lit(1)).alias("path"),
        F.concat_ws("|", paths.ecosystem(F.col("r.artifact.type")), "r.artifact.name", "r.artifact.version").alias("package"), F.array_distinct(F.concat(F.array("r.vulnerability.id"), related)).alias("ids"),
        F.coalesce(F.col("r.vulnerability.fix.versions"), F.array().cast("array<string>")).alias("fixed_versions"),
    )


def syft(reports: DataFrame, root: str = "") -> DataFrame:
    """Packages, classified by where they were found; of those with one identity in a report the last one."""
    rows = _children(_documents(reports).withColumn("listed", _inside(F.col("doc"), "$.artifacts")), "listed").filter(_object(F.col("value")))
    v = F.col("value")
    where = F.transform(F.filter(_list(v, "$.locations"), _object), lambda x: F.coalesce(_string(x, "$.path"), _string(x, "$.realPath"), F.lit("")))
    where = F.transform(F.filter(where, lambda x: x != ""), lambda x: _relative(x, root))
    license = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).when(_object(x), F.coalesce(_string(x, "$.value"), _string(x, "$.spdxExpression")))
    licenses = F.filter(F.transform(_list(v, "$.licenses"), lambda x: F.trim(license(x))), lambda x: x.isNotNull() & (x != ""))
    one = rows.select(
        "report", "pos", F.substring(F.trim(_string(v, "$.name", "")), 1, 255).alias("name"), F.substring(F.trim(_string(v, "$.version", "")), 1, 160).alias("version"),
        F.substring(_string(v, "$.type", "unknown"), 1, 80).alias("ecosystem"), F.substring(_string(v, "$.purl", ""), 1, 700).alias("purl"), paths.package_class(where).alias("classification"),
        F.slice(F.array_distinct(licenses), 1, 20).alias("licenses"), F.slice(F.array_distinct(where), 1, 20).alias("locations"),
    ).filter("name <> ''")
    identity = F.lower(F.when(F.col("purl") != "", F.col("purl")).otherwise(F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version")))
    fields = ("name", "version", "ecosystem", "purl", "classification", "licenses", "locations")
    last = one.groupBy("report", identity.alias("identity")).agg(F.max_by(F.struct(*fields), "pos").alias("p"))
    return last.select(F.lit("syft").alias("engine"), *(f"p.{f}" for f in fields), "report")


def ripgrep(lines: DataFrame) -> DataFrame:
    """Matches of a line-wise report: path, line, text (redacted), the matched words."""
    doc = F.col("doc")
    matches = F.transform(_list(doc, "$.data.submatches"), lambda m: _string(m, "$.match.text"))
    return _documents(lines).filter(_string(doc, "$.type") == "match").select(
        F.translate(F.regexp_replace(_string(doc, "$.data.path.text", ""), r"^[./\\\\]+", ""), "\\", "/").alias("path"), _line(doc, "$.data.line_number").alias("line"),
        text.redact(text.excerpt(_string(doc, "$.data.lines.text", ""))).alias("excerpt"), matches.alias("matches"), _string(doc, "$.data.lines.text", "").rlike(RULE_LINE).alias("states_rule"), "report",
    )


# Languages, folders and words that decide which matches are findings of running code.
RUNTIME_LANGUAGES = ("PHP", "JavaScript", "TypeScript", "Python", "Ruby", "Go", "Java", "C", "C++", "C#", "Rust")
NOT_RUNTIME = r"(?i)(^|/)(?:tests?|specs?|fixtures?|rules?|workers?)(/|$)"
RULE_LINE = r"\$(?:pattern|rules?)\s*="
EXECUTION = r"eval|exec|child_process|processbuilder"


def _of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose path is one of the files (path, language, and report where the files tell it)."""
    keys = [c for c in ("report", "path") if c in files.columns]
    return rows.join(files.select(*keys, F.col("language").alias("file_language")).dropDuplicates(keys), keys)


def execution_findings(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Matches in running code: process or dynamic execution (risk), else access to the environment. Lines that state rules do not count."""
    known = files.filter(F.col("language").isin(*RUNTIME_LANGUAGES) & ~F.col("path").rlike(NOT_RUNTIME))
    rows = _of_files(ripgrep(lines).filter("NOT states_rule"), known)
    process = F.lower(F.coalesce(F.try_element_at("matches", F.lit(1)), F.lit(""))).rlike(EXECUTION)
    return rows.select(
        F.lit("ripgrep").alias("engine"), F.when(process, "risk").otherwise("info").alias("severity"), F.when(process, "process_or_dynamic_execution").otherwise("environment_access").alias("type"),
        F.when(process, "execution").otherwise("environment").alias("rule"), "path", "line", F.col("file_language").alias("language"), "report",
    )


# Kinds of tags that symbols keep, and those that count as others.
TAG_KINDS = ("class", "interface", "trait", "enum", "method", "function", "namespace", "module", "property", "constant")
TAG_ALIASES = {"member": "property", "field": "property", "variable": "variable", "local": "variable"}


def ctags(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Symbols of a line-wise report of tags; with files, those of known paths only."""
    doc = F.col("doc")
    name, scope = F.trim(_string(doc, "$.name", "")), F.trim(_string(doc, "$.scope", ""))
    kind = F.lower(_string(doc, "$.kind", "symbol"))
    symbol = paths.first_of([(k, kind == k) for k in TAG_KINDS] + [(to, kind == of) for of, to in TAG_ALIASES.items()], "symbol")
    rows = _documents(lines).filter((_string(doc, "$._type") == "tag") & (name != "")).select(
        F.lit("ctags").alias("engine"), _string(doc, "$.language").alias("language"), F.translate(_string(doc, "$.path", ""), "\\", "/").alias("path"), name.alias("name"),
        F.when(scope == "", name).otherwise(F.concat(scope, F.lit("::"), name)).alias("qualified_name"), symbol.alias("type"), kind.alias("tag_kind"), _line(doc, "$.line").alias("start_line"), "report",
    )
    if files is None:
        return rows.withColumn("language", F.coalesce("language", F.lit("Unknown")))
    columns = rows.columns
    return _of_files(rows, files).withColumn("language", F.coalesce("language", "file_language", F.lit("Unknown"))).select(*columns)
