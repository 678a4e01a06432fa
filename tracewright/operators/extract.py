"""Symbols and relationships from source text, by rules on lines and sweeps over each file.

JavaScript and TypeScript lines belong to the last declaration before them, SQL lines to the table being created. PHP has
a stack of classes and one of functions, by depth of braces; Python one of both, by indents. A relationship found on a line
starts at the symbol that the line declares, else at the one that it belongs to, else at its file's module.

Swept lines are checkpointed, so that symbols and relationships read them instead of sweeping again.

With ``own``, lines that declare nothing are left out once scopes are known; the relationships then lack theirs.

Null contents count as empty, files of other languages have their module only. Facts of one identity count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions import paths, text
from tracewright.operators.graph import kept
from tracewright.operators.sweep import FILE, braced, ends, filled, indented, numbered, owners

SCRIPTS = ("JavaScript", "TypeScript", "Vue", "Svelte")

# How languages declare and use things, and words that are no calls.
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
JS_CLASS = rf"^(?:export\s+)?(?:default\s+)?class\s+({NAME})"
JS_FUNCTION = rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({NAME})\s*\(([^)]*)\)"
JS_ARROW = rf"^(?:export\s+)?(?:const|let|var)\s+({NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{NAME})\s*=>"
JS_TYPE = rf"^(?:export\s+)?(?:interface|type|enum)\s+({NAME})"
JS_EXTENDS = r"\bextends\s+([A-Za-z_$][A-Za-z0-9_$.]*)"
JS_IMPORT = r"^import\s+.+?\s+from\s+['\"]([^'\"]+)['\"]|^import\s+['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\)"
JS_CALL = rf"\b({NAME})\s*\("
JS_NOT_CALLS = ("if", "for", "while", "switch", "catch", "function")
JS_RENDER = r"<([A-Z][A-Za-z0-9_$.]*)\b"
JS_ENV = r"(?:process\.env\.|import\.meta\.env\.)([A-Z][A-Z0-9_]+)"
URL = r"(?i)https?://[^\s'\"`<>]+"
SQL_TABLE = r"(?i)^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?([A-Za-z_][A-Za-z0-9_.]*)"
SQL_OTHER = r"(?i)^CREATE\s+(?:OR\s+REPLACE\s+)?(VIEW|FUNCTION|PROCEDURE|TRIGGER)\s+[`\"]?([A-Za-z_][A-Za-z0-9_.]*)"
SQL_COLUMN = r"^[`\"]?([A-Za-z_][A-Za-z0-9_]*)[`\"]?\s+([A-Za-z]+(?:\s*\([^)]*\))?)"
SQL_NOT_COLUMNS = ("PRIMARY", "UNIQUE", "KEY", "CONSTRAINT", "FOREIGN", "CHECK")
SQL_FOREIGN = r"(?i)FOREIGN\s+KEY\s*\([^)]*\)\s*REFERENCES\s+[`\"]?([A-Za-z_][A-Za-z0-9_.]*)"
SQL_END = r"(?i)^\)\s*(?:ENGINE|;|$)"
PY_CLASS = r"^class\s+([A-Za-z_][A-Za-z0-9_]*)(?:\(([^)]*)\))?\s*:"
PY_DEF = r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
PY_IMPORT = r"^(?:from\s+([A-Za-z0-9_.]+)\s+import|import\s+([A-Za-z0-9_.]+))"
PY_CALL = r"\b([A-Za-z_][A-Za-z0-9_.]*)\s*\("
PY_NOT_CALLS = ("if", "for", "while", "def", "class")
PY_ENV = r"(?:os\.getenv|environ\.get)\(\s*['\"]([A-Z][A-Z0-9_]+)['\"]|os\.environ\s*\[\s*['\"]([A-Z][A-Z0-9_]+)['\"]\s*\]"
PHP_NAMESPACE = r"(?i)^namespace\s+([^;{]+)"
PHP_CLASS = r"(?i)^(?:(?:final|abstract|readonly)\s+)*(class|interface|trait|enum)\s+([A-Za-z_][A-Za-z0-9_]*)(.*)$"
PHP_FUNCTION = r"(?i)^(?:(public|protected|private)\s+)?(?:(?:static|final|abstract)\s+)*function\s+&?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
PHP_PROPERTY = r"(?i)^(public|protected|private)\s+(?:static\s+)?(?:readonly\s+)?(?:(?:[?A-Za-z_][A-Za-z0-9_?|&]*(?:\\[A-Za-z_][A-Za-z0-9_?|&]*)*)\s+)?\$([A-Za-z_][A-Za-z0-9_]*)"
PHP_CONSTANT = r"(?i)^(?:(public|protected|private)\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)"
PHP_EXTENDS = r"(?i)\bextends\s+([A-Za-z_][A-Za-z0-9_]*(?:\\[A-Za-z_][A-Za-z0-9_]*)*)"
PHP_IMPLEMENTS = r"(?i)\bimplements\s+([^\{]+)"
PHP_USE = r"(?i)^use\s+([^;{]+);"
PHP_NEW = r"\bnew\s+([A-Za-z_][A-Za-z0-9_]*(?:\\[A-Za-z_][A-Za-z0-9_]*)*)"
PHP_MEMBER_CALL = r"(?:->|::)([A-Za-z_][A-Za-z0-9_]*)\s*\("
PHP_CALL = r"(?<![>:\w])([A-Za-z_][A-Za-z0-9_]*)\s*\("
PHP_NOT_CALLS = ("if", "elseif", "while", "for", "foreach", "switch", "catch", "isset", "empty", "array", "echo", "print", "include", "include_once", "require", "require_once", "unset", "match", "return", "function")
PHP_ENV = r"(?:getenv|env)\(\s*['\"]([A-Z][A-Z0-9_]+)['\"]|\$_ENV\s*\[\s*['\"]([A-Z][A-Z0-9_]+)['\"]\s*\]"
PHP_TABLES = (
    r"(?i)\b(?:SELECT|DELETE)\b.{0,350}?\b(?:FROM|JOIN)\s+[`\"]?([A-Za-z_][A-Za-z0-9_.]*)",
    r"(?i)\bINSERT\s+(?:IGNORE\s+)?INTO\s+[`\"]?([A-Za-z_][A-Za-z0-9_.]*)",
    r"(?i)\bUPDATE\s+[`\"]?([A-Za-z_][A-Za-z0-9_.]*)\s+(?:SET|AS)\b",
    r"(?i)\b(?:CREATE|ALTER|DROP|TRUNCATE)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?[`\"]?([A-Za-z_][A-Za-z0-9_.]*)",
)
PHP_BUILDER = r"(?i)(?:->|::)table\(\s*['\"]([A-Za-z_][A-Za-z0-9_.]*)['\"]"
PHP_SENDS = r"(?i)(?:\$[A-Za-z_][A-Za-z0-9_]*\s*=|(?:->|::)(?:get|post|put|patch|delete|request|send)\s*\()"

EDGE = "array<struct<type: string, target: string, confidence: string, source: struct<qualified_name: string, key: string>>>"
OWNER = "struct<qualified_name: string, key: string>"
SYMBOL_COLUMNS = (*FILE, "language", "type", "name", "qualified_name", "parent", "visibility", "exported", "signature", "start_line", "end_line", "confidence", "key")


def identity(kind: Column, qualified: Column) -> Column:
    return F.sha2(F.concat_ws("|", "path", kind, qualified, "line_no"), 256)


def _one(pattern: str, group: int = 1, of: str = "trimmed") -> Column:
    """What a group matched, null where it matched nothing."""
    found = F.regexp_extract(of, pattern, group)
    return F.when(found != "", found)


def _every(pattern: str, group: int = 1, of: str = "line") -> Column:
    return F.regexp_extract_all(of, F.lit(pattern), F.lit(group))


def _module() -> Column:
    """The file's own symbol, which starts at line 1 whatever the line in hand."""
    return F.struct(F.col("path").alias("qualified_name"), F.sha2(F.concat_ws("|", "path", F.lit("module"), "path", F.lit("1")), 256).alias("key"))


def _edges(kind: str, targets: Column, confidence: str, source: Column) -> Column:
    """Relationships of one kind to every target that is not null or empty."""
    named = F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.transform(named, lambda t: F.struct(F.lit(kind).alias("type"), t.alias("target"), F.lit(confidence).alias("confidence"), source.alias("source"))).cast(EDGE)


def _hosts(of: Column) -> Column:
    """Hosts of the addresses on a line."""
    urls = F.transform(F.regexp_extract_all(of, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))
    return F.transform(urls, lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


def _own(kind: Column, name: Column, qualified: Column) -> Column:
    """What a line declares: a struct with its key, null where the name is."""
    return F.when(name.isNotNull(), F.struct(kind.alias("type"), name.alias("name"), qualified.alias("qualified_name"), identity(kind, qualified).alias("key")))


def _owner(declared: str) -> Column:
    return F.when(F.col(declared).isNotNull(), F.struct(F.col(f"{declared}.qualified_name"), F.col(f"{declared}.key")))


def _symbols(lines: DataFrame, declared: str, parent: Column, visibility: Column, exported: Column, end: Column, signed: bool = True) -> DataFrame:
    """Symbol rows of the lines that declare something."""
    d = F.col(declared)
    return lines.filter(d.isNotNull()).select(
        *FILE, "language", d.type.alias("type"), d["name"].alias("name"), d.qualified_name.alias("qualified_name"), parent.alias("parent"), visibility.alias("visibility"), exported.alias("exported"),
        (text.excerpt(F.col("trimmed")) if signed else F.lit(None).cast("string")).alias("signature"), F.col("line_no").alias("start_line"), F.greatest(F.col("line_no"), end).cast("int").alias("end_line"), F.lit("high").alias("confidence"), d.key.alias("key"),
    )


def _relationships(lines: DataFrame, *edges: Column) -> DataFrame:
    rows = lines.select(*FILE, "line_no", F.explode(F.concat(*edges)).alias("e"))
    return rows.select(*FILE, "line_no", F.col("e.source.qualified_name").alias("source"), F.col("e.source.key").alias("source_key"), F.col("e.type").alias("type"), F.col("e.target").alias("target"), F.col("e.confidence").alias("confidence")).distinct()


def _mentioned(relationships: DataFrame, language: Column) -> DataFrame:
    """Environment variables, services and tables that relationships name are symbols on their line."""
    kind = F.create_map(*[F.lit(x) for x in ("reads_env", "environment_variable", "calls_service", "external_service", "uses_table", "table")])[F.col("type")]
    prefix = F.create_map(*[F.lit(x) for x in ("reads_env", "env:", "calls_service", "service:", "uses_table", "table:")])[F.col("type")]
    rows = relationships.filter(kind.isNotNull()).groupBy(*FILE, "line_no", kind.alias("kind"), F.when(F.col("type") == "uses_table", F.lower("target")).otherwise(F.col("target")).alias("low"), prefix.alias("prefix")).agg(F.min("target").alias("name"), F.min("confidence").alias("confidence"))
    return rows.select(*FILE, language.alias("language"), F.col("kind").alias("type"), "name", F.concat("prefix", "low").alias("qualified_name"), F.lit(None).cast("string").alias("parent"), F.lit("unknown").alias("visibility"), F.lit(False).alias("exported"), F.lit(None).cast("string").alias("signature"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), "confidence", identity(F.col("kind"), F.concat("prefix", "low")).alias("key"))


def modules(lines: DataFrame) -> DataFrame:
    """A module symbol for every file."""
    files = lines.groupBy(*FILE, "language").agg(F.max("line_no").alias("last"))
    module = _module()
    return files.select(*FILE, "language", F.lit("module").alias("type"), paths.base_name(F.col("path")).alias("name"), F.col("path").alias("qualified_name"), F.lit(None).cast("string").alias("parent"), F.lit("unknown").alias("visibility"), F.lit(False).alias("exported"), F.lit(None).cast("string").alias("signature"), F.lit(1).alias("start_line"), F.col("last").alias("end_line"), F.lit("high").alias("confidence"), module.key.alias("key"))


def script_facts(lines: DataFrame, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, relationships) of JavaScript and TypeScript lines."""
    lines = lines.filter(F.col("language").isin(*SCRIPTS))
    made = F.coalesce(_one(JS_FUNCTION), F.when(F.regexp_extract("trimmed", JS_FUNCTION, 1) == "", _one(JS_ARROW)))
    shape = F.when(made.startswith("use"), "hook").when(F.substring(made, 1, 1).rlike("^[A-Z]"), "component").otherwise("function")
    kinds = F.when(F.col("trimmed").contains("interface "), "interface").when(F.col("trimmed").contains("enum "), "enum").otherwise("type")
    name = F.coalesce(_one(JS_CLASS), made, _one(JS_TYPE))
    kind = F.when(_one(JS_CLASS).isNotNull(), "class").when(made.isNotNull(), shape).otherwise(kinds)
    exported = F.col("trimmed").rlike(r"^export\s+")
    rows = lines.withColumn("declared", _own(kind, name, F.concat("path", F.lit("#"), name)))
    rows = rows.withColumn("active", F.coalesce(filled(_owner("declared")), _module()))
    visibility = F.when(F.col("declared.type").isin("interface", "enum", "type"), "unknown").when(_one(JS_CLASS).isNull() & _one(JS_FUNCTION).isNull(), "package").otherwise("public")
    rows = rows.filter("declared is not null") if own else kept(rows)
    symbols = _symbols(rows, "declared", F.lit(None).cast("string"), visibility, exported, F.col("line_no"))
    active = F.col("active")
    calls = F.filter(F.array_distinct(_every(JS_CALL)), lambda c: ~c.isin(*JS_NOT_CALLS) & ~F.col("trimmed").contains(F.concat(F.lit("function "), c)))
    imported = F.array(F.coalesce(_one(JS_IMPORT, 1), _one(JS_IMPORT, 2), _one(JS_IMPORT, 3)))
    edges = _relationships(
        rows, _edges("extends", F.array(F.when(_one(JS_CLASS).isNotNull(), _one(JS_EXTENDS))), "high", active), _edges("imports", imported, "high", _module()), _edges("calls", calls, "low", active),
        _edges("renders", _every(JS_RENDER), "high", active), _edges("reads_env", _every(JS_ENV), "high", active), _edges("calls_service", _hosts(F.col("line")), "medium", active),
    )
    return symbols, edges


def sql_facts(lines: DataFrame, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, relationships) of SQL lines: tables with their columns until a closing bracket, views and routines."""
    lines = lines.filter(F.col("language") == "SQL")
    table, other = _one(SQL_TABLE), _one(SQL_OTHER, 2)
    name, kind = F.coalesce(table, other), F.when(table.isNotNull(), "table").otherwise(F.lower(F.regexp_extract("trimmed", SQL_OTHER, 1)))
    rows = lines.withColumn("declared", _own(kind, name, F.concat(kind, F.lit(":"), F.lower(name)))).withColumn("made", table)
    # the last event before a line: a table begun, or one ended
    event = F.when(F.col("made").isNotNull(), F.struct(F.col("made").alias("name"), F.col("declared.qualified_name"), F.col("declared.key"))).when(F.col("trimmed").rlike(SQL_END), F.struct(F.lit("").alias("name"), F.lit("").alias("qualified_name"), F.lit("").alias("key")))
    rows = rows.withColumn("event", event).withColumn("open", filled(F.col("event"), -1)).withColumn("open", F.when((F.col("open.name") != "") & F.col("made").isNull(), F.col("open")))
    column = F.when(F.col("open").isNotNull() & ~F.upper(F.regexp_extract("trimmed", SQL_COLUMN, 1)).isin(*SQL_NOT_COLUMNS), _one(SQL_COLUMN))
    rows = rows.withColumn("column", _own(F.lit("column"), column, F.concat("open.name", F.lit("."), column)))
    rows, none = kept(rows.filter("declared is not null or column is not null") if own else rows), F.lit(None).cast("string")
    symbols = _symbols(rows, "declared", none, F.lit("unknown"), F.lit(True), F.col("line_no")).unionByName(_symbols(rows, "column", F.col("open.key"), F.lit("unknown"), F.lit(False), F.col("line_no")))
    foreign = F.array(F.when(F.col("open").isNotNull(), F.concat(F.lit("table:"), F.lower(_one(SQL_FOREIGN)))))
    source = F.struct(F.col("open.qualified_name"), F.col("open.key"))
    return symbols, _relationships(rows, _edges("defines", F.array(F.col("declared.qualified_name")), "high", _module()), _edges("foreign_key_to", foreign, "high", source))


def python_facts(lines: DataFrame, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, relationships) of Python lines; scopes end before the next line that is indented no deeper."""
    rows = indented(lines.filter(F.col("language") == "Python"))
    decorator = F.col("trimmed").startswith("@")
    name, kind = F.coalesce(_one(PY_CLASS), _one(PY_DEF)), F.when(_one(PY_CLASS).isNotNull(), "class").otherwise("function")
    rows = rows.withColumn("word", F.when(~decorator, name)).withColumn("kind", kind)
    declaring = rows.filter("word is not null")
    found = kept(ends(declaring.select(*FILE, "line_no", F.col("indent").alias("level"), F.struct("word", "kind").alias("scope"), F.lit(False).alias("shut")), rows, "indent", "above", 1))
    rows = kept(owners(rows, found, "around"))
    method = (F.col("kind") == "function") & (F.col("around.kind") == "class")
    method = F.coalesce(method, F.lit(False))
    qualified = F.when(method, F.concat("around.word", F.lit("."), "word")).otherwise(F.concat("path", F.lit("#"), "word"))
    rows = rows.withColumn("declared", _own(F.when(method, "method").otherwise(F.col("kind")), F.col("word"), qualified))
    # once more, now that each scope has its key
    keyed = rows.filter("declared is not null").select(*FILE, "line_no", F.struct("declared.qualified_name", "declared.key").alias("scope")).join(found.select(*FILE, "line_no", "end"), [*FILE, "line_no"])
    rows = owners(rows.withColumn("last", F.max("line_no").over(W.partitionBy(*FILE))), keyed, "holder")
    rows = (rows.filter("declared is not null") if own else rows).join(found.select(*FILE, "line_no", "end"), [*FILE, "line_no"], "left")
    rows = rows if own else kept(rows)
    private = F.col("word").startswith("_")
    parent = F.when(F.col("declared.type") == "method", F.col("holder.key"))
    symbols = _symbols(rows, "declared", parent, F.when(private, "private").otherwise("public"), ~private & (F.col("declared.type") != "method"), F.coalesce("end", "last"))
    plain = rows.filter(~decorator & F.col("declared").isNull())
    source = F.coalesce("holder", _module())
    calls = F.filter(F.array_distinct(_every(PY_CALL)), lambda c: ~c.isin(*PY_NOT_CALLS))
    env = F.concat(_every(PY_ENV, 1), _every(PY_ENV, 2))
    edges = _relationships(
        plain, _edges("imports", F.array(F.coalesce(_one(PY_IMPORT, 1), _one(PY_IMPORT, 2))), "high", _module()), _edges("calls", calls, "low", source),
        _edges("reads_env", env, "high", source), _edges("calls_service", _hosts(F.col("line")), "medium", source),
    )
    bases = F.split(F.regexp_extract("trimmed", PY_CLASS, 2), r"\s*,\s*")
    named = F.struct("declared.qualified_name", "declared.key")
    return symbols, edges.unionByName(_relationships(rows.filter("declared.type = 'class'"), _edges("extends", bases, "high", named)))


def php_facts(lines: DataFrame, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbols, relationships) of PHP lines; a class or function ends where the depth of braces falls back to its own."""
    bare = F.regexp_replace(F.regexp_replace("line", r"//.*$", ""), r"(['\"]).*?(?<!\\)\1", "")
    rows = braced(lines.filter(F.col("language") == "PHP"), bare)
    space = F.trim(filled(_one(PHP_NAMESPACE)))
    rows = rows.withColumn("space", F.when(F.coalesce(space, F.lit("")) != "", F.concat(space, F.lit("\\"))).otherwise("")).withColumn("closes_to", F.col("before") - 1)
    shut = F.col("trimmed").contains("{") & (F.col("after") <= F.col("before"))
    word = _one(PHP_CLASS, 2)
    rows = rows.withColumn("class", _own(F.lower(_one(PHP_CLASS, 1)), word, F.concat("space", word)))
    scope = F.struct("class.name", "class.qualified_name", "class.key").alias("scope")
    rows = kept(rows)
    classes = kept(ends(rows.filter("class is not null").select(*FILE, "line_no", F.col("before").alias("level"), scope, shut.alias("shut")), rows, "after", "closes_to"))
    rows = owners(rows, classes, "outer").withColumn("holder", F.coalesce(F.when(F.col("class").isNotNull(), F.struct("class.name", "class.qualified_name", "class.key")), "outer"))
    word = _one(PHP_FUNCTION, 2)
    inside = F.col("holder").isNotNull()
    qualified = F.concat("space", F.coalesce(F.concat("holder.name", F.lit("::")), F.lit("")), word)
    rows = kept(rows.withColumn("function", _own(F.when(inside, "method").otherwise("function"), word, qualified)))
    scope = F.struct("function.qualified_name", "function.key").alias("scope")
    bodies = rows.filter(F.col("function").isNotNull() & ~F.col("trimmed").endswith(";"))
    functions = kept(ends(bodies.select(*FILE, "line_no", F.col("before").alias("level"), scope, shut.alias("shut")), rows, "after", "closes_to"))
    # only relationships ask for the function that a line is in
    rows = rows.withColumn("running", F.lit(None).cast(OWNER)) if own else owners(rows, functions, "running")
    of_class = F.when(inside, F.struct("holder.qualified_name", "holder.key"))
    rows = rows.withColumn("source", F.coalesce(_owner("function"), _owner("class"), F.col("running"), of_class, _module()))
    word = F.concat(F.lit("$"), F.when(inside, _one(PHP_PROPERTY, 2)))
    rows = rows.withColumn("property", _own(F.lit("property"), word, F.concat("holder.name", F.lit("::"), word)))
    word = F.when(inside, _one(PHP_CONSTANT, 2))
    rows = rows.withColumn("constant", _own(F.lit("constant"), word, F.concat("holder.name", F.lit("::"), word)))
    rows = rows.withColumn("last", F.max("line_no").over(W.partitionBy(*FILE)))
    closed = classes.select(*FILE, "line_no", "end").withColumn("what", F.lit("class")).unionByName(functions.select(*FILE, "line_no", "end").withColumn("what", F.lit("function")))
    closed = closed.groupBy(*FILE, "line_no").agg(F.max(F.when(F.col("what") == "class", F.col("end"))).alias("class_end"), F.max(F.when(F.col("what") == "function", F.col("end"))).alias("function_end"))
    rows = kept(rows.filter("coalesce(class.key, function.key, property.key, constant.key) is not null") if own else rows)
    wide = rows.join(closed, [*FILE, "line_no"], "left")
    none, here = F.lit(None).cast("string"), F.col("line_no")
    seen = lambda pattern: F.coalesce(F.lower(_one(pattern, 1)), F.lit("public"))
    symbols = reduce(DataFrame.unionByName, (
        _symbols(wide, "class", none, F.lit("public"), F.lit(True), F.coalesce("class_end", "last")),
        _symbols(wide, "function", F.col("holder.key"), seen(PHP_FUNCTION), ~inside, F.when(F.col("trimmed").endswith(";"), here).otherwise(F.coalesce("function_end", "last"))),
        _symbols(rows, "property", F.col("holder.key"), seen(PHP_PROPERTY), F.lit(False), here), _symbols(rows, "constant", F.col("holder.key"), seen(PHP_CONSTANT), F.lit(False), here, signed=False),
    ))
    tail, in_class = F.regexp_extract("trimmed", PHP_CLASS, 3), _owner("class")
    bare_names = lambda names: F.transform(names, lambda n: F.regexp_replace(n, r"^[\\ ]+|[\\ ]+$", ""))
    interfaces = F.split(F.trim(F.regexp_extract(tail, PHP_IMPLEMENTS, 1)), r"\s*,\s*")
    used = F.transform(F.split(F.regexp_extract("trimmed", PHP_USE, 1), r"\s*,\s*"), lambda u: F.regexp_replace(F.trim(u), r"(?i)\s+as\s+.+$", ""))
    plain = ~F.lower("line").contains("function ")
    source = F.col("source")
    calls = F.filter(_every(PHP_CALL), lambda c: ~F.lower(c).isin(*PHP_NOT_CALLS))
    tables = F.concat(*(_every(p) for p in PHP_TABLES))
    sends = ~F.lower("path").endswith(".blade.php") & (F.col("line").contains("=>") | F.col("line").rlike(PHP_SENDS))
    edges = _relationships(
        rows, _edges("extends", F.array(F.when(F.col("class").isNotNull(), F.regexp_extract(tail, PHP_EXTENDS, 1))), "high", in_class), _edges("implements", F.when(F.col("class").isNotNull(), bare_names(interfaces)), "high", in_class),
        _edges("imports", F.when(~inside, bare_names(used)), "high", _module()), _edges("uses_trait", F.when(inside, bare_names(used)), "high", of_class), _edges("instantiates", _every(PHP_NEW), "high", source),
        _edges("calls", F.when(plain, _every(PHP_MEMBER_CALL)), "medium", source), _edges("calls", F.when(plain, calls), "low", source), _edges("reads_env", F.concat(_every(PHP_ENV, 1), _every(PHP_ENV, 2)), "high", source),
        _edges("uses_table", tables, "medium", source), _edges("uses_table", _every(PHP_BUILDER), "high", source), _edges("calls_service", F.when(sends, _hosts(F.col("line"))), "medium", source),
    )
    return symbols, edges


def facts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, relationships) of all languages, module symbols and mentioned ones included."""
    parts = [rule(lines) for rule in (php_facts, script_facts, python_facts, sql_facts)]
    edges = kept(reduce(DataFrame.unionByName, (e for _, e in parts)))
    language = lines.groupBy(*FILE).agg(F.first("language").alias("language"))
    mentioned = _mentioned(edges, F.lit("")).drop("language").join(language, [*FILE]).select(*SYMBOL_COLUMNS)
    symbols = reduce(DataFrame.unionByName, (s.select(*SYMBOL_COLUMNS) for s in (modules(lines), *(s for s, _ in parts), mentioned)))
    return symbols.dropDuplicates(["project", "key"]), edges


def declared(lines: DataFrame) -> DataFrame:
    """Module symbols and what files declare, without what they mention: relationships are not looked for."""
    parts = [rule(lines, own=True)[0].select(*SYMBOL_COLUMNS) for rule in (php_facts, script_facts, python_facts, sql_facts)]
    return reduce(DataFrame.unionByName, (modules(lines).select(*SYMBOL_COLUMNS), *parts)).dropDuplicates(["project", "key"])


def symbols(lines: DataFrame) -> DataFrame:
    return facts(lines)[0]


def relationships(lines: DataFrame) -> DataFrame:
    return facts(lines)[1]
