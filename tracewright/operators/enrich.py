"""Services that source files use, told by the lines that mention them, and facts of lines under a budget.

``analysis`` are patterns of code that analyses code, whose texts tell nothing: see ``text.is_analysis_code``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions import paths, text
from tracewright.operators import product, relational

# How a line tells that it runs against a service.
COMMENT = r"^\s*(?://|/\*|\*|#|<!--)"
AHEAD = r"(?:import|require|from|use|new|client|sdk|endpoint|base[_-]?url|dsn|connect|request|fetch|axios|curl|->(?:get|post|put|patch|delete))"
AFTER = r"(?:client|sdk|endpoint|connect|request|fetch|axios|curl)"
CALL = r"(?i)\b(?:fetch|axios(?:\.[a-z]+)?|requests?\.[a-z]+|httpx\.[a-z]+|aiohttp|curl_[a-z]+|new\s+URL|openConnection|Http::(?:get|post|put|patch|delete)|->(?:get|post|put|patch|delete|request|send))\b"
HOST = r"(?i)\b[A-Za-z_][A-Za-z0-9_]*(?:api|endpoint|base[_-]?(?:url|uri)|webhook|dsn|origin|service[_-]?url|host)[A-Za-z0-9_]*\b[^\r\n]{0,80}(?:=>|:=|=|:)\s*['\"]https?://"
SCHEMES = ("pgsql:", "mysql:", "rediss:", "s3:")
LOCKED = r"(?i)(?:^|[-.])lock(?:\.|$)"
NO_CONTEXT = "apiVersion:"
NEEDLES = tuple((service, n, needle) for service, words in product.SERVICES.items() for n, needle in enumerate(words))


def is_endpoint(needle: str) -> bool:
    """Whether a needle is an address: a scheme, or a name that ends in a domain."""
    tail = needle.split("/")[0].rpartition(".")
    return "://" in needle or needle.lower() in SCHEMES or (bool(tail[1]) and len(tail[2]) >= 2 and tail[2].isalpha())


def _deployed(base: Column, needle: str) -> Column:
    if needle == "vercel.json":
        return base == "vercel.json"
    if needle == "dockerfile":
        return (base == "dockerfile") | base.startswith("docker-compose")
    return F.lit(False)


def service_uses(files: DataFrame, analysis: tuple[str, ...] = ()) -> DataFrame:
    """(id, path, service, line, needles): services that a runtime file uses, with the first line that holds the first of
    the needles that told so. files: id, path, content.

    A line outside comments and detector tables tells if code stands round the needle, or if it calls or names an address
    and is not within an open comment or docstring; a deployment file tells by its name. Only lines of files that hold a
    needle are looked at, each once for all needles.
    """
    any_needle = "(?i)" + "|".join(rf"\Q{n}\E" for *_, n in NEEDLES)
    base = F.lower(paths.base_name(F.col("path")))
    kept = files.filter(paths.is_runtime(F.col("path")) & ~base.rlike(LOCKED) & F.col("content").rlike(any_needle)).filter(~text.is_analysis_code(F.col("content"), analysis))
    rows = kept.select("id", "path", F.posexplode(text.lines(F.col("content"))).alias("at", "line"))
    before = W.partitionBy("id", "path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda *marks: F.coalesce(F.sum(sum((F.regexp_count("line", F.lit(rf"\Q{m}\E")) for m in marks), F.lit(0))).over(before), F.lit(0))
    opened = F.when(F.col("path").rlike(r"(?i)\.py$"), upto('"""', "'''") % 2 == 1).otherwise(upto("/*") > upto("*/"))
    line, behaves = F.col("line"), paths.is_runtime_behavior(F.col("path"))
    rows = rows.withColumn("open_", opened).filter(line.rlike(any_needle))
    speaks = line.rlike(r"\S") & ~line.rlike(COMMENT) & ~text.is_detector(line)
    calls = behaves & ~F.col("open_") & (line.rlike(CALL) | line.rlike(HOST))
    marks = []
    for service, n, needle in NEEDLES:
        quoted = rf"\Q{needle}\E"
        told = behaves & line.rlike(rf"(?i){AHEAD}[^\r\n]{{0,140}}{quoted}|{quoted}[^\r\n]{{0,140}}{AFTER}") if needle != NO_CONTEXT else F.lit(False)
        told = told | calls if is_endpoint(needle) else told
        hit = speaks & text.contains_term(line, needle) & told | _deployed(F.lower(paths.base_name(F.col("path"))), needle)
        marks.append(F.when(F.lower(line).contains(needle.lower()), F.struct(F.lit(service).alias("service"), F.lit(n).alias("n"), F.lit(needle).alias("needle"), hit.alias("hit"))))
    met = rows.select("id", "path", (F.col("at") + 1).alias("at"), F.explode(F.array_compact(F.array(*marks))).alias("m")).select("id", "path", "at", "m.*")
    firsts = met.groupBy("id", "path", "service", "n", "needle").agg(F.min("at").alias("line"), F.bool_or("hit").alias("hit")).filter("hit")
    # a service has three needles at most
    found = firsts.groupBy("id", "path", "service").agg(F.min_by("line", "n").alias("line"), F.array_sort(F.collect_list(F.struct("n", "needle"))).alias("w"))
    return found.select("id", "path", "service", "line", F.transform("w", lambda x: x.needle).alias("needles"))


def without_idle_services(symbols: DataFrame, edges: DataFrame, files: DataFrame, analysis: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without the services that no running code refers to. symbols: id, path, type, name, start_line;
    edges: source, target; files: path, content (a path once). A service stays if the line it starts on is runtime code,
    outside comments, and calls or names an address; all edges from or to the others go with them."""
    rows = symbols.filter("type = 'external_service'").select("id", "path", "name", "start_line").join(files.select("path", "content"), "path", "left")
    all_lines = text.lines(F.coalesce("content", F.lit("")))
    line = F.coalesce(F.get(all_lines, F.greatest(F.col("start_line") - 1, F.lit(0)).cast("int")), F.lit(""))
    ahead = F.array_join(F.slice(all_lines, F.lit(1), F.greatest(F.col("start_line") - 1, F.lit(0)).cast("int")), "\n")
    times = lambda mark: F.regexp_count(ahead, F.lit(rf"\Q{mark}\E"))
    opened = F.when(F.col("path").rlike(r"(?i)\.py$"), (times('"""') + times("'''")) % 2 == 1).otherwise(times("/*") > times("*/"))
    name = F.lower(F.trim("name"))
    named = (name != "") & ~name.rlike(r"[{}$\u201c\u201d]") & ~name.isin("example.com", "example.org", "example.net", "test", "https://")
    runs = paths.is_runtime_behavior(F.col("path")) & ~text.is_analysis_code(F.coalesce("content", F.lit("")), analysis) & named & line.rlike(r"\S") & ~line.rlike(COMMENT) & ~text.is_detector(line) & ~opened & (line.rlike(CALL) | line.rlike(HOST))
    idle = rows.filter(~F.coalesce(runs, F.lit(False))).select("id").distinct()
    of = lambda end: idle.select(F.col("id").alias(end))
    return symbols.join(idle, "id", "left_anti"), edges.join(of("source"), "source", "left_anti").join(of("target"), "target", "left_anti")


def line_facts(files: DataFrame, analysis: tuple[str, ...] = ()) -> DataFrame:
    """(project, id, path, line, kind, relationship, target): operations on tables, control flow, events and requests of the
    lines of runtime code; of SQL files only the operations. files: project, id, path, content."""
    behaves = paths.is_runtime_behavior(F.col("path"))
    kept = files.filter(paths.is_runtime(F.col("path")) & (behaves | F.col("path").rlike(r"(?i)\.sql$"))).filter(~text.is_analysis_code(F.col("content"), analysis))
    rows = kept.select("project", "id", "path", behaves.alias("behaves"), F.posexplode(text.lines(F.col("content"))).alias("at", "text_"))
    line, none = F.col("text_"), F.array().cast(text.FACT)
    facts = F.concat(text.table_facts(line), F.when(F.col("behaves"), F.concat(text.control_facts(line), text.ui_facts(line))).otherwise(none))
    return rows.select("project", "id", "path", (F.col("at") + 1).alias("line"), F.explode(facts).alias("f")).select("project", "id", "path", "line", "f.*")


# Derived edges by the edges that a project has, derived symbols by its symbols.
EDGE_BUDGETS = ((12_000, 400), (8_000, 800), (-1, 2_500))
SYMBOL_BUDGETS = ((7_000, 100), (-1, 600))


def budget(count: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    """The budget of the first step whose bound the count exceeds."""
    out = F.when(count > steps[0][0], steps[0][1])
    for bound, most in steps[1:]:
        out = out.when(count > bound, most)
    return out


def derived(facts: DataFrame, sizes: DataFrame, known: DataFrame, edge_budgets=EDGE_BUDGETS, symbol_budgets=SYMBOL_BUDGETS) -> DataFrame:
    """Facts that become edges of their project under its budgets, with place_, in the order of path, line, kind,
    relationship and target.

    facts: as from ``line_facts``, repeated ones once; sizes: project, edges, symbols, the counts before; known: project,
    name, the tables that are symbols already. Facts on tables (their relationship ends in table) need a symbol: tables
    that are not known become one, the first ones of each project as its budget allows, and the facts of others go.
    """
    order = ("path", "line", "kind", "relationship", "target")
    limits = sizes.select("project", budget(F.col("edges"), edge_budgets).alias("most_edges"), budget(F.col("symbols"), symbol_budgets).alias("most_symbols"))
    rows = facts.distinct().withColumn("name", F.when(F.col("relationship").endswith("table"), F.lower("target")))
    held = known.select("project", F.lower("name").alias("name"), F.lit(True).alias("held_")).distinct()
    rows = rows.join(held, ["project", "name"], "left")
    fresh = rows.filter("name is not null and held_ is null").groupBy("project", "name").agg(F.min(F.struct(*order)).alias("first_"))
    fresh = relational.first_of_each(fresh.join(limits, "project"), "project", F.col("most_symbols"), "first_", "name", deal="name")
    able = rows.join(fresh.select("project", "name", F.lit(True).alias("new_")), ["project", "name"], "left").filter("name is null or held_ or new_").join(limits, "project")
    return relational.first_of_each(able, "project", F.col("most_edges"), *order, "id", deal="id").select("project", "id", "path", "line", "kind", "relationship", "target", F.col("new_").isNotNull().alias("derived"), "place_")
