"""Guard of changes: what a project's evidence says at one time, its fingerprint, and what differs at a later one.

A capture is six ordered sets of texts for each project and ref. Each is taken from the first rows in a fixed order, up to a
limit that is a parameter; repeats then fall together and secrets are redacted. Null parts of a text are empty, so rows that
differ in nulls only are one. Ties end in the text itself or the id, so captures do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions import labels, text
from tracewright.operators.graph import degrees

# Kinds and how many rows of each are captured, types of symbols, the kinds that may break callers, and advice.
LIMITS = {"routes": 500, "schema": 1200, "dependencies": 3000, "critical_symbols": 2000, "security": 2000, "architecture": 300}
CRITICAL = ("controller", "model", "class", "component", "function", "method", "table", "schema", "external_service")
SCHEMA = ("table", "schema", "column", "view", "procedure", "trigger")
MAY_BREAK = ("routes", "schema", "dependencies", "critical_symbols", "security")
TESTS = "Run the repository test suite for the changed files."
TESTS_OF = {
    "routes": "Exercise affected API and browser request flows, including authorization failures.",
    "schema": "Apply migrations to a disposable database and verify rollback/data compatibility.",
    "dependencies": "Run lockfile integrity, build, and dependency vulnerability checks.",
    "security": "Rerun the Security profile and manually review changed trust boundaries.",
}


def _joined(separator: str, *columns: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(separator, *parts)


def _first(rows: DataFrame, kind: str, item: Column, most: int, *order) -> DataFrame:
    """(project, ref, kind, rank, item) of the first rows; rows beyond the limit are dropped before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy("project", "ref").orderBy(*order, "item"))
    ranked = rows.withColumn("item", item).withColumn("rank", rank).filter(F.col("rank") <= most)
    return ranked.select("project", "ref", F.lit(kind).alias("kind"), "rank", text.redact(F.col("item")).alias("item"))


def capture(routes: DataFrame, symbols: DataFrame, packages: DataFrame, findings: DataFrame, relationships: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(project, ref, kind, rank, item), rank being the first place of an item.

    All tables have project and ref, and: routes method, path; symbols id (unique in a ref), type, qualified_name, signature,
    path, role, confidence; packages ecosystem, name, version; findings type, severity, path, rule; relationships source, target.
    """
    # the areas of the symbols with most relationships
    ends = relationships.select(F.struct("ref", "source").alias("source"), F.when(F.col("target").isNotNull(), F.struct("ref", F.col("target").alias("source"))).alias("target"))
    degree = degrees(ends).select("id.ref", F.col("id.source").alias("id"), "degree")
    subsystem = labels.subsystem(F.col("type"), F.col("path"), F.coalesce("role", F.lit("")))
    areas = symbols.join(degree, ["ref", "id"], "left").withColumn("subsystem", subsystem)
    sets = (
        _first(routes, "routes", _joined(" ", "method", "path"), limits["routes"], "path", "method"),
        _first(symbols.filter(F.col("type").isin(*SCHEMA)), "schema", _joined(":", "type", "qualified_name"), limits["schema"], "qualified_name", "type"),
        _first(packages, "dependencies", F.concat(_joined(":", "ecosystem", "name"), F.lit("@"), _joined("", "version")), limits["dependencies"], "ecosystem", "name"),
        _first(symbols.filter(F.col("type").isin(*CRITICAL)), "critical_symbols", _joined(":", "type", "qualified_name", "signature"), limits["critical_symbols"], "type", "qualified_name"),
        _first(findings, "security", _joined(":", "type", "severity", "path", "rule"), limits["security"], "type", "path"),
        _first(areas, "architecture", F.concat(labels.architecture(F.col("subsystem")), F.lit(">"), "subsystem"), limits["architecture"],
               F.coalesce("degree", F.lit(0)).desc(), labels.rank_in(labels.CONFIDENCES, F.col("confidence")).desc(), "id"),
    )
    return reduce(DataFrame.union, sets).groupBy("project", "ref", "kind", "item").agg(F.min("rank").alias("rank")).select("project", "ref", "kind", "rank", "item")


def fingerprints(captured: DataFrame) -> DataFrame:
    """(project, ref, items, fingerprint): the hash of the six sets as JSON, in order. A capture is bounded by its limits."""
    sets = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "item")))), lambda x: x["item"]).alias(k) for k in LIMITS]
    whole = captured.groupBy("project", "ref").agg(F.count(F.lit(1)).alias("items"), *sets)
    return whole.select("project", "ref", "items", F.sha2(F.to_json(F.struct(*LIMITS)), 256).alias("fingerprint"))


def _flags(captured: DataFrame, before: str, after: str) -> DataFrame:
    rows = captured.filter(F.col("ref").isin(before, after)).groupBy("project", "kind", "item")
    return rows.agg(F.bool_or(F.col("ref") == before).alias("was"), F.bool_or(F.col("ref") == after).alias("now"))


def changes(captured: DataFrame, before: str, after: str) -> DataFrame:
    """(project, kind, change, item): items that only one of two captures has, added or removed."""
    return _flags(captured, before, after).filter("was <> now").select("project", "kind", F.when(F.col("now"), "added").otherwise("removed").alias("change"), "item")


def verdicts(captured: DataFrame, before: str, after: str) -> DataFrame:
    """(project, added, removed, changed_kinds, may_break, tests) of projects with both captures, kinds in their fixed order."""
    came, went = F.col("now") & ~F.col("was"), F.col("was") & ~F.col("now")
    each = [F.bool_or((F.col("kind") == k) & (came | went)).alias(k) for k in LIMITS]
    one = _flags(captured, before, after).groupBy("project").agg(F.bool_or("was").alias("b"), F.bool_or("now").alias("a"), F.count_if(came).alias("added"), F.count_if(went).alias("removed"), *each)
    named = lambda kinds: F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in kinds)))
    tests = F.array_compact(F.array(F.lit(TESTS), *(F.when(F.col(k), F.lit(t)) for k, t in TESTS_OF.items())))
    return one.filter("a AND b").select("project", "added", "removed", named(LIMITS).alias("changed_kinds"), named(MAY_BREAK).alias("may_break"), tests.alias("tests"))
