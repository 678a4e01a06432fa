"""Fusing what several engines report into one set of facts with provenance.

First-wins rules follow (engine_ord, fact_ord), never the order of partitions. Groups aggregate with map-side combining;
engines of a fact are a set of at most as many members as there are engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions import labels
from tracewright.operators.graph import kept


def named(*parts: Column) -> Column:
    """The text that tells facts apart."""
    return F.lower(F.concat_ws("|", *parts))


def identity(*parts: Column) -> Column:
    return F.sha2(named(*parts), 256)


def successful(facts: DataFrame) -> DataFrame:
    """Facts of engines whose run succeeded at least in part; nameless facts go."""
    return facts.filter(F.col("status").isin("success", "partial") & F.coalesce(F.trim("name") != "", F.lit(False)))


def normalized_symbols(facts: DataFrame) -> DataFrame:
    """Trimmed names and paths, lines from 1 on, unknown confidences as medium."""
    out = facts.withColumn("name", F.trim("name")).withColumn("path", F.translate(F.trim("path"), "\\", "/"))
    out = out.withColumn("start_line", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)))
    out = out.withColumn("end_line", F.greatest(F.coalesce("end_line", "start_line"), "start_line"))
    return out.withColumn("confidence", F.when(F.col("confidence").isin(*labels.CONFIDENCES), F.col("confidence")).otherwise("medium"))


def fuse(facts: DataFrame, key: Column, base: list[str]) -> DataFrame:
    """One row for each identity: columns of the first fact, strongest confidence, engines, number of facts, label.

    The label is the strongest that any one fact earns, or 'confirmed' where two engines agree on more than low evidence.
    """
    order = F.struct("engine_ord", "fact_ord")
    alone = labels.evidence_label(F.col("engine"), F.col("confidence"), F.lit(1), F.col("documentation"))
    rows = facts.withColumn("identity", key).withColumn("alone", labels.rank_in(labels.LABELS, alone))
    found = rows.groupBy("identity").agg(
        F.min_by(F.struct(*base), order).alias("first"),
        F.max(labels.rank_in(labels.CONFIDENCES, F.col("confidence"))).alias("c"),
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.count(F.lit(1)).alias("facts"),
        F.max("alone").alias("alone"),
        F.bool_and("documentation").alias("documentation"),
    )
    agreed = (F.size("engines") > 1) & (F.col("c") > 1) & ~F.col("documentation")
    label = F.when(agreed, "confirmed").otherwise(labels.name_at(labels.LABELS, F.col("alone")))
    return found.select("identity", "first.*", labels.name_at(labels.CONFIDENCES, F.col("c")).alias("confidence"), "engines", "facts", label.alias("label"))


def fuse_symbols(facts: DataFrame) -> DataFrame:
    key = identity(F.col("language"), F.col("path"), F.col("qualified_name"), F.col("type"), F.col("start_line"), F.col("end_line"))
    return fuse(normalized_symbols(successful(facts)), key, ["key", "path", "name", "qualified_name", "type"])


def remapped(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with their ends' engine keys replaced by fused keys (engine, key, fused); unknown ends stay null."""
    one = keys.select("engine", F.col("key").alias("source_key"), F.col("fused").alias("source"))
    two = keys.select("engine", F.col("key").alias("target_key"), F.col("fused").alias("target"))
    return edges.join(one, ["engine", "source_key"], "left").join(two, ["engine", "target_key"], "left")


def fuse_relationships(edges: DataFrame) -> DataFrame:
    key = identity(F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")), F.coalesce("external_name", "name"), F.col("type"), F.col("path"), F.col("start_line"))
    return fuse(successful(edges), key, ["source", "target", "name", "type", "path", "start_line"])


def fuse_routes(routes: DataFrame) -> DataFrame:
    return fuse(successful(routes), identity(F.col("path"), F.col("method"), F.col("route"), F.col("start_line")), ["path", "method", "route", "name", "start_line"])


def fuse_packages(packages: DataFrame) -> DataFrame:
    """One row for each purl, or ecosystem, name and version: strongest class, united licenses, locations and engines."""
    key = F.coalesce(F.lower(F.when(F.col("purl") != "", F.col("purl"))), F.lower(F.concat_ws("|", "ecosystem", "name", "version")))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = packages.groupBy(key.alias("identity")).agg(
        F.min_by(F.struct("name", "version", "ecosystem"), F.struct("engine_ord", "fact_ord")).alias("first"), F.max(labels.rank_in(labels.PACKAGE_CLASSES, F.col("classification"))).alias("c"), united("licenses").alias("licenses"),
        united("locations").alias("locations"), F.array_sort(F.collect_set("engine")).alias("engines"),
    )
    return found.select("identity", "first.*", labels.name_at(labels.PACKAGE_CLASSES, F.col("c")).alias("classification"), "licenses", "locations", "engines")


def fuse_findings(findings: DataFrame) -> DataFrame:
    """Findings of one rule, path, line and type from several engines as one: strongest severity, engines, label.

    Rows meet under the text that the identity is a digest of, which takes less room in shuffles and spills.
    """
    key = named(F.col("type"), F.coalesce("path", F.lit("")), F.coalesce(F.col("line"), F.lit(0)), F.coalesce("rule", F.lit("")))
    found = findings.groupBy(key.alias("named")).agg(
        F.min_by(F.struct("title", "path", "line", "type"), F.struct("engine_ord", "fact_ord")).alias("first"), F.max(labels.rank_in(labels.SEVERITIES, F.col("severity"))).alias("s"), F.array_sort(F.collect_set("engine")).alias("engines")
    )
    return found.select(F.sha2("named", 256).alias("identity"), "first.*", labels.name_at(labels.SEVERITIES, F.col("s")).alias("severity"), "engines", F.when(F.size("engines") > 1, "confirmed").otherwise("single source").alias("label"))


def alias_groups(advisories: DataFrame) -> DataFrame:
    """Advisories of one package version that share an id or alias, directly or through others, as one group.

    Groups are connected components of the id graph of a package version: (package, ids array) gain group, the least id
    of the component. Unlike a greedy merge the result does not depend on order. A round takes the least group met through
    shared ids, then that group's own least, so that chains shorten by more than a link a round.
    """
    rows = advisories.withColumn("row", F.sha2(F.concat_ws("|", "package", F.array_join(F.array_sort("ids"), ",")), 256))
    node = F.concat_ws("|", "package", "id")
    pairs = kept(rows.select("package", "row", F.explode("ids").alias("id")).select("row", node.alias("node")).distinct())
    group, settled = kept(pairs.groupBy("row").agg(F.min("node").alias("group"))), False
    while not settled:
        least = kept(pairs.join(group, "row").groupBy("node").agg(F.min("group").alias("low")))
        near = pairs.join(least, "node").groupBy("row").agg(F.min("low").alias("near"))
        far = least.select(F.col("node").alias("near"), F.col("low").alias("group"))
        new = kept(near.join(far, "near").select("row", "group"))
        settled = new.alias("n").join(group.alias("g"), "row").filter("n.group != g.group").isEmpty()
        group = new
    return rows.join(group, "row").drop("row")


def disagreements(edges: DataFrame) -> DataFrame:
    """Facts that two or more engines report with differing resolution or confidence; an engine's last word counts."""
    key = identity(F.col("path"), F.col("start_line"), F.col("type"), F.coalesce("external_name", "name"))
    last = W.partitionBy("fact", "engine").orderBy(F.col("fact_ord").desc())
    rows = successful(edges).withColumn("fact", key).withColumn("n", F.row_number().over(last)).filter("n = 1")
    found = rows.groupBy("fact").agg(
        F.count(F.lit(1)).alias("engines"), F.countDistinct(F.col("target").isNotNull()).alias("resolutions"), F.countDistinct("confidence").alias("confidences"), F.min("type").alias("type"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "engine", "confidence"))), ",").alias("says"),
    )
    return found.filter("engines > 1 and (resolutions > 1 or confidences > 1)")


def incremental(previous: DataFrame, fresh: DataFrame, paths: DataFrame) -> DataFrame:
    """Facts after re-analysing some paths: their old facts go, the fresh ones come."""
    return previous.join(paths.select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def neighbourhood(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths one edge away from the changed ones, and those themselves. edges: source_path, target_path."""
    one = edges.join(changed.select(F.col("path").alias("source_path")), "source_path", "left_semi").select(F.col("target_path").alias("path"))
    two = edges.join(changed.select(F.col("path").alias("target_path")), "target_path", "left_semi").select(F.col("source_path").alias("path"))
    return changed.select("path").union(one).union(two).filter("path is not null").distinct()


def resolve_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unresolved edges (name) gain resolved: the only symbol of the first tier that knows the name (qualified name, name,
    last part of the name, in any case); a tier with several ends the search without a target."""

    def tier(column: str, to: str) -> DataFrame:
        return symbols.groupBy(F.lower(column).alias(to)).agg(F.count(F.lit(1)).alias(f"{to}_n"), F.min("id").alias(f"{to}_id"))

    low = F.lower("name")
    asked = edges.withColumn("q", low).withColumn("n", low).withColumn("s", F.element_at(F.split(low, r"[\\.]"), -1))
    found = asked.join(tier("qualified_name", "q"), "q", "left").join(tier("name", "n"), "n", "left").join(tier("name", "s"), "s", "left")
    pick = F.when(F.col("q_n").isNotNull(), F.when(F.col("q_n") == 1, F.col("q_id"))).when(F.col("n_n").isNotNull(), F.when(F.col("n_n") == 1, F.col("n_id"))).when(F.col("s_n") == 1, F.col("s_id"))
    return found.withColumn("resolved", pick).select(*edges.columns, "resolved")
