"""Findings over files: duplicates, counts, imports and their targets, drift between intent and change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions import paths


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def duplicate_members(files: DataFrame) -> DataFrame:
    """Members of groups of equal digests: (doc_id, digest) to digest, copies, first_doc, doc_id. No row holds a group."""
    groups = files.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")
    groups = groups.withColumnRenamed("digest", "group_digest")
    return files.join(groups, F.col("digest").eqNullSafe(F.col("group_digest"))).select("digest", "copies", "first_doc", "doc_id")


def duplicate_content(files: DataFrame) -> DataFrame:
    """Groups of equal digests: (doc_id, digest) to digest, copies, first_doc, docs. A group is one row with all its ids;
    duplicate_members has a row for each instead."""
    groups = files.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.array_sort(F.collect_list("doc_id")).alias("ids")).filter("copies > 1")
    return groups.select("digest", "copies", "first_doc", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("docs"))


def resolve_imports(links: DataFrame, known: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with path and import gain target: the first candidate among the known paths, or null. With ``within``, columns
    of both, only among the known paths that are equal in them."""
    names, own = links.columns, [*within, "path", "import"]
    asked = links.select(*own).distinct().select(*own, F.posexplode(paths.import_candidates(F.col("path"), F.col("import"))).alias("place", "known"))
    best = asked.join(known.select(*within, "known").distinct(), [*within, "known"]).groupBy(*own).agg(F.min_by("known", "place").alias("target"))
    return links.join(best, own, "left").select(*names, "target")


def unresolved_imports(links: DataFrame, known: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Relative imports that no known path answers."""
    return resolve_imports(links, known, within).filter(F.col("import").startswith(".") & F.col("target").isNull()).drop("target")


def also_changed(expected: Column, actual: Column) -> Column:
    """Areas changed beyond the expected ones; tests never count, application code only if it was the whole intent."""
    generic = F.when((F.size(expected) == 1) & (F.element_at(expected, 1) == paths.OTHER_AREA), F.array(F.lit("Tests"))).otherwise(F.array(F.lit("Tests"), F.lit(paths.OTHER_AREA)))
    return F.array_except(F.array_except(F.array_distinct(actual), expected), generic)
