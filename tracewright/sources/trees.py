"""Source trees and version histories as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tracewright.functions import paths, text

# Limits of a scan and folders that it passes over.
MOST_BYTES, MOST_FILES, MOST_TOTAL = 262_144, 3_000, 20 * 1024 * 1024
SKIPPED = (".git", "node_modules", "vendor", "dist", "build", "coverage", ".next", ".nuxt", "target", "__pycache__", ".venv", "venv", ".cache", ".idea", "storage")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Readable files under a folder: path (relative), size, content. Binary files, large ones and skipped folders go."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), r"/+$", "")
    relative = F.regexp_replace("path", F.concat(F.lit(r"^.*?\Q"), F.regexp_replace(base, r"^[a-z]+:/*", "/"), F.lit(r"\E/")), "")
    rows = raw.filter(F.col("length") <= MOST_BYTES).select(relative.alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))
    rows = rows.filter(paths.readable(F.col("path")) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    return rows.filter(F.try_to_binary(F.hex("raw"), F.lit("hex")).isNotNull() & (F.locate("00", F.regexp_replace(F.hex("raw"), "(..)", "$1 ")) == 0)).select("path", "size", F.decode("raw", "UTF-8").alias("content"))


def source_files(tree: DataFrame) -> DataFrame:
    """Files with language, lines, digest, role, summary, imports and declared names."""
    path, content = F.col("path"), F.col("content")
    role = paths.role(path, content)
    return tree.select(
        "path", paths.language(path).alias("language"), F.length(F.encode(content, "UTF-8")).cast("long").alias("size"), text.line_count(content).alias("lines"), F.sha2(content, 256).alias("hash"), "content", role.alias("role"),
        paths.summary(role).alias("summary"), text.imports(path, content).alias("imports"), text.symbols(path, content).alias("symbols"),
    )


def within_limits(files: DataFrame, most_files: int = MOST_FILES, most_total: int = MOST_TOTAL) -> DataFrame:
    """The first files by path up to both limits, with ``limited`` on every row if any file was left out. The order is that
    of paths: a scan's own order differs between file systems. For one tree, whose size the limits bound."""
    order = W.orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    marked = files.withColumn("n_", F.count(F.lit(1)).over(order)).withColumn("total_", F.sum("size").over(order))
    ok = (F.col("n_") <= most_files) & (F.col("total_") <= most_total)
    return marked.withColumn("limited", ~F.bool_and(ok).over(W.partitionBy())).filter(ok).drop("n_", "total_")


def lines(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no from 1, line)."""
    return files.select(key, F.posexplode(text.lines(F.col("content"))).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def excerpt(files: DataFrame, path: str, start: int, end: int, around: int = 3, most: int = 121) -> DataFrame:
    """Lines start - 3 to end + 3 of a file, at most 121; paths that climb out of the tree give nothing."""
    if path.startswith("/") or ".." in path.split("/"):
        return lines(files.limit(0))
    low = max(1, start - around)
    return lines(files.filter(F.col("path") == path)).filter(F.col("line_no").between(low, min(end + around, low + most - 1)))


def manifest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that came, went or changed their hash between two manifests (path, hash), with a status letter."""
    a, b = before.select("path", F.col("hash").alias("old")), after.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).filter("status is not null")


def name_status(rows: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a name-status listing as status, path and, for renames and copies, old_path."""
    part = F.split(line, "\t")
    renamed = part[0].rlike(r"^[RC]\d*$")
    return rows.select(part[0].alias("status"), F.element_at(part, -1).alias("path"), F.when(renamed, part[1]).alias("old_path"))


def commits(rows: DataFrame, line: str = "line") -> DataFrame:
    """Rows 'sha<TAB>subject' of a log."""
    part = F.split(line, "\t", 2)
    return rows.select(part[0].alias("sha"), part[1].alias("subject"))


def revision(files: DataFrame) -> DataFrame:
    """One digest of all (path, hash): digests by bucket first, so that the last task sees 4,096 values at most."""
    item = F.concat_ws(":", "path", "hash")
    by = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256).alias("d"))
    return by.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x.d), "|"), 256).alias("revision"))


def json_or_null(column: Column, schema: str) -> Column:
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})
