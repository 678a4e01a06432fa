"""Sweeps over the lines of files: where a scope ends, and which scope a line is in.

Scopes are found by windows over lines in order, never by joining scopes with lines, so the work is linear in lines. Every
window runs within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions import text

FILE = ("project", "path")


def numbered(files: DataFrame) -> DataFrame:
    """(project, path, language, line_no, line, trimmed) of files (path, language, content, and project if they have one)."""
    project = F.col("project") if "project" in files.columns else F.lit(0)
    rows = files.select(project.cast("long").alias("project"), "path", "language", F.posexplode(text.lines(F.coalesce("content", F.lit("")))).alias("n", "line"))
    return rows.select(*FILE, "language", (F.col("n") + 1).alias("line_no"), "line", F.regexp_replace("line", r"^\s+|\s+$", "").alias("trimmed"))


def filled(value: Column, upto: int = 0) -> Column:
    """The last value that is not null, on this line or ``-upto`` lines before."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*FILE).orderBy("line_no").rowsBetween(W.unboundedPreceding, upto))


def braced(lines: DataFrame, counted: Column) -> DataFrame:
    """Adds opened (braces that a line opens), before and after (depth), from the text in which braces count."""
    opened, closed = F.regexp_count(counted, F.lit(r"\{")), F.regexp_count(counted, F.lit(r"\}"))
    upto = F.sum(opened - closed).over(W.partitionBy(*FILE).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("opened", opened).withColumn("after", upto).withColumn("before", F.col("after") - opened + closed)


def indented(lines: DataFrame) -> DataFrame:
    """Adds indent, and above, the indent of the last line before that is not blank (null on blank lines)."""
    indent = F.when(F.col("trimmed") != "", F.length("line") - F.length(F.regexp_replace("line", r"^[ \t]+", "")))
    return lines.withColumn("indent", indent).withColumn("above", F.when(indent.isNotNull(), filled(indent, -1)))


def ends(scopes: DataFrame, lines: DataFrame, low: str, high: str, past: int = 0) -> DataFrame:
    """Scopes (file, line_no, level, shut) with the end: their own line where shut, else the next later line whose levels low to
    high, those it closes, hold theirs; ``past`` 1 if that line is already outside. Null where none comes."""
    closing = lines.filter(F.col(low) <= F.col(high)).select(*FILE, F.explode(F.sequence(low, high)).alias("level"), F.col("line_no").alias("at"), F.lit(None).cast(scopes.schema["scope"].dataType).alias("scope"), F.lit(False).alias("shut"))
    rows = scopes.select(*FILE, "level", F.col("line_no").alias("at"), "scope", "shut").unionByName(closing)
    # from the last line to the first: the closing line met last is the next one; at equal places scopes come first
    later = W.partitionBy(*FILE, "level").orderBy(F.desc("at"), F.desc(F.col("scope").isNotNull())).rowsBetween(W.unboundedPreceding, -1)
    end = F.last(F.when(F.col("scope").isNull(), F.col("at")), ignorenulls=True).over(later) - past
    return rows.withColumn("end", F.when(F.col("shut"), F.col("at")).otherwise(end)).filter("scope is not null").select(*FILE, F.col("at").alias("line_no"), "scope", "end")


def owners(lines: DataFrame, scopes: DataFrame, name: str) -> DataFrame:
    """Lines with the innermost scope that began before them and has not ended (struct ``name``, null outside).

    Scopes (file, line_no, scope, end) lie within each other or apart, one a line. The number of open scopes at a line names
    a level; the last scope that began at this level is the one that is still open.
    """
    kept = [c for c in lines.columns if c not in (*FILE, "line_no")]
    none = F.lit(None).cast(scopes.schema["scope"].dataType)
    shape = lines.select(F.struct(*kept)).schema[0].dataType
    rows = lines.select(*FILE, F.col("line_no").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"), F.struct(*kept).alias("own"), none.alias("scope"))
    began = scopes.select(*FILE, F.col("line_no").alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("step"), F.lit(None).cast(shape).alias("own"), "scope")
    ended = scopes.filter("end is not null").select(*FILE, (F.col("end") + 1).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(shape).alias("own"), none.alias("scope"))
    order = W.partitionBy(*FILE).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = rows.unionByName(began).unionByName(ended).withColumn("level", F.sum("step").over(order))
    within = W.partitionBy(*FILE, "level").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = swept.withColumn("held", F.when(F.col("level") > 0, F.last("scope", ignorenulls=True).over(within)))
    return swept.filter("kind = 1").select(*FILE, F.col("at").alias("line_no"), "own.*", F.col("held").alias(name))
