"""How queries are registered, and the tables they share.

A query is a function of (spark, sf_dir) with the SQL that must give the same rows. Names say which operator it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.functions import labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Files: pages stand for source files. The path comes from the url, the ending from its number.
ENDINGS = ("ts", "tsx", "js", "php", "py", "md", "sql", "json", "css", "vue", "go", "")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, content."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*/", ""), r"[?#].*$", "")
    kind = F.element_at(F.array(*map(F.lit, ("app", "api", "routes", "tests", "models", "components", "lib"))), (F.col("page_id") % 7 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    path = F.concat(kind, F.lit("/"), bare, F.lit("-"), F.col("page_id").cast("string"), F.when(ending == "", "").otherwise(F.concat(F.lit("."), ending)))
    return pages.select("page_id", path.alias("path"), F.col("html").alias("content"))


FILES_SQL = f"""named AS (
  SELECT page_id, list_extract(['app', 'api', 'routes', 'tests', 'models', 'components', 'lib'], (page_id % 7 + 1)::INT) || '/' ||
         regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') || '-' || page_id::VARCHAR ||
         (CASE WHEN e = '' THEN '' ELSE '.' || e END) AS path, html AS content
  FROM (SELECT *, list_extract({list(ENDINGS)!r}, (page_id % {len(ENDINGS)} + 1)::INT) AS e FROM pages)),
  files AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM named)"""

# Graph: parts stand for symbols, edges follow from their numbers (sparse, with cycles).


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("class", "method", "function", "table", "external_service", "component", "route"))), (F.col("p_size") % 7 + 1).cast("int"))
    confidence = F.element_at(F.array(*map(F.lit, labels.CONFIDENCES)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.lit("."), F.col("p_name")).alias("qualified_name"),
        kind.alias("type"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_brand")).alias("path"), confidence.alias("confidence"), F.col("p_size").cast("long").alias("size"),
    )


SYMBOLS_SQL = """symbols AS (
  SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name,
         list_extract(['class', 'method', 'function', 'table', 'external_service', 'component', 'route'], (p_size % 7 + 1)::INT) AS type,
         'src/' || lower(p_type) || '/' || p_brand AS path,
         list_extract(['low', 'medium', 'high'], (p_partkey % 3 + 1)::INT) AS confidence, p_size::BIGINT AS size FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, source, target, type, confidence: 7k + 3 for each part, and k + size for every third size."""
    part = table(spark, sf_dir, "part")
    # the number of parts comes as one row, when the query runs
    part, n = part.crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("parts")))), F.col("parts")
    key = F.col("p_partkey")
    confidence = F.element_at(F.array(*map(F.lit, labels.CONFIDENCES)), (F.col("p_size") % 3 + 1).cast("int"))
    one = part.select((key * 2).alias("edge_id"), key.alias("source"), ((key * 7 + 3) % n).alias("target"), F.lit("calls").alias("type"), confidence.alias("confidence"))
    two = part.filter("p_size % 3 = 0").select((key * 2 + 1).alias("edge_id"), key.alias("source"), ((key + F.col("p_size")) % n).alias("target"), F.lit("reads_table").alias("type"), F.lit("high").alias("confidence"))
    return one.unionByName(two)


EDGES_SQL = """edges AS (
  SELECT p_partkey * 2 AS edge_id, p_partkey AS source, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS target, 'calls' AS type,
         list_extract(['low', 'medium', 'high'], (p_size % 3 + 1)::INT) AS confidence FROM part
  UNION ALL
  SELECT p_partkey * 2 + 1, p_partkey, (p_partkey + p_size) % (SELECT count(*) FROM part), 'reads_table', 'high' FROM part WHERE p_size % 3 = 0)"""


def case_rules(rules, signal: str, default: str) -> str:
    """The SQL of an ordered list of (name, pattern) rules."""
    text = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(signal, p.replace("'", "''"), n) for n, p in rules)
    return f"CASE {text} ELSE '{default}' END"
