"""Queries that read code and tool reports: texts made from the tables stand for source files and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.sources import reports, trees
from tracewright.plans.base import query, table
from tracewright.streaming import state


@query("s10_semgrep_reports", "SELECT 'f' || (l_partkey % 100) AS path, CASE l_returnflag WHEN 'R' THEN 'risk' WHEN 'A' THEN 'attention' ELSE 'info' END AS severity, count(*) AS n, min(l_linenumber)::BIGINT AS line FROM lineitem GROUP BY ALL")
def semgrep(spark, sf_dir):
    severity = F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "WARNING").otherwise("INFO")
    item = F.struct(F.lit("rule").alias("check_id"), F.concat(F.lit("f"), (F.col("l_partkey") % 100).cast("string")).alias("path"), F.struct(F.col("l_linenumber").alias("line")).alias("start"), F.struct(severity.alias("severity"), F.lit("m").alias("message")).alias("extra"))
    rows = table(spark, sf_dir, "lineitem").select(F.to_json(F.struct(F.array(item).alias("results"))).alias("json"))
    return reports.semgrep(rows).groupBy("path", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))


@query("s10_advisories", """SELECT 'npm|' || p_brand || '|' || p_size AS package, count(*) AS n FROM part GROUP BY 1""")
def advisories(spark, sf_dir):
    artifact = F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("node").alias("type"))
    match = F.struct(F.struct(F.concat(F.lit("V-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("High").alias("severity")).alias("vulnerability"), artifact.alias("artifact"))
    rows = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(match).alias("matches"))).alias("json"))
    return reports.grype(rows).groupBy("package").agg(F.count(F.lit(1)).alias("n"))


@query("s5_name_status", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'R100' WHEN o_orderkey % 3 = 1 THEN 'M' ELSE 'D' END AS status, o_orderpriority AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS old_path, count(*) AS n FROM orders GROUP BY ALL")
def name_status(spark, sf_dir):
    third = F.col("o_orderkey") % 3
    line = F.when(third == 0, F.concat_ws("\t", F.lit("R100"), "o_orderstatus", "o_orderpriority")).when(third == 1, F.concat_ws("\t", F.lit("M"), "o_orderpriority")).otherwise(F.concat_ws("\t", F.lit("D"), "o_orderpriority"))
    found = trees.name_status(table(spark, sf_dir, "orders").select(line.alias("line")))
    return found.groupBy("status", "path", "old_path").agg(F.count(F.lit(1)).alias("n"))


@query("s7_manifest_delta", """WITH b AS (SELECT p_partkey AS k, p_size AS h FROM part WHERE p_partkey % 5 <> 0), a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 3 <> 0)
 SELECT coalesce(a.k, b.k)::VARCHAR AS path, CASE WHEN b.k IS NULL THEN 'A' WHEN a.k IS NULL THEN 'D' ELSE 'M' END AS status FROM b FULL JOIN a ON a.k = b.k WHERE b.k IS NULL OR a.k IS NULL OR a.h <> b.h""")
def manifest_delta(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("h"))
    before = part.filter("k % 5 != 0").select(F.col("k").cast("string").alias("path"), F.col("h").cast("string").alias("hash"))
    after = part.filter("k % 3 != 0").select(F.col("k").cast("string").alias("path"), F.when(F.col("k") % 7 == 0, F.col("h") + 1).otherwise(F.col("h")).cast("string").alias("hash"))
    return trees.manifest_delta(before, after)


# the SQL numbers failures since the last success, points from each to the first one a window later, and follows the pointers
def _throttle_sql(user: str, micros: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY micros, event_id) AS since
    FROM (SELECT event_id, {user} AS user_id, event_type, {micros} AS micros FROM events WHERE event_type IN ('error', 'purchase'))),
  f AS (SELECT event_id, user_id, since, row_number() OVER (PARTITION BY user_id, since ORDER BY micros, event_id) AS n,
    count(*) OVER (PARTITION BY user_id, since ORDER BY micros RANGE BETWEEN UNBOUNDED PRECEDING AND {state.WINDOW * 1_000_000 - 1} FOLLOWING) + 1 AS next FROM e WHERE event_type = 'error'),
  s AS (SELECT user_id, since, n, next FROM f WHERE n = 1 UNION ALL SELECT f.user_id, f.since, f.n, f.next FROM s JOIN f ON f.user_id = s.user_id AND f.since = s.since AND f.n = s.next),
  w AS (SELECT event_id, user_id, n - max(start) OVER (PARTITION BY user_id, since ORDER BY n) + 1 AS failures FROM (SELECT f.*, s.n AS start FROM f LEFT JOIN s USING (user_id, since, n)))
  SELECT event_id, user_id, failures, failures >= {state.MOST_FAILURES} AS locked FROM w"""


@query("w7_throttle", _throttle_sql("user_id", "epoch_us(ts)"))
def throttle(spark, sf_dir):
    """Failures of each user in windows that start at the first one."""
    return state.throttled(table(spark, sf_dir, "events"))


@query("w7_throttle_busy", _throttle_sql("user_id % 4", "epoch_us(ts) // 128"))
def throttle_busy(spark, sf_dir):
    """The same with all users as four and 128 times as fast, so that keys lock and windows follow each other."""
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 128))
    return state.throttled(table(spark, sf_dir, "events").withColumn("ts", at).withColumn("user_id", F.col("user_id") % 4))
