"""Queries of the relational kind: filters, joins, aggregates, rankings, paging, deltas."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from tracewright.operators import relational as op
from tracewright.plans.base import SYMBOLS_SQL, query, symbols, table


@query("f1_f4_owned_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT'")
def owned(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey", "o_custkey")


@query("f2_f3_like_search", "SELECT p_partkey, p_name LIKE '%Ring%' AS sensitive, lower(p_name) LIKE '%ring%' AS insensitive FROM part")
def like_search(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").like("%Ring%").alias("sensitive"), F.col("p_name").ilike("%ring%").alias("insensitive"))


@query("f5_f11_null_safe", "SELECT count(*) FILTER (q IS NULL) AS nulls, count(*) FILTER (q IS NOT DISTINCT FROM nullif(d, 2)) AS same FROM (SELECT nullif(d, 1) AS q, d FROM (SELECT doc_id % 3 AS d FROM documents))")
def null_safe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("d")).select(F.nullif("d", F.lit(1)).alias("q"), F.nullif("d", F.lit(2)).alias("r"))
    return d.agg(F.count_if(F.col("q").isNull()).alias("nulls"), F.count_if(F.col("q").eqNullSafe(F.col("r"))).alias("same"))


@query("f6_exists_filter", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def exists_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("f8_time_predicates", "SELECT event_type, count(*) FILTER (ts <= TIMESTAMP '2024-01-15 00:00:00') AS due, count(*) FILTER (ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTE) AS stale FROM events GROUP BY 1")
def time_predicates(spark, sf_dir):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("ts") <= now).alias("due"), F.count_if(F.col("ts") < now - F.expr("INTERVAL 15 MINUTES")).alias("stale"))


@query("f10_exact_preferred", f"WITH {SYMBOLS_SQL}, m AS (SELECT *, lower(name) = 'red ring' AS exact FROM symbols WHERE lower(name) LIKE '%ring%') SELECT id, name FROM m WHERE exact OR NOT (SELECT bool_or(exact) FROM m)")
def exact_preferred(spark, sf_dir):
    found = symbols(spark, sf_dir).filter(F.col("name").ilike("%ring%"))
    return op.exact_or_all(found, F.lower("name") == "red ring").select("id", "name")


@query("j1_j3_star_enrichment", """SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, s.s_name FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
 JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey LEFT JOIN supplier s ON l_suppkey = s_suppkey WHERE l.l_linenumber = 1""")
def star(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey")
    met = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return met.select("o_orderkey", "c_name", "n_name", "r_name", "s_name")


@query("j4_anti_pending", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def pending(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j5_pair_self_join", "SELECT a.conv_id, a.turn, length(b.text) - length(a.text) AS grown FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def pairs(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.length("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("next") - F.length("text")).cast("long").alias("grown"))


@query("j6_j17_latest_per_key", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest(spark, sf_dir):
    return op.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.col("ts").alias("at")), "user_id", "at").select("user_id", "event_type", "ts")


@query("j11_interval_containment", """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS at FROM documents),
 r AS (SELECT doc_id, k AS id, k * k AS low, k * k + 3 * k + 2 AS high FROM documents, (SELECT unnest(range(0, 5)) AS k)),
 m AS (SELECT l.doc_id, l.at, r.id, row_number() OVER (PARTITION BY l.doc_id, l.at ORDER BY r.high - r.low, r.id) AS n FROM l JOIN r ON l.doc_id = r.doc_id AND l.at BETWEEN r.low AND r.high)
 SELECT l.doc_id, l.at, m.id FROM l LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON l.doc_id = m.doc_id AND l.at = m.at""")
def containment(spark, sf_dir):
    """Lines and the narrowest of overlapping ranges that holds them."""
    docs = table(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").alias("key"), F.explode(F.sequence(F.lit(1).cast("long"), F.size(F.split("text", "\n", -1)).cast("long"))).alias("at"))
    k = F.col("id")
    ranges = docs.select(F.col("doc_id").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("id")).select("key", "id", (k * k).alias("low"), (k * k + 3 * k + 2).alias("high"))
    return op.contained(points, ranges, 16).select(F.col("key").alias("doc_id"), "at", "id")


@query("j12_next_definition", """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
 SELECT a.doc_id, a.n AS at, min(b.n) AS place FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n + 1 AND a.n + 4 WHERE a.line LIKE '%ing%' AND b.line LIKE '%tion%' GROUP BY 1, 2""")
def next_definition(spark, sf_dir):
    """Lines of one kind and the first line of another kind within the next four."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n").cast("long") + 1)
    marks = lines.filter(F.col("line").contains("ing")).select("key", F.col("n").alias("at"))
    items = lines.filter(F.col("line").contains("tion")).select("key", F.col("n").alias("place"))
    return op.next_within(marks, items).select(F.col("key").alias("doc_id"), "at", "place")


@query("j13_either_key", "SELECT DISTINCT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey OR (c.c_nationkey = s.s_nationkey AND c.c_mktsegment = 'BUILDING')")
def either_key(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    left = c.select(F.col("c_custkey").alias("left"), F.col("c_nationkey").alias("group"), (F.col("c_mktsegment") == "BUILDING").alias("grouped"))
    right = s.select(F.col("s_suppkey").alias("right"), F.col("s_nationkey").alias("group"))
    return op.either_key(left, right).select(F.col("left").alias("c_custkey"), F.col("right").alias("s_suppkey"))


@query("j14_needles_in_texts", "SELECT n.needle, count(*) AS texts FROM (VALUES ('ing'), ('tion'), ('eaux'), ('keit'), ('ción')) n(needle) JOIN documents d ON contains(d.text, n.needle) GROUP BY 1")
def needles(spark, sf_dir):
    """A fixed list of needles met by every text in one pass: no join, one array a row."""
    hits = F.array_compact(F.array(*(F.when(F.col("text").contains(w), F.lit(w)) for w in ("ing", "tion", "eaux", "keit", "ción"))))
    return table(spark, sf_dir, "documents").select(F.explode(hits).alias("needle")).groupBy("needle").agg(F.count(F.lit(1)).alias("texts"))


@query("j15_e20_signature_delta", """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2024-06-01' OR l_linenumber < 3),
 b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS v FROM lineitem WHERE l_linenumber > 1)
 SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN a.l_orderkey IS NULL THEN 'added' WHEN b.l_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM (SELECT l_orderkey, l_linenumber, max(v) v FROM a GROUP BY ALL) a FULL JOIN (SELECT l_orderkey, l_linenumber, max(v) v FROM b GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
 WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR a.v IS DISTINCT FROM b.v""")
def signature_delta(spark, sf_dir):
    lines, key = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    before = lines.filter((F.col("l_shipdate") < F.lit("2024-06-01").cast("timestamp")) | (F.col("l_linenumber") < 3)).groupBy(*key).agg(F.max("l_quantity").alias("v"))
    after = lines.filter("l_linenumber > 1").groupBy(*key).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).alias("v"))
    return op.delta(before, after, key, "v").select(*key, "change")


@query("j16_correlated_counts", "SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS done FROM customer c")
def correlated(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("done", F.lit(0)).alias("done"))


@query("j20_two_key_join", "SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey % 5 = c.c_custkey % 5 GROUP BY 1")
def two_keys(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    counts = c.groupBy("c_nationkey", (F.col("c_custkey") % 5).alias("m")).count()
    met = s.join(counts, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") % 5 == F.col("m")))
    return met.select("s_suppkey", F.col("count").alias("n"))


@query("a1_a5_conditional_counts", "SELECT count(*) AS rows_all, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, count(*) FILTER (o_totalprice > 100000) AS large FROM orders")
def conditional(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("rows_all"), F.countDistinct("o_custkey").alias("customers"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"), F.count_if(F.col("o_totalprice") > 100000).alias("large")
    )


@query("a2_ordered_group_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query("a4_dashboard", "SELECT n.n_name, coalesce(sum(o.c), 0)::BIGINT AS orders, coalesce(sum(o.f), 0)::BIGINT AS done FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS c, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey GROUP BY 1")
def dashboard(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    by = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.sum("c").alias("c"), F.sum("f").alias("f"))
    met = table(spark, sf_dir, "nation").join(by, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.groupBy("n_name").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("orders"), F.coalesce(F.sum("f"), F.lit(0)).alias("done"))


@query("a14_grouped_lists", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY 1")
def grouped_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.count(F.lit(1)).alias("n"))


@query("a16_upper_median", "SELECT event_type, list_extract(list_sort(list(value)), (count(value) // 2 + 1)::INT) AS median, count(value) AS n FROM events GROUP BY 1")
def median(spark, sf_dir):
    return op.upper_median(table(spark, sf_dir, "events"), "event_type", "value")


@query("a16_outliers", """WITH m AS (SELECT event_type, list_extract(list_sort(list(value)), (count(value) // 2 + 1)::INT) AS median FROM events GROUP BY 1)
 SELECT e.event_type, min(e.value) AS low, max(e.value) AS high, count(*) FILTER (e.value > 2 * m.median) AS outliers FROM events e JOIN m USING (event_type) GROUP BY 1""")
def outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    met = events.join(op.upper_median(events, "event_type", "value"), "event_type")
    return met.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") > 2 * F.col("median")).alias("outliers"))


@query("a17_batches", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey // 5) AS batches FROM orders GROUP BY 1, 2")
def batches(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.floor(F.col("o_orderkey") / 5)).alias("batches"))


@query("a18_progress", "SELECT floor(avg(p))::BIGINT AS percent FROM (SELECT floor(100 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS p FROM orders GROUP BY o_custkey)")
def progress(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.floor(100 * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("p"))
    return by.agg(F.floor(F.avg("p")).alias("percent"))


@query("a21_precision_recall", """WITH e AS (SELECT doc_id FROM labels WHERE quality = 0), g AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '(!!|\\*\\*\\*|\\|)'))
 SELECT (SELECT count(*) FROM g JOIN e USING (doc_id)) AS hits, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM g JOIN labels USING (doc_id)) AS given""")
def precision_recall(spark, sf_dir):
    """Facts found against facts expected: one pass over the labelled rows."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(!!|\*\*\*|\|)")).select("doc_id", F.lit(1).alias("found"))
    met = table(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    return met.agg(F.count_if((F.col("found") == 1) & (F.col("quality") == 0)).alias("hits"), F.count_if(F.col("quality") == 0).alias("expected"), F.count_if(F.col("found") == 1).alias("given"))


@query("t1_ranked_listing", f"WITH {SYMBOLS_SQL} SELECT id, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(op.KIND_ORDER)) + " ELSE 99 END, name, id) AS place FROM symbols ORDER BY place LIMIT 100")
def ranked(spark, sf_dir):
    """The first hundred of the ranked listing, with their places."""
    top = op.ranked(symbols(spark, sf_dir), "name", "id").limit(100)
    kind = F.array_position(F.array(*map(F.lit, op.KIND_ORDER)), F.col("type"))
    order = W.orderBy(F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2), F.when(kind == 0, 99).otherwise(kind), "name", "id")
    return top.select("id", F.row_number().over(order).cast("long").alias("place"))


@query("t2_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paging(spark, sf_dir):
    return op.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, 25, F.desc("o_totalprice"), "o_orderkey")


@query("t3_search", f"WITH {SYMBOLS_SQL} SELECT id, name FROM symbols WHERE lower(name) LIKE '%bolt%' OR lower(qualified_name) LIKE '%bolt%' OR lower(path) LIKE '%bolt%' ORDER BY lower(name) = 'bolt' DESC, name, id LIMIT 40")
def search(spark, sf_dir):
    return op.search(symbols(spark, sf_dir), "bolt", 40).select("id", "name")


@query("t5_top_dependents", "SELECT l_suppkey, count(DISTINCT l_partkey) AS dependents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_dependents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("dependents")).orderBy(F.desc("dependents"), "l_suppkey").limit(8)


@query("t6_dedupe_first", "SELECT lower(p_type || '|' || p_name) AS signature, min(p_partkey) AS id FROM part GROUP BY 1")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower(F.concat_ws("|", "p_type", "p_name")).alias("signature"), F.col("p_partkey").alias("id"))
    return rows.groupBy("signature").agg(F.min("id").alias("id"))


@query("t7_t8_scored_documents", """SELECT doc_id, (CASE WHEN lang = 'en' THEN 30 ELSE 0 END + CASE WHEN text LIKE '%ing%' THEN 45 ELSE 0 END + CASE WHEN source = 'src1' THEN 20 ELSE 0 END - CASE WHEN text LIKE '%!!%' THEN 40 ELSE 0 END)::BIGINT AS score
 FROM documents ORDER BY score DESC, doc_id LIMIT 80""")
def scored(spark, sf_dir):
    score = F.when(F.col("lang") == "en", 30).otherwise(0) + F.when(F.col("text").contains("ing"), 45).otherwise(0) + F.when(F.col("source") == "src1", 20).otherwise(0) - F.when(F.col("text").contains("!!"), 40).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(80)


@query("t11_caps_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3")
def caps(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("n", n).filter("n <= 3").select("o_custkey", "o_orderkey")


@query("t13_latest_row", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("u2_u3_set_operations", "SELECT 'difference' AS op, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def sets(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    counted = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, x in (("difference", a.subtract(b)), ("intersection", a.intersect(b)), ("union", a.union(b).distinct()))]
    return counted[0].union(counted[1]).union(counted[2])


@query("u5_u6_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("w10_superseded_jobs", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('click', 'view')) WHERE n > 1")
def superseded(spark, sf_dir):
    active = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).select("user_id", "event_id")
    return op.superseded(active, "user_id", "event_id").select("event_id")


@query("w4_backoff", "SELECT event_id, CAST(least(900, 30 * pow(2, user_id % 8)) AS BIGINT) AS wait_seconds, ts + to_seconds(CAST(least(900, 30 * pow(2, user_id % 8)) AS BIGINT)) AS available_at FROM events WHERE event_type = 'error'")
def backoff(spark, sf_dir):
    wait = F.least(F.lit(900), 30 * F.pow(F.lit(2), F.col("user_id") % 8)).cast("long")
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("wait_seconds", wait)
    return rows.select("event_id", "wait_seconds", F.expr("ts + make_dt_interval(0, 0, 0, wait_seconds)").alias("available_at"))


@query("w5_w11_expired_leases", """SELECT event_id, CASE WHEN ts + INTERVAL 15 MINUTE < TIMESTAMP '2024-01-20' THEN (CASE WHEN user_id % 4 >= 3 THEN 'failed' ELSE 'queued' END) ELSE 'running' END AS state, least(user_id % 4, 3)::BIGINT AS attempts FROM events WHERE event_type = 'view'""")
def leases(spark, sf_dir):
    expired = F.col("ts") + F.expr("INTERVAL 15 MINUTES") < F.lit("2024-01-20").cast("timestamp")
    state = F.when(expired, F.when(F.col("user_id") % 4 >= 3, "failed").otherwise("queued")).otherwise("running")
    return table(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", state.alias("state"), F.least(F.col("user_id") % 4, F.lit(3)).cast("long").alias("attempts"))


@query("s19_json_fields", "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("s16_upsert", "SELECT user_id, arg_max(value, event_id) AS value, count(*) AS versions FROM events GROUP BY 1")
def upsert(spark, sf_dir):
    """Rows applied in order to a keyed table, the last one kept."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("versions"))


@query("e17_change_risk", """WITH c AS (SELECT o_custkey, count(*) AS paths, count(*) FILTER (o_orderpriority = '1-URGENT') AS routes, count(*) FILTER (o_totalprice > 480000) AS tables FROM orders GROUP BY 1)
 SELECT o_custkey, CASE WHEN tables > 0 OR routes >= 5 THEN 'high' WHEN paths >= 5 OR routes > 0 THEN 'medium' ELSE 'low' END AS level,
 concat_ws(',', CASE WHEN tables > 0 THEN tables || (CASE WHEN tables = 1 THEN ' table' ELSE ' tables' END) END, CASE WHEN routes > 0 THEN routes || (CASE WHEN routes = 1 THEN ' route' ELSE ' routes' END) END) AS reasons FROM c""")
def change_risk(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("routes"), F.count_if(F.col("o_totalprice") > 480000).alias("tables"))
    no, zero = F.lit(False), F.lit(0)
    level = op.classify_change(F.col("paths"), zero, F.col("routes"), F.col("tables"), zero, no, no)
    return c.select("o_custkey", level.alias("level"), F.array_join(op.change_reasons(zero, F.col("tables"), zero, F.col("routes"), no), ",").alias("reasons"))


@query("e21_e22_snapshot_delta", """WITH b AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), a AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS s FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
 SELECT l_suppkey, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x)))::BIGINT AS added, len(list_filter(b.s, lambda x: NOT list_contains(a.s, x)))::BIGINT AS removed FROM a JOIN b USING (l_suppkey)""")
def snapshot_delta(spark, sf_dir):
    """Members that came to and went from each key's set, by flags on (key, member): no set is ever whole in one row."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_linenumber") <= 4).alias("b"), F.bool_or(F.col("l_linenumber") >= 2).alias("a"))
    return lines.groupBy("l_suppkey").agg(F.count_if(F.col("a") & ~F.col("b")).alias("added"), F.count_if(F.col("b") & ~F.col("a")).alias("removed"), F.bool_or("a").alias("x"), F.bool_or("b").alias("y")).filter("x and y").select("l_suppkey", "added", "removed")


@query("e23_evidence_packet", f"WITH {SYMBOLS_SQL} SELECT min(id) AS id, sha256(lower(path || '|' || size || '|' || type || '|' || name)) AS ref, count(*) AS refs FROM symbols GROUP BY 2")
def packet(spark, sf_dir):
    key = F.sha2(F.lower(F.concat_ws("|", "path", "size", "type", "name")), 256)
    return symbols(spark, sf_dir).groupBy(key.alias("ref")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("refs"))
