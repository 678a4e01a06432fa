"""Operators on edge tables: traversals, closures, shortest paths, degrees, roll-ups.

Edges are (source, target, ...); ends may be null and then lead nowhere. Traversals run level by level: each level is one
join of the frontier with the edges and one anti join with what has been seen, written to the shared folder so that a
lost executor costs one level. Only counts reach the driver.
"""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions import labels


#: Rows that joins of a traversal may send to every task.
FEW = 20_000


def kept(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut: checkpointed in spark.checkpoint.dir (a temporary folder only in local sessions)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = f"{tempfile.gettempdir()}/tracewright-{uuid.uuid4().hex[:8]}"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def confident(edges: DataFrame) -> DataFrame:
    """Edges that traversals may use: those of high or medium confidence."""
    return edges.filter(F.col("confidence").isin("high", "medium"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, backwards: bool = False, both: bool = False) -> DataFrame:
    """(seed, node, depth) for nodes within ``depth`` hops of each seed (the seed itself at 0), by least depth; with None
    for all nodes that can be reached.

    Sizes of checkpointed rows are guessed from files that are packed, so joins are told what to do: only a front, or what was seen, of
    FEW rows at most is broadcast, never the edges.
    """
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("next"))
    turned = edges.select(F.col("target").alias("at"), F.col("source").alias("next"))
    step = step.union(turned) if both else turned if backwards else step
    step = kept(step.filter("at is not null and next is not null").distinct())
    seen = kept(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    front, held = seen, (new := seen.count())
    for d in count(1) if depth is None else range(1, depth + 1):
        front = _sized(front, new).join(step, front["node"] == step["at"]).select("seed", F.col("next").alias("node")).distinct()
        front = kept(front.join(_sized(seen, held), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        new = front.count()
        if not new:
            break
        seen, held = seen.union(front), held + new
    return seen


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """Rows with what a join of them shall do, by their number."""
    return rows.hint("broadcast" if n <= FEW else "merge")


def blast(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """Of each seed: dependents within ``depth`` reverse hops, tables and services one hop ahead of any of them, score and risk.

    Every dependent counts (no cap), at its least depth.
    """
    used = confident(edges)
    return scored(reach(used, seeds, depth, backwards=True), used, nodes)


def scored(reached: DataFrame, used: DataFrame, nodes: DataFrame) -> DataFrame:
    """The counts, score and risk of each seed from what it reaches (seed, node, depth) over the used edges."""
    affected = kept(reached)
    ahead = affected.join(used, F.col("node") == F.col("source")).select("seed", F.col("target").alias("id")).distinct()
    typed = ahead.join(nodes.select("id", "type"), "id")
    outer = typed.groupBy("seed").agg(F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type").isin("external_service", "environment_variable")).alias("services"))
    inner = affected.groupBy("seed").agg(F.count_if(F.col("depth") > 0).alias("dependents"), F.count_if(F.col("depth") == 1).alias("direct"), F.max("depth").cast("int").alias("depth"))
    found = inner.join(outer, "seed", "left").fillna(0, ["tables", "services"])
    score = F.col("dependents") + 3 * F.col("tables") + 2 * F.col("services")
    return found.withColumn("score", score).withColumn("risk", F.when(score >= 15, "high").when(score >= 5, "medium").otherwise("low"))


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Hops of a forward trace: every edge out of a node reached at less than ``depth``, with that depth."""
    used = confident(edges)
    reached = reach(used, seeds, depth - 1)
    return reached.join(used, F.col("node") == F.col("source")).select("seed", "edge_id", "source", "target", "type", (F.col("depth") + 1).alias("hop"))


def transitive(edges: DataFrame, root: int, most: int = 8) -> DataFrame:
    """Nodes that depend on the root over two to ``most`` steps without repeats, with the least such depth; the root itself
    may appear through a cycle.

    A way to a node without repeats starts at another direct dependent, so the nearest of those decides. Every node keeps
    its two nearest direct dependents: one of them is not the node itself. At most two rows a node, however many ways.
    """
    whole = edges.filter("source is not null and target is not null")
    step = kept(whole.select(F.col("target").alias("at"), F.col("source").alias("next")).distinct())
    front = kept(step.filter(F.col("at") == root).select(F.col("next").alias("node"), F.col("next").alias("origin"), F.lit(1).alias("depth")))
    seen = front
    for depth in range(2, most + 1):
        met = front.join(step, front["node"] == step["at"]).select(F.col("next").alias("node"), "origin").join(seen, ["node", "origin"], "left_anti")
        met = met.groupBy("node").agg(F.min("origin").alias("one"), F.max("origin").alias("two"))
        met = met.join(seen.groupBy("node").agg(F.count(F.lit(1)).alias("held")), "node", "left").filter("held is null or held < 2")
        origins = F.when(F.col("held").isNull(), F.array_distinct(F.array("one", "two"))).otherwise(F.array("one"))
        front = kept(met.select("node", F.explode(origins).alias("origin"), F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.filter("depth >= 2").groupBy("node").agg(F.min("depth").alias("depth"))


def descendants(parents: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node): closure of parent links (id, parent) under the seeds, themselves included, to any depth unless given."""
    return reach(parents.select(F.col("parent").alias("source"), F.col("id").alias("target")), roots, depth).select("seed", "node")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); an edge from a node to itself counts once in degree."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("source") == F.col("target")).alias("self"))
    ends = ends.union(edges.select(F.col("target"), F.lit(0), F.lit(1), F.lit(False))).filter("id is not null")
    found = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.coalesce("self", F.lit(False)).cast("int")).alias("selfs"))
    return found.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree") - F.col("selfs")).alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def roll_up_nodes(nodes: DataFrame, level: Column) -> DataFrame:
    """Groups of nodes: size, strongest confidence and risk, and the most frequent meaning (ties by fixed priority)."""
    priority = F.create_map(*[F.lit(x) for pair in labels.SEMANTIC_PRIORITY.items() for x in pair])
    rows = nodes.withColumn("grp", level)
    most = rows.groupBy("grp", "semantic").count().groupBy("grp").agg(F.max_by("semantic", F.struct("count", priority[F.col("semantic")])).alias("semantic"))
    risks, confidences = ("low", "medium", "high"), labels.CONFIDENCES
    sums = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max(labels.rank_in(confidences, F.col("confidence"))).alias("c"), F.max(labels.rank_in(risks, F.col("risk"))).alias("r"))
    return sums.join(most, "grp").select("grp", "size", labels.name_at(confidences, F.col("c")).alias("confidence"), labels.name_at(risks, F.col("r")).alias("risk"), "semantic")


def roll_up_edges(edges: DataFrame, nodes: DataFrame, level: Column) -> DataFrame:
    """Edges between groups by type, with count and strongest confidence; none within a group."""
    groups = nodes.select("id", level.alias("grp"))
    one = groups.select(F.col("id").alias("source"), F.col("grp").alias("source_group"))
    two = groups.select(F.col("id").alias("target"), F.col("grp").alias("target_group"))
    met = edges.join(one, "source").join(two, "target").filter("source_group != target_group")
    found = met.groupBy("source_group", "target_group", "type").agg(F.count(F.lit(1)).alias("n"), F.max(labels.rank_in(labels.CONFIDENCES, F.col("confidence"))).alias("c"))
    return found.select("source_group", "target_group", "type", "n", labels.name_at(labels.CONFIDENCES, F.col("c")).alias("confidence"))


def distances(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """(node, distance) over undirected edges weighing 1, 2 or 5 by confidence, from one node; rounds go on until no
    distance falls. With ``most``, farther nodes are left out."""
    weight = F.when(F.col("confidence") == "high", 1).when(F.col("confidence") == "medium", 2).otherwise(5).cast("long")
    one = edges.filter("source is not null and target is not null").select(F.col("source").alias("at"), F.col("target").alias("next"), weight.alias("w"))
    step = kept(one.union(one.select("next", "at", "w")).groupBy("at", "next").agg(F.min("w").alias("w")))
    best = kept(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).cast("long").alias("distance")))
    front = best
    while not front.isEmpty():
        tried = front.join(step, front["node"] == step["at"]).groupBy(F.col("next").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        tried = tried if most is None else tried.filter(F.col("new") <= most)
        front = kept(tried.join(best, "node", "left").filter("distance is null or new < distance").select("node", F.col("new").alias("distance")))
        best = kept(best.union(front).groupBy("node").agg(F.min("distance").alias("distance")))
    return best
