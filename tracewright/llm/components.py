"""Connected components of a link table by alternating star contractions.

Each round points every node at the smallest node it knows, first over its larger neighbours, then over its smaller
ones; trees so flatten until each node points at its component's smallest. A component that has come to a star leaves the
rounds. Rounds are written to the shared folder, so a lost executor costs one round at most. Nothing but one row a round
reaches the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import written


def _pointed(links: DataFrame) -> DataFrame:
    """(u, v, m): links both ways with m, the smallest of u and all its neighbours."""
    low = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(low, "u")


def connected(links: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link touches; a component is named by its smallest node.

    Links with a null end or from a node to itself do not count. Rounds go on until all components are stars.
    """
    edges = written(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), f"{folder}/0")
    settled = []
    for turn in count(1):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u holds its smaller neighbours only
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select(F.col("e.u").alias("v"), F.col("e.v").alias("u")).filter("u != v").distinct(), f"{folder}/{turn}")
        # a star is settled if none of its nodes is in another one
        ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("u", F.lit(0), F.lit(1)))
        shared = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").select("node")
        shared = written(shared, f"{folder}/{turn}-shared")
        if shared.isEmpty():
            settled.append(edges)
            break
        moving = edges.join(shared.withColumnRenamed("node", "v"), "v", "left_semi").select("u").union(shared).distinct()
        edges = written(edges.join(moving.withColumn("moving", F.lit(True)), "u", "left").select("v", "u", F.col("moving").isNotNull().alias("moving")), f"{folder}/{turn}-flagged")
        settled.append(edges.filter("not moving").select("v", "u"))
        edges = edges.filter("moving").select("v", "u")
    edges = reduce(DataFrame.union, settled)
    tops = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(tops)
