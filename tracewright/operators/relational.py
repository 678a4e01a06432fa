"""Ranked search, paging, latest rows, preferences and caps: the shapes in which the evidence tables are asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.functions import labels
from tracewright.operators.graph import kept

#: Symbol kinds in the order in which listings show them.
KIND_ORDER = ("route", "controller", "class", "component", "function", "method", "table", "model", "external_service", "module")


def exact_or_all(rows: DataFrame, exact: Column) -> DataFrame:
    """The rows that match exactly if there are any, else all."""
    marked = rows.withColumn("exact_", exact)
    some = marked.agg(F.coalesce(F.bool_or("exact_"), F.lit(False)).alias("any_"))
    return marked.crossJoin(F.broadcast(some)).filter("exact_ or not any_").drop("exact_", "any_")


def ranked(rows: DataFrame, *tail: Column | str) -> DataFrame:
    """Strongest confidence first, then kind, then the given columns (end with a unique one)."""
    kind = labels.rank_in(KIND_ORDER, F.col("type"))
    return rows.orderBy(labels.rank_in(labels.CONFIDENCES, F.col("confidence")).desc(), F.when(kind == 0, len(KIND_ORDER) + 1).otherwise(kind), *tail)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page of a totally ordered listing; numbers beyond the last page give the last one."""
    size = max(1, min(size, 200))
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((max(1, min(number, pages)) - 1) * size).limit(size)


def search(rows: DataFrame, needle: str, most: int = 100) -> DataFrame:
    """Rows whose name, qualified name or path holds the text in any case, equal names first, at most ``most`` (1 to 100)."""
    like = "%" + needle.lower() + "%"
    found = rows.filter(F.col("name").ilike(like) | F.col("qualified_name").ilike(like) | F.col("path").ilike(like))
    return found.orderBy((F.lower("name") == needle.lower()).desc(), "name", "id").limit(max(1, min(most, 100)))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by a unique order column; a group's rows combine before they meet."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def superseded(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All but the last row of each key."""
    last = rows.groupBy(key).agg(F.max(order).alias("last_"))
    return rows.join(last, key).filter(F.col(order) < F.col("last_")).drop("last_")


def first_per(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("n_", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("n_ = 1").drop("n_")


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of each key the value at index floor(n / 2) of the ascending order, from exact value counts.

    Equal values meet first. Counts are dealt by ranges of (key, value), so that a key with many values spans many tasks;
    running sums over the ranges name the one that holds the median, and only its values are looked through.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).count()
    counts = kept(counts.repartitionByRange(key, value).withColumn("range_", F.spark_partition_id()))
    ahead = W.partitionBy(key).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy(key, "range_").agg(F.sum("count").alias("held_"))
    sums = sums.withColumn("before_", F.coalesce(F.sum("held_").over(ahead), F.lit(0))).withColumn("n", F.sum("held_").over(W.partitionBy(key)))
    holding = sums.filter("before_ <= floor(n / 2) and before_ + held_ > floor(n / 2)").select(F.col(key).alias("key_"), F.col("range_").alias("at_"), "before_", "n")
    met = counts.join(holding, F.col(key).eqNullSafe(F.col("key_")) & (F.col("range_") == F.col("at_")))
    run = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    upto = met.withColumn("upto_", F.col("before_") + F.sum("count").over(run))
    return upto.filter("upto_ > floor(n / 2)").groupBy(key).agg(F.min(value).alias("median"), F.max("n").alias("n"))


def first_of_each(rows: DataFrame, key: str, most: Column | int, *order: str, deal: str) -> DataFrame:
    """The first rows of each key by an order that ends with a unique column, with their number in place_. Rows are first
    numbered within 64 parts of their key (by the column ``deal``), so that no window holds more than ``most`` from each."""
    part = F.pmod(F.xxhash64(deal), F.lit(64))
    some = rows.withColumn("place_", F.row_number().over(W.partitionBy(key, part).orderBy(*order))).filter(F.col("place_") <= most)
    return some.withColumn("place_", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("place_") <= most)


def contained(points: DataFrame, ranges: DataFrame, bucket: int = 64) -> DataFrame:
    """Points (key, at) with the narrowest range (key, id, low, high) that holds them; ties by id; null id where none does.

    Ranges are dealt to buckets of their length, so that points meet only ranges near them.
    """
    spread = ranges.withColumn("b", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    asked = points.select("key", "at").distinct().withColumn("b", F.floor(F.col("at") / bucket))
    held = asked.join(spread, ["key", "b"]).filter(F.col("at").between(F.col("low"), F.col("high")))
    best = held.groupBy("key", "at").agg(F.min_by("id", F.struct((F.col("high") - F.col("low")).alias("w"), "id")).alias("id"))
    return points.join(best, ["key", "at"], "left")


def next_within(marks: DataFrame, items: DataFrame, reach: int = 4) -> DataFrame:
    """Marks (key, at) with the first item (key, place) one to ``reach`` places after them."""
    asked = marks.select("key", "at", F.explode(F.sequence(F.col("at") + 1, F.col("at") + reach)).alias("place"))
    return asked.join(items.select("key", "place").distinct(), ["key", "place"]).groupBy("key", "at").agg(F.min("place").alias("place"))


def either_key(left: DataFrame, right: DataFrame, cells: int = 8, parts: int = 256) -> DataFrame:
    """Distinct pairs (left, right) of rows whose keys are equal, or whose groups are and the left one is ``grouped``: left
    rows (left, group, grouped), right rows (right, group). An OR of two equalities as a union of two equi-joins.

    Pairs of one group may be many more than rows, so they are neither shuffled nor compared: keys are made distinct before
    they meet, pairs of equal keys leave the second join, and only keys that both lie in several groups can meet twice.
    Each group is a square of ``cells`` by ``cells`` joins, dealt to ``parts`` tasks.
    """
    equal = left.select("left").distinct().join(right.select("right").distinct(), F.col("left") == F.col("right"))

    def members(rows: DataFrame, key: str) -> DataFrame:
        groups = rows.filter("group is not null").select(key, "group").distinct()
        return kept(groups.withColumn("several", F.count(F.lit(1)).over(W.partitionBy(key)) > 1))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        cell = F.pmod(F.xxhash64(key), F.lit(cells)).alias(own)
        return rows.select(key, "group", cell, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias(other)).repartition(parts, "group", "row_", "column_")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = dealt(a, "left", "row_", "column_").join(dealt(b, "right", "column_", "row_").hint("shuffle_hash"), ["group", "row_", "column_"])
        return pairs.filter(~F.coalesce(F.col("left") == F.col("right"), F.lit(False))).select("left", "right")

    one, two = members(left.filter("grouped"), "left"), members(right, "right")
    again = met(one.filter("several"), two.filter("several")).distinct()
    return equal.union(met(one.filter("not several"), two)).union(met(one.filter("several"), two.filter("not several"))).union(again)


def delta(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that came, went or changed their value between two versions."""
    a = before.select(*key, F.col(value).alias("before"), F.lit(1).alias("in_before"))
    b = after.select(*key, F.col(value).alias("after"), F.lit(1).alias("in_after"))
    met = a.join(b, key, "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return met.withColumn("change", change).filter("change is not null").select(*key, "before", "after", "change")


def classify_change(paths: Column, sensitive: Column, routes: Column, tables: Column, services: Column, high: Column, medium: Column) -> Column:
    """Risk of a change from its counts: paths, sensitive ones, routes, tables, services; and blast risks seen."""
    strong = (sensitive > 0) | (tables > 0) | (services > 0) | high | (routes >= 5)
    some = (paths >= 5) | (routes > 0) | medium
    return F.when(strong, "high").when(some, "medium").when(paths == 0, "unknown").otherwise("low")


def change_reasons(sensitive: Column, tables: Column, services: Column, routes: Column, high: Column) -> Column:
    def told(n: Column, one: str, many: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many)))

    return F.array_compact(F.array(told(sensitive, " sensitive path", " sensitive paths"), told(tables, " table", " tables"), told(services, " service", " services"), told(routes, " route", " routes"), F.when(high, "high blast radius")))
