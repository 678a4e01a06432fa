"""Change impact: what a target stands for, and what a change of symbols touches.

Targets and changes are many at a time. One traversal keyed by seed serves all changes; what several seeds of a change
touch is merged by identity, so nothing depends on the order of seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions import paths
from tracewright.operators import graph, relational

# Reverse hops that a change is followed for, kinds of symbols that stand for what lies outside the code.
DEPTH = 6
OUTSIDE = ("external_service", "environment_variable")


def _plain(value: Column) -> Column:
    return F.lower(F.translate(F.trim(value), "\\", "/"))


def _wanted(rows: DataFrame, asked: list[tuple[int, str]], *names: str) -> DataFrame:
    """Rows gain target: the numbers of the asked words that one of the names holds, in any case; where a name of any row
    equals the word, only such rows. One pass whatever the number of words, of which there are a short list."""
    marks = []
    for number, word in asked:
        low = word.strip().replace("\\", "/").lower()
        holds, equals = (F.lit(False), F.lit(False))
        for name in names:
            plain = F.coalesce(_plain(F.col(name)), F.lit(""))
            holds, equals = holds | plain.contains(low), equals | (plain == low)
        marks.append(F.when(holds, F.struct(F.lit(number).alias("target"), equals.alias("exact_"))))
    met = rows.select("*", F.explode(F.array_compact(F.array(*marks))).alias("mark_")).select(*rows.columns, "mark_.*")
    # a row for each asked word at most
    sure = met.groupBy("target").agg(F.bool_or("exact_").alias("any_"))
    return met.join(F.broadcast(sure), "target").filter("exact_ or not any_").drop("exact_", "any_")


def targets(symbols: DataFrame, routes: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """(target, id): the symbols that each asked (kind, word) stands for, target being its number in the list.

    symbols: id, parent, name, qualified_name, type, path; routes: method, route_path, path, handler. A symbol stands for
    itself, the modules of its file and all below it in its file; a file for its symbols and the handlers of its routes; a
    route, with or without its method, for its handlers; a table for itself. Exact words win over parts of names.
    """
    kinds = {k: [(n, w) for n, (kind, w) in enumerate(asked) if kind == k] for k in ("symbol", "file", "route", "table")}
    if sum(map(len, kinds.values())) != len(asked):
        raise ValueError("a target is a symbol, a file, a route or a table")
    none = symbols.select(F.lit(0).alias("target"), "id").limit(0)
    found = [none]
    if kinds["symbol"]:
        own = graph.kept(_wanted(symbols, kinds["symbol"], "name", "qualified_name", "path").select("target", "id", "path"))
        above = symbols.select(F.col("id").alias("parent"), F.col("path").alias("parent_path"))
        links = symbols.join(above, "parent").filter(F.col("path") == F.col("parent_path")).select("id", "parent")
        below = graph.descendants(links, own.select(F.col("id").alias("seed")).distinct())
        modules = symbols.filter("type = 'module'").select("path", F.col("id").alias("module"))
        found.append(own.withColumnRenamed("id", "seed").join(below, "seed").select("target", F.col("node").alias("id")))
        found.append(own.select("target", "path").distinct().join(modules, "path").select("target", F.col("module").alias("id")))
    if kinds["file"]:
        files = _wanted(symbols.select("path").distinct(), kinds["file"], "path")
        found.append(files.join(symbols.select("path", "id"), "path").select("target", "id"))
        found.append(files.join(routes.select("path", F.col("handler").alias("id")), "path").select("target", "id"))
    if kinds["route"]:
        split = [(n, *_method(w)) for n, w in kinds["route"]]
        verbs = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(m).cast("string").alias("method")) for n, m, _ in split))
        # methods rule out before exact paths win
        able = routes.withColumn("open_", F.transform(F.filter(verbs, lambda v: v.method.isNull() | (v.method == F.upper("method"))), lambda v: v.n))
        for n, _, path in split:
            of_one = able.filter(F.array_contains("open_", n))
            found.append(_wanted(of_one.select("route_path", "handler"), [(n, path)], "route_path").select("target", F.col("handler").alias("id")))
    if kinds["table"]:
        found.append(_wanted(symbols.filter("type = 'table'"), kinds["table"], "name", "qualified_name", "path").select("target", "id"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.filter("id is not null").distinct()


def _method(word: str) -> tuple[str | None, str]:
    first, _, rest = word.strip().partition(" ")
    return (first.upper(), rest.strip()) if rest.strip() and first.isalpha() else (None, word.strip())


def touched(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(seed, node, depth): the dependents of all seeds (id) of all changes over confident edges."""
    return graph.kept(graph.reach(graph.confident(edges), seeds.select(F.col("id").alias("seed")).distinct(), depth, backwards=True))


def boundaries(reached: DataFrame, edges: DataFrame, symbols: DataFrame, routes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(change, kind, key): what each change touches, each thing once: files and routes of what it reaches, tables and
    services one confident hop ahead, services among the seeds, direct and transitive dependents.

    reached: from ``touched``; seeds: change, id. A dependent may be direct of one seed and transitive of another.
    """
    met = reached.join(seeds.select("change", F.col("id").alias("seed")).distinct(), "seed")
    met = met.groupBy("change", "node").agg(F.bool_or(F.col("depth") == 1).alias("direct"), F.bool_or(F.col("depth") >= 2).alias("transitive"))
    kinds = F.array_compact(F.array(F.when(F.col("direct"), F.lit("direct")), F.when(F.col("transitive"), F.lit("transitive"))))
    node = F.col("node").cast("string").alias("key")
    depend = met.select("change", F.explode(kinds).alias("kind"), node)
    files = met.join(symbols.select(F.col("id").alias("node"), "path"), "node").select("change", F.lit("file").alias("kind"), F.col("path").alias("key"))
    handled = routes.select(F.col("handler").alias("node"), F.trim(F.concat_ws(" ", "method", "route_path")).alias("key")).filter("key != ''")
    ways = met.join(handled, "node").select("change", F.lit("route").alias("kind"), "key")
    ahead = met.join(graph.confident(edges).select(F.col("source").alias("node"), F.col("target").alias("id")), "node").select("change", "id")
    outer = symbols.select("id", F.when(F.col("type") == "table", "table").when(F.col("type").isin(*OUTSIDE), "service").alias("kind")).filter("kind is not null")
    own = seeds.select("change", "id").join(symbols.filter("type = 'external_service'").select("id", F.lit("service").alias("kind")), "id")
    outside = ahead.distinct().join(outer, "id").unionByName(own).select("change", "kind", F.col("id").cast("string").alias("key"))
    return depend.union(files).union(ways).union(outside).filter("key is not null").distinct()


def change_risks(found: DataFrame, blasts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Of each change: counts of what it touches, level and reasons. found: from ``boundaries``; blasts: seed, risk."""
    count = lambda kind, also=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if also is None else also))
    sums = found.groupBy("change").agg(
        count("file").alias("files"), count("file", paths.is_sensitive(F.col("key"))).alias("sensitive"), count("route").alias("routes"), count("table").alias("tables"), count("service").alias("services"),
        count("direct").alias("direct"), count("transitive").alias("transitive"),
    )
    seen = seeds.select("change", F.col("id").alias("seed")).distinct().join(blasts.select("seed", "risk"), "seed")
    worst = seen.groupBy("change").agg(F.bool_or(F.col("risk") == "high").alias("high"), F.bool_or(F.col("risk") == "medium").alias("medium"))
    met = sums.join(worst, "change", "left").fillna(False, ["high", "medium"])
    level = relational.classify_change(*(F.col(c) for c in ("files", "sensitive", "routes", "tables", "services", "high", "medium")))
    reasons = relational.change_reasons(*(F.col(c) for c in ("sensitive", "tables", "services", "routes", "high")))
    return met.select("change", "files", "routes", "tables", "services", "direct", "transitive", level.alias("level"), F.array_join(reasons, ",").alias("reasons"))


def chains(reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """(change, seed, direct, transitive): of each seed with dependents the first direct one, and the first beyond it."""
    firsts = reached.groupBy("seed").agg(F.min(F.when(F.col("depth") == 1, F.col("node"))).alias("direct"), F.min(F.when(F.col("depth") >= 2, F.col("node"))).alias("transitive"))
    return seeds.select("change", F.col("id").alias("seed")).distinct().join(firsts.filter("direct is not null"), "seed").select("change", "seed", "direct", "transitive")
