"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's words are cut into blocks of equal size along a shuffled order of its documents. A schedule of slots gives
slot i the point frac(i * golden ratio); cumulative target shares map the point to a source, and the slot's rank within
its source names the block it takes, pass after pass over the source (at most two). The stream of blocks so follows the
targets at every length, and each source ends at its target rounded to a word: the schedule runs on until every source
is served, and a source's last block is cut where its target ends.

Sources weigh 5, 2, 1, 5, ... in code-point order of their names, null last. Targets share 150 % of all words by weight;
a target over twice its source's words stops there and the excess goes to the others by weight.

Null texts have size 0; texts of any length are counted whole. Rows of one doc_id, null ids included, are told apart by text;
equal rows share evenly what is taken of them. Ties in the shuffled order go by id and text. Documents of size 0 take
nothing. An empty table gives an empty mix. Extra columns, whatever their names, do not matter and stay in ``mixed``. Only
DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tracewright.llm.common import column, shared_folder, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Words of a block.
BLOCK = 512
GOLDEN = 0.6180339887498949
#: Documents of a run of a source's shuffled order, about, and slots ranked together, at least.
RUN, STRETCH = 1 << 16, 4096
#: Cells of [0, 1) over which points meet the cumulative shares.
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a number that tells repeated ids apart."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("mark"))


def targets(sizes: DataFrame) -> DataFrame:
    """Of each source: words, weight, target. One row a source, so the sorts below are over sources only.

    Water filling: in ascending order of cap / weight, a source is capped when its cap is at most its weight's share of
    what the capped ones before it leave over.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*map(F.lit, map(float, WEIGHTS)))
    by = by.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    every = W.partitionBy()
    ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    by = by.withColumn("cap", F.col("source_size") * float(MOST_PASSES)).withColumn("all", F.sum("source_size").over(every) * SHARE)
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", level)
    by = by.withColumn("water", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(every))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return by.select("source", "source_size", "weight", target.alias("target"), F.least(F.round(target).cast("long"), F.col("source_size") * MOST_PASSES).alias("goal"))


def run_bits(sizes: DataFrame) -> int:
    """Bits of a key that name its run, so that a run of the largest source has about RUN documents; 256 runs at least."""
    return max(8, min(40, (sizes.count() // RUN).bit_length()))


def shuffled(sizes: DataFrame, turn: int = 0, bits: int = 8) -> DataFrame:
    """Places of documents along a shuffled order of their source: from, to (words). Sums run within runs of the order
    and over the runs' totals, so no window holds a whole source."""
    key = F.xxhash64(F.lit(turn), "doc_id", "mark", "size")
    dealt = sizes.filter("size > 0").withColumn("key", key).withColumn("run", F.shiftright(F.col("key"), 64 - bits))
    within = W.partitionBy("source", "run").orderBy("key", "doc_id", "mark").rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy("source", "run").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source", "run", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    placed = dealt.withColumn("upto", F.sum("size").over(within)).alias("a").join(totals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.run") == F.col("b.run")))
    return placed.select("a.doc_id", "a.mark", "a.source", "a.size", (F.col("b.ahead") + F.col("a.upto") - F.col("a.size")).alias("from"), (F.col("b.ahead") + F.col("a.upto")).alias("to"))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots in stream order: slot, source, rank (from 0, by source), for sources with a goal.

    The points give each source its share of slots to within a few; those few come from a tail of slots dealt by rank.
    """
    spark = goals.sparkSession
    every = W.partitionBy()
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    need = goals.filter("goal > 0").withColumn("blocks", F.ceil(F.col("goal") / block))
    need = need.withColumn("all", F.sum("blocks").over(every)).withColumn("high", F.sum("blocks").over(order) / F.col("all"))
    need = need.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    cells = need.select("source", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = int(need.agg(F.max("all")).first()[0] or 0)
    # as many slots in a stretch as there are stretches
    stretch = max(STRETCH, int(slots**0.5))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(1.0)).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    named = points.join(cells, "cell").filter("point >= low and point < high").select("slot", "source", "blocks").withColumn("stretch", F.floor(F.col("slot") / stretch))
    counts = named.groupBy("source", "stretch").count()
    ahead = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    local = F.row_number().over(W.partitionBy("source", "stretch").orderBy("slot")) - 1
    ranked = named.withColumn("local", local).alias("a").join(counts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.stretch") == F.col("b.stretch")))
    ranked = ranked.select("a.slot", "a.source", (F.col("a.local") + F.col("b.ahead")).alias("rank"), "a.blocks").filter("rank < blocks")
    got = counts.groupBy("source").agg(F.sum("count").alias("got"))
    short = need.alias("n").join(got.alias("g"), F.col("n.source").eqNullSafe(F.col("g.source")), "left").select("n.source", "n.blocks", F.coalesce("g.got", F.lit(0)).alias("got")).filter("got < blocks")
    tail = short.select((F.lit(slots) + F.col("got")).alias("slot"), "source", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("rank"), "blocks")
    return ranked.select("slot", "source", "rank").unionByName(tail.select("slot", "source", "rank"))


def measured(docs: DataFrame) -> DataFrame:
    """The sizes as a written table, so that the texts are read and counted once."""
    return written(sized(docs), shared_folder(docs.sparkSession, "mix-sizes"))


def mix(sizes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix, one row for each slot's piece of a document (slot, source, rank, doc_id, mark, words), and the targets.

    Block ``rank`` of a source covers words [rank * block, (rank + 1) * block) of its passes laid end to end, cut at the
    goal; each pass has a shuffled order of its own. Pieces of documents meet their slot by (source, rank).
    """
    goals = targets(sizes)
    slots = schedule(goals, block)
    bits, laid = run_bits(sizes), None
    for turn in range(MOST_PASSES):
        one = shuffled(sizes, turn, bits).alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        shift = F.col("g.source_size") * turn
        one = one.select("d.doc_id", "d.mark", "d.source", (F.col("d.from") + shift).alias("from"), F.least(F.col("d.to") + shift, F.col("g.goal")).alias("to")).filter("from < to")
        laid = one if laid is None else laid.unionByName(one)
    pieces = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    words = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    pieces = pieces.select("doc_id", "mark", "source", "rank", words.alias("words"))
    met = slots.alias("s").join(pieces.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.rank") == F.col("p.rank")))
    return met.select("s.slot", "s.source", "s.rank", "p.doc_id", "p.mark", "p.words"), goals


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row's size, its source's words and target, and the words that the mix takes of it.

    Equal rows (same id, text, source) share evenly what is taken of them, the remainder going to the first.
    """
    sizes = measured(docs)
    stream, goals = mix(sizes, block)
    sums = stream.groupBy("source", "doc_id", "mark").agg(F.sum("words").alias("words"))
    sizes = sizes.withColumn("copy", F.row_number().over(W.partitionBy("source", "doc_id", "mark").orderBy(F.lit(1)))).withColumn("copies", F.count(F.lit(1)).over(W.partitionBy("source", "doc_id", "mark")))
    joined = sizes.alias("d").join(sums.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.mark").eqNullSafe(F.col("t.mark")), "left")
    joined = joined.join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    words = F.coalesce(F.col("t.words"), F.lit(0))
    share = F.floor(words / F.col("d.copies")) + F.when(F.col("d.copy") <= words % F.col("d.copies"), 1).otherwise(0)
    return joined.select("d.doc_id", F.col("d.size").alias("size"), F.col("g.source_size").alias("source_size"), F.col("g.target").alias("target"), share.cast("long").alias("taken"), F.col("d.source").alias("source"), F.col("d.mark").alias("mark"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mix, in their columns: each row as often as its words are taken, to the nearest whole
    number (parts arise only where a source's target ends)."""
    by = taken(docs, block).groupBy("doc_id", "source", "mark").agg(F.sum("taken").alias("words"), F.sum("size").alias("of")).filter("of > 0")
    own = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("own"), "doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("mark")).alias("d")
    met = own.join(by.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.mark") == F.col("t.mark")))
    copies = F.floor(F.col("t.words") / F.col("t.of") + 0.5).cast("int")
    met = met.select("d.own", F.explode(F.array_repeat(F.lit(1), copies)))
    return met.select(*(column(c, "own").alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
