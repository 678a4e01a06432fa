"""How far the sources of a language diverge in the terms that they use.

Terms are runs of letters: A-Z (as a-z), a-z and all beyond ASCII. A language keeps the terms that occur in at least
MIN_DOCS of its documents. A group (language, source) prices a kept term that it holds c times at
p = 1 + floor(SCALE * (c + SMOOTH) / (N + SMOOTH * V)), N being its occurrences of the V kept terms. Two sources
diverge by the sum of |p - q| over all kept terms; a source's own terms are those priced above its language's price.

Workers count terms document by document and hand over what they gathered whenever a fixed number of entries is reached.
Kept terms get numbers within blocks of their language, and a group's counts in a block become two arrays sorted by
number. For each unordered pair of sources and block one task co-groups the two groups' arrays: a galloping search finds
the numbers of the shorter array in the longer one, which prices terms of both, of one side only and, from the number
of terms met, those that both lack. Prices are whole numbers, so sums do not depend on order.

Null texts, languages and sources count as empty text. Texts of any length are counted whole, in pieces cut between terms.
Repeated rows and ids count as documents of their own. Ties rank by the item's UTF-8 bytes. An empty table gives no rows;
a source that is alone in its language has no pairs. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tracewright.llm import textvec as tv
from tracewright.llm.common import shared_folder, small_batches, table, tidy, written

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Entries that a worker holds before it hands them over, and bytes of a text counted at once.
ENTRIES, PIECE = 1 << 18, 4 << 20
#: Kept terms and (group, term) counts in a block, about, at most.
BLOCK_TERMS, BLOCK_ENTRIES = 1 << 16, 1 << 20

# What a byte becomes: letters stay, A-Z as a-z, all other ASCII is a gap.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def _pieces(data: bytes, start: int, end: int, size: int = PIECE) -> Iterator[bytes]:
    """data[start:end] in pieces of about ``size`` bytes, cut at gaps only."""
    while end - start > size:
        cut = data.rfind(b" ", start + 1, start + size)
        cut = cut if cut > 0 else data.find(b" ", start + size, end)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:end]


def term_counts(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in small_batches(batches):
            raw, at = tv.utf8(batch.column(2))
            data = _LETTERS[raw].tobytes()
            for lang, source, start, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for piece in _pieces(data, start, end):
                    terms = piece.split()
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(n) - before
                if size >= entries:
                    yield from handed()
                    held, size = {}, 0
        yield from handed()

    own = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    parts = docs.select(*own).mapInArrow(rows, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: str, size: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (size + SMOOTH * terms)), exact; null without terms."""
    whole = f"cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0)) div nullif(cast({size} + {SMOOTH} * {terms} as decimal(20, 0)), 0)"
    return F.expr(f"1 + {whole}").cast("long")


def prices(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    """The same for an array: three digits of the quotient at a time, so that nothing overflows."""
    whole = size + SMOOTH * terms
    rest = (counts if whole < 1 << 53 else counts.astype(object)) + SMOOTH
    out = np.zeros(len(counts), rest.dtype)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return (out + 1).astype(np.int64)


def gallop(keys: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """For each key the first place in the sorted pool that is not below it. Steps double from a guessed place until a key
    is passed; the bracket so found is halved. All keys step together."""
    n, m = len(pool), len(keys)
    if not n or not m:
        return np.zeros(m, np.int64)
    guess = np.arange(m, dtype=np.int64) * n // m
    up = pool[guess] < keys
    low, high = np.where(up, guess, -1), np.where(up, n, guess)
    todo, step = np.arange(m), 1
    while len(todo):
        at = guess[todo] + np.where(up[todo], step, -step)
        less = np.where(at < 0, True, np.where(at >= n, False, pool[np.clip(at, 0, n - 1)] < keys[todo]))
        at = np.clip(at, -1, n)
        low[todo[less]], high[todo[~less]] = at[less], at[~less]
        todo, step = todo[less == up[todo]], step * 2
    while len(todo := np.flatnonzero(high - low > 1)):
        middle = (low[todo] + high[todo]) // 2
        less = pool[middle] < keys[todo]
        low[todo[less]], high[todo[~less]] = middle[less], middle[~less]
    return high


def merged(a_ids: np.ndarray, a_counts: np.ndarray, a_size: int, b_ids: np.ndarray, b_counts: np.ndarray, b_size: int, terms: int) -> tuple[int, int]:
    """Sum of |p - q| over terms that either group holds, and the number of those terms."""
    if len(a_ids) > len(b_ids):
        return merged(b_ids, b_counts, b_size, a_ids, a_counts, a_size, terms)
    a, b = prices(a_counts, a_size, terms), prices(b_counts, b_size, terms)
    none = np.zeros(1, np.int64)
    a_none, b_none = prices(none, a_size, terms)[0], prices(none, b_size, terms)[0]
    place = gallop(a_ids, b_ids)
    met = np.zeros(len(a_ids), bool)
    inside = place < len(b_ids)
    met[inside] = b_ids[place[inside]] == a_ids[inside]
    alone = np.ones(len(b_ids), bool)
    alone[place[met]] = False
    value = np.abs(a[met] - b[place[met]]).sum() + np.abs(a[~met] - b_none).sum() + np.abs(b[alone] - a_none).sum()
    return int(value), len(a_ids) + int(alone.sum())


def kept_terms(docs: DataFrame, folder: str, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms (lang, source, term, n, total in the language, first: one row a term), and all groups (lang,
    source, size, lang_size, terms, blocks); both written."""
    counts = term_counts(docs)
    term = W.partitionBy("lang", "term")
    every = counts.withColumn("first", F.row_number().over(term.orderBy("source")) == 1).withColumn("total", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
    kept = written(every.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"), f"{folder}/kept")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("terms"), F.count(F.lit(1)).alias("entries"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / BLOCK_TERMS), F.ceil(F.col("entries") / BLOCK_ENTRIES))
    return kept, written(groups.select("lang", "source", "size", "lang_size", "terms", blocks.alias("blocks")), f"{folder}/groups")


def own_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Of each group the terms priced above its language's price: (lang, source, item, value, rank), ranks to ``top``."""
    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (price("n", "size", "terms") - price("total", "lang_size", "terms")).alias("value"))
    ranked = priced.filter("value > 0").withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.filter(F.col("rank") <= top)


def pair_divergences(kept: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language. The sorted arrays are written once."""
    numbered = kept.join(groups.select("lang", "source", "blocks"), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    numbered = numbered.withColumn("id", F.dense_rank().over(W.partitionBy("lang", "block").orderBy("term")))
    arrays = numbered.groupBy("lang", "block", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms_held"))
    arrays = written(arrays.select("lang", "block", "source", F.col("terms_held.id").alias("ids"), F.col("terms_held.n").alias("counts")), f"{folder}/arrays")
    a = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("a_size"), "terms")
    pairs = a.join(groups.select("lang", F.col("source").alias("b"), F.col("size").alias("b_size")), "lang").filter("a < b")
    key = ["lang", "a", "b", "block"]
    # the sides come from the same tables: new aliases tell their columns apart
    sides = [arrays.withColumnRenamed("source", side).join(pairs, ["lang", side]).select(*(F.col(c).alias(c) for c in (*key, "ids", "counts", "a_size", "b_size", "terms"))) for side in ("a", "b")]

    def priced(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = left if left.num_rows else right
        a_size, b_size, terms = (known.column(c)[0].as_py() for c in ("a_size", "b_size", "terms"))
        arrays = [t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64) for t in (left, right) for c in ("ids", "counts")]
        value, met = merged(arrays[0], arrays[1], a_size, arrays[2], arrays[3], b_size, terms)
        return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "value": [value], "met": [met]})

    parts = sides[0].groupBy(*key).cogroup(sides[1].groupBy(*key)).applyInArrow(priced, "lang string, a string, b string, value long, met long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    lacking = (F.col("terms") - F.coalesce("met", F.lit(0))) * F.abs(price("0", "a_size", "terms") - price("0", "b_size", "terms"))
    value = F.coalesce("value", F.lit(0)) + F.coalesce(lacking, F.lit(0))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", value.cast("long").alias("value"), both.alias("pair")).select("lang", "pair.source", "pair.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by divergence, and the source's own terms."""
    folder = shared_folder(docs.sparkSession, "divergence")
    kept, groups = kept_terms(docs, folder, min_docs)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_divergences(kept, groups, folder).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(own_terms(kept, groups, top).withColumn("part", F.lit("term")).select(*columns))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op11_sql() -> str:
    price = f"1 + ({SCALE} * (%s + {SMOOTH})::HUGEINT) // (%s + {SMOOTH} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  g AS (SELECT DISTINCT lang, source FROM d),
  kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DOCS}),
  c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
  cells AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, v FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
  p AS (SELECT *, {price % ("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p FROM cells),
  q AS (SELECT lang, term, {price % ("n", "sum(n) OVER (PARTITION BY lang)")} AS q FROM (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM cells GROUP BY ALL)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
  every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP}"""
